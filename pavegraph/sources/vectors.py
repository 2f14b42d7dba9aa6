"""Vector layers: WKT and GeoJSON text, and layer tables on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shape import ring_area

POINTS = "array<struct<x:double,y:double>>"


def _pairs(points: Column, between: str) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), between)


def wkt_line(points: Column) -> Column:
    return F.when(F.size(points) > 0, F.concat(F.lit("LINESTRING ("), _pairs(points, ", "), F.lit(")"))).when(F.size(points) == 0, "LINESTRING EMPTY")


def wkt_polygon(rings: Column) -> Column:
    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, lambda r: F.concat(F.lit("("), _pairs(r, ", "), F.lit(")"))), ", "), F.lit(")"))


def points_of_wkt(wkt: Column) -> Column:
    """The points of a WKT line, or of the outer ring of a polygon; null for other text."""
    inner = F.regexp_extract(wkt, r"(?i)^\s*(?:LINESTRING|POLYGON)\s*\(+([^()]*)\)", 1)
    point = lambda s: F.struct(F.split(F.trim(s), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(s), r"\s+")[1].cast("double").alias("y"))
    return F.when(inner != "", F.transform(F.split(inner, ","), point))


def geojson_line(points: Column, f_type: Column) -> Column:
    """A GeoJSON feature of a line, as text."""
    coordinates = F.transform(points, lambda p: F.array(p["x"], p["y"]))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(f_type.alias("f_type")).alias("properties"), F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates")).alias("geometry")))


def empty_collection(srid: int) -> str:
    return f'{{"type": "FeatureCollection", "name": "", "crs": {{"type": "name", "properties": {{"name": "urn:ogc:def:crs:EPSG::{srid}"}}}}, "features": []}}'


def read_layer(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A layer from Parquet, ORC, GeoJSON lines or CSV by its extension; columns are pruned at the scan."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("parquet", "orc"):
        layer = spark.read.format(kind).load(path)
    elif kind == "csv":
        layer = spark.read.option("header", "true").csv(path)
    elif kind in ("geojsonl", "jsonl", "json"):
        layer = spark.read.json(path)
    else:
        raise ValueError(f"no reader for {path}")
    return layer if columns is None else layer.select(*columns)


def write_layer(layer: DataFrame, path: str, by: str | None = "f_type") -> None:
    """A polygon or line layer as Parquet, a folder for each class so that readers of one class read only it."""
    writer = layer.write.mode("overwrite")
    (writer.partitionBy(by) if by and by in layer.columns else writer).parquet(path)


def write_grid(tiles: DataFrame, path: str) -> None:
    """Tile rows as CSV with a header."""
    tiles.write.mode("overwrite").option("header", "true").csv(path)


def write_features(lines: DataFrame, path: str) -> None:
    """Lines (pts, f_type) as GeoJSON, a feature a row."""
    lines.select(geojson_line(F.col("pts"), F.col("f_type"))).write.mode("overwrite").text(path)


def union_layers(layers: dict[str, DataFrame], by: str = "f_type") -> DataFrame:
    """Layers under each other with their class in ``by``; columns that a layer lacks are null there."""
    named = [layer.withColumn(by, F.lit(name)) for name, layer in layers.items()]
    out = named[0]
    for layer in named[1:]:
        out = out.unionByName(layer, allowMissingColumns=True)
    return out


def complete(layer: DataFrame) -> DataFrame:
    """Rows without a null in any column."""
    return layer.na.drop()


def class_layer(layer: DataFrame, f_type: str, least_area: float = 0.0, ring: str = "ring") -> DataFrame:
    """The polygons of a class of at least an area; the class is compared first, so that it reaches the scan."""
    return layer.filter((F.col("f_type") == f_type) & F.col(ring).isNotNull() & (ring_area(F.col(ring)) >= least_area))


def where(layer: DataFrame, **wanted: object) -> DataFrame:
    """Rows in which each column has the value given, or one of the values of a list."""
    for column, value in wanted.items():
        layer = layer.filter(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return layer


def of_kinds(layer: DataFrame, *kinds: str, wkt: str = "wkt") -> DataFrame:
    """Rows whose WKT is of one of the geometry types."""
    return layer.filter(F.upper(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1)).isin([k.upper() for k in kinds]))


def exploded_parts(layer: DataFrame, parts: str = "parts") -> DataFrame:
    """A row for each part of multi-part geometries, numbered in ``part``."""
    return layer.select(*[c for c in layer.columns if c != parts], F.posexplode(parts).alias("part", "pts"))


def html_row(*columns: str) -> Column:
    """A table row of a results page."""
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>")) for c in columns), F.lit("</tr>"))


def city_info(name: Column, box: Column, zoom: Column, tile_step: Column, crs: Column) -> Column:
    """A project's description as JSON: name, box (south, west, north, east), zoom, step and reference system."""
    return F.to_json(F.struct(name.alias("name"), box.alias("bbox"), zoom.alias("zoom"), tile_step.alias("tile_step"), crs.alias("crs")))


def parse_city_info(text: Column) -> Column:
    return F.from_json(text, "name string, bbox array<double>, zoom int, tile_step int, crs int")


def confusion_csv(hist: DataFrame, path: str) -> None:
    """A confusion matrix as CSV: a row for each true class, a column for each predicted one."""
    classes = [r["pred"] for r in hist.select("pred").distinct().orderBy("pred").collect()]  # as many rows as classes
    hist.groupBy("truth").pivot("pred", classes).agg(F.first("n")).orderBy("truth").write.mode("overwrite").option("header", "true").csv(path)


def write_masks(px: DataFrame, path: str) -> None:
    """Masks (tile, r, c, v) as a table sorted by tile, so that a reader of few tiles skips most of it."""
    px.repartitionByRange("tile").sortWithinPartitions("tile", "r", "c").write.mode("overwrite").parquet(path)


def read_masks(spark: SparkSession, path: str, tiles: DataFrame) -> DataFrame:
    """The masks of ``tiles`` (tile) that were saved; others drop out."""
    return spark.read.parquet(path).join(tiles, "tile", "left_semi")
