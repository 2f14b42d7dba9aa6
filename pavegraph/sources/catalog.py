"""The catalogue of imagery sources, and what is read from a source's own description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tilemath as tm
from ..operators.spatial import catalogue, select_source
from .paths import parse_location

#: Name, keywords, coverage (west, south, east, north; maine a box around its outline), zoom, image
#: format, tile size, year, outdated.
SOURCES = (
    ("nyc", ("New York City", "City of New York"), (-74.27615, 40.4889, -73.69048, 40.92834), 20, "png", 256, 2024, False),
    ("ny", ("New York",), (-79.77922, 40.48341, -73.25509, 45.03931), 20, "png", 256, 2024, False),
    ("ma", ("Massachusetts",), (-73.51979, 41.2265, -69.92466, 42.89199), 20, "jpg", 256, 2021, False),
    ("king", ("King County, Washington", "King County"), (-122.56958, 47.04875, -121.03559, 47.96618), 20, "png", 256, 2023, False),
    ("dc", ("District of Columbia", "DC"), (-77.12237, 38.78548, -76.90072, 39.0017), 19, "jpeg", 512, 2023, False),
    ("la", ("Los Angeles",), (-118.95937, 33.28853, -117.63102, 34.83012), 20, "png", 256, 2014, False),
    ("nj", ("New Jersey",), (-75.59981, 38.824, -73.85543, 41.3866), 20, "png", 256, 2020, False),
    ("sh_tn", ("Spring Hill, Tennessee", "Spring Hill"), (-87.13095, 35.58884, -86.75604, 35.85806), 20, "png", 256, 2020, False),
    ("va", ("Virginia",), (-83.6753, 36.5407, -75.1664, 39.466), 20, "png", 256, 2023, False),
    ("al", ("Alameda County", "California"), (-122.345118999, 37.451422681, -121.462793698, 37.912241999), 20, "png", 256, 2023, False),
    ("sf2014", ("San Francisco", "California"), (-122.514926, 37.708075, -122.356779, 37.832371), 20, "png", 512, 2014, True),
    ("sf2017", ("San Francisco", "California"), (-122.514926, 37.708075, -122.356779, 37.832371), 20, "png", 512, 2017, True),
    ("sf2018", ("San Francisco", "California"), (-122.514926, 37.708075, -122.356779, 37.832371), 20, "png", 512, 2018, True),
    ("sf2019", ("San Francisco", "California"), (-122.514926, 37.708075, -122.356779, 37.832371), 20, "png", 512, 2019, True),
    ("sf2020", ("San Francisco", "California"), (-122.514926, 37.708075, -122.356779, 37.832371), 20, "png", 512, 2020, True),
    ("sf2023", ("San Francisco", "California"), (-122.514926, 37.708075, -122.356779, 37.832371), 20, "png", 512, 2023, True),
    ("sf2024", ("San Francisco", "California"), (-122.514926, 37.708075, -122.356779, 37.832371), 20, "png", 512, 2024, False),
    ("maine", ("Maine",), (-71.1, 43.0, -66.9, 47.5), 20, "png", 256, 2023, False),
)


#: The service of each source; {z}, {x} and {y} are put in, {key} is the user's own.
SERVERS = {
    "nyc": "https://tiles.arcgis.com/tiles/yG5s3afENB5iO9fj/arcgis/rest/services/NYC_Orthos_2024/MapServer",
    "ny": "https://orthos.its.ny.gov/arcgis/rest/services/wms/2024/MapServer",
    "ma": "https://tiles.arcgis.com/tiles/hGdibHYSPO59RG1h/arcgis/rest/services/orthos2021/MapServer",
    "king": "https://gismaps.kingcounty.gov/arcgis/rest/services/BaseMaps/KingCo_Aerial_2023/MapServer",
    "dc": "https://imagery.dcgis.dc.gov/dcgis/rest/services/Ortho/Ortho_2021/ImageServer",
    "la": "https://cache.gis.lacounty.gov/cache/rest/services/LACounty_Cache/LACounty_Aerial_2014/MapServer",
    "nj": "https://maps.nj.gov/arcgis/rest/services/Basemap/Orthos_Natural_2020_NJ_WM/MapServer",
    "sh_tn": "https://tiles.arcgis.com/tiles/tF0XsRR9ptiKNVW2/arcgis/rest/services/Spring_Hill_Imagery_WGS84/MapServer",
    "va": "https://gismaps.vdem.virginia.gov/arcgis/rest/services/VBMP_Imagery/MostRecentImagery_WGS/MapServer/",
    "al": "https://svc.pictometry.com/Image/6D9E15C5-C6B4-4ACB-A244-4C44ECA33D90/wmts/PICT-CAALAM20-OQ74EOAkBw/default/GoogleMapsCompatible",
    "sf2024": "https://tile.sf.gov/api/tiles/p2024_rgb8cm",
    "maine": "https://api.vexcelgroup.com/v2/ortho",
}
TILED = ("al", "sf2024")
EXPORTED = ("dc",)
LAYERED = ("maine",)


def template_of(source: str, layer: str = "wide-area", key: str = "{key}") -> str:
    """The URL of a tile of a source, with {z}, {x} and {y}, or with the corners of the tile for one that exports boxes."""
    server = SERVERS[source]
    if source in TILED:
        return server + "/{z}/{x}/{y}.png"
    if source in EXPORTED:
        return server + "/exportImage?f=image&bbox={west}%2C{south}%2C{east}%2C{north}&imageSR=102100&bboxSR=102100&size=512%2C512"
    if source in LAYERED:
        return f"{server}/tile?layer={layer}&image-format=png&api_key={key}" + "&tile-x={x}&tile-y={y}&zoom={z}"
    return server + "/tile/{z}/{y}/{x}"


def metadata_url(source: str) -> str:
    """Where a source describes itself."""
    server = SERVERS[source]
    if source in LAYERED:
        return server + "/wmts?SERVICE=WMTS&REQUEST=GetCapabilities&VERSION=1.0.0"
    return server + ("/tiles.json" if source.startswith("sf") else "?f=json")


def tile_urls(tiles: DataFrame) -> DataFrame:
    """(idd, source, url) of tiles (idd, source, x, y, z); sources unknown give null.

    A source that exports boxes gets the corners of the tile in web mercator, to the centimetre.
    """
    table = F.create_map(*(F.lit(x) for s in SERVERS for x in (s, template_of(s))))
    west, east = tm.mercator_x(tm.tile_lon("x", F.col("z"))), tm.mercator_x(tm.tile_lon(F.col("x") + 1, F.col("z")))
    north, south = tm.mercator_y(tm.tile_lat("y", F.col("z"))), tm.mercator_y(tm.tile_lat(F.col("y") + 1, F.col("z")))
    url = F.try_element_at(table, F.col("source"))
    for name, value in (("x", F.col("x")), ("y", F.col("y")), ("z", F.col("z")), ("west", F.format_string("%.2f", west)), ("south", F.format_string("%.2f", south)), ("east", F.format_string("%.2f", east)), ("north", F.format_string("%.2f", north))):
        url = F.replace(url, F.lit("{" + name + "}"), value.cast("string"))
    return tiles.select("idd", "source", url.alias("url"))


def coverage(spark: SparkSession, failed: tuple[str, ...] = ()) -> DataFrame:
    """(source, west, south, east, north): the boxes of all current sources but those whose description failed."""
    return sources(spark).filter(~F.col("source").isin(list(failed))).select("source", "west", "south", "east", "north")


def resolve(items: DataFrame, gazetteer: DataFrame, table: DataFrame) -> DataFrame:
    """(item, source): the source that each item is about, null where there is none.

    An item is the name of a source, two or four coordinates, or an address that ``gazetteer`` (address, display, south,
    west, north, east) knows. Of the sources that cover it those named in the address come first, then those of which it
    covers most. ``table`` is the catalogue.
    """
    names = F.broadcast(catalogue(table).select(F.col("source").alias("item"), F.col("source").alias("own")))
    known = items.select("item").distinct().join(names, "item", "left")
    boxes = parse_location(known.filter("own is null").select(F.col("item").alias("id"), F.col("item").alias("location")))
    there = boxes.filter("south is not null").select(F.col("id").alias("name"), F.lit("").alias("display"), "south", "west", "north", "east")
    places = gazetteer.select(F.lower("address").alias("_a"), "display", "south", "west", "north", "east")
    asked = boxes.filter("south is null").select(F.col("id").alias("name")).join(places, F.lower("name") == F.col("_a")).drop("_a")
    least = F.lit(1e-9)  # a point is a box too
    regions = there.unionByName(asked).withColumns({"west": F.col("west") - least, "south": F.col("south") - least, "east": F.col("east") + least, "north": F.col("north") + least})
    found = select_source(regions, table, F.col("r.display")).select(F.col("name").alias("item"), "source")
    return known.join(found, "item", "left").select("item", F.coalesce("own", "source").alias("source"))


def sources(spark: SparkSession, outdated: bool = False) -> DataFrame:
    """(source, keyword, west, south, east, north, zoom, ext, tilesize, year, outdated), current ones only by default."""
    rows = [(name, list(words), *box, zoom, ext, size, year, old) for name, words, box, zoom, ext, size, year, old in SOURCES]
    table = spark.createDataFrame(rows, "source string, keyword array<string>, west double, south double, east double, north double, zoom int, ext string, tilesize int, year int, outdated boolean")
    return table if outdated else table.filter("not outdated")


def values_sql() -> str:
    rows = ", ".join(f"('{n}', {b[0]!r}::double, {b[1]!r}::double, {b[2]!r}::double, {b[3]!r}::double)" for n, _, b, *_, old in SOURCES if not old)
    return f"select * from (values {rows}) as s(source, west, south, east, north)"


def keywords_sql() -> str:
    rows = ", ".join(f"('{n}', '{k}')" for n, words, *_, old in SOURCES if not old for k in words)
    return f"select * from (values {rows}) as s(source, keyword)"


def by_keyword(addresses: DataFrame, table: DataFrame) -> DataFrame:
    """(source, keyword, address): sources of which a keyword stands in an address, whatever the case."""
    words = F.broadcast(catalogue(table).select("source", F.explode("keyword").alias("keyword")))
    return addresses.join(words, F.contains(F.lower("address"), F.lower("keyword"))).select("source", "keyword", "address")


def difference(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """(source, side) in one of two catalogues only; an empty result means that a cache can be used."""
    a, b = wanted.select("source"), cached.select("source")
    return a.exceptAll(b).withColumn("side", F.lit("missing")).union(b.exceptAll(a).withColumn("side", F.lit("stale")))


def zoom_of(described: DataFrame, most: int = 20) -> DataFrame:
    """(event_id, zoom, note) from JSON descriptions {"k": level}: the level given, at most ``most``."""
    level = F.from_json("props", "k bigint")["k"]
    return described.select("event_id", F.least(level, F.lit(most)).cast("long").alias("zoom"), F.when(level > most, "capped").otherwise("as given").alias("note"))


def metadata(documents: DataFrame, most: int = 20) -> DataFrame:
    """(name, west, south, east, north, zoom) from service descriptions (name, json) with an extent and levels of detail."""
    schema = "struct<fullExtent:struct<xmin:double,ymin:double,xmax:double,ymax:double>,maxLOD:int,tileInfo:struct<lods:array<struct<level:int>>>>"
    j = F.from_json("json", schema)
    deepest = F.coalesce(j["maxLOD"], F.array_max(F.transform(j["tileInfo"]["lods"], lambda v: v["level"])))
    e = j["fullExtent"]
    return documents.select("name", e["xmin"].alias("west"), e["ymin"].alias("south"), e["xmax"].alias("east"), e["ymax"].alias("north"), F.least(deepest, F.lit(most)).alias("zoom"))


def pick_layer(available: Column, preferred: Column) -> Column:
    """The first preferred layer that is available, else the first by name; layers that end in -g never count."""
    usable = F.filter(available, lambda v: ~v.endswith("-g"))
    wanted = F.filter(preferred, lambda v: F.array_contains(usable, v))
    return F.coalesce(F.get(wanted, F.lit(0)), F.array_min(usable))


def layers(capabilities: Column) -> Column:
    """Layer identifiers of a tile service's XML description, whatever its namespaces."""
    return F.xpath(capabilities, F.lit("//*[local-name()='Layer']/*[local-name()='Identifier']/text()"))


def extension_of(content_type: Column) -> Column:
    """File extension for a content type, null for an unknown one."""
    kinds = F.create_map(*map(F.lit, ("image/png", "png", "image/jpeg", "jpeg", "image/jpg", "jpg", "image/tiff", "tiff", "image/webp", "webp")))
    return F.try_element_at(kinds, F.trim(F.lower(F.split_part(content_type, F.lit(";"), F.lit(1)))))
