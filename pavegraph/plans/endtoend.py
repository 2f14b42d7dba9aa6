"""From a grid of synthetic tiles to class areas: stitching, segmentation and components in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import masks
from ..sources import images, vectors
from .fixtures import Views
from .registry import query

SIZE = 4


@query(
    "select v, count(*) as pixels from (select case when (unnest(range(16)) + p_partkey) % 5 = 0 then 0 when p_partkey % 2 = 0 then 1 else 3 end as v from part) t group by v"
)
def segmented_area(v: Views) -> DataFrame:
    """Pixels of each class after tiles were painted, stitched and segmented."""
    return _segmented(v.table("part"))


@query()
def segmented_area_whole(v: Views) -> DataFrame:
    """``segmented_area`` without SQL."""
    return _segmented(v.table("part"))


def _segmented(parts: DataFrame) -> DataFrame:
    colour = lambda c: F.unhex(F.lit("".join(f"{x:02x}" for x in images.PALETTE[c])))
    base = F.when(F.col("p_partkey") % 2 == 0, colour(1)).otherwise(colour(3))
    pixels = F.array(*(F.when((F.lit(i) + F.col("p_partkey")) % 5 == 0, colour(0)).otherwise(base) for i in range(SIZE * SIZE)))
    data = F.unhex(F.array_join(F.transform(pixels, F.hex), ""))
    k = F.col("p_partkey")
    tiles = parts.select(F.floor(k / 8).alias("col"), (k % 8).alias("row"), data.alias("data"))
    canvases = images.stitch_images(tiles, 2, SIZE)
    px = images.mask_pixels(images.segment(canvases, 2 * SIZE), 2 * SIZE, 4)
    at = lambda c: F.floor(F.col(c) / SIZE)
    px = px.withColumn("p_partkey", (F.floor(F.col("tile") / 4) * 2 + at("c")) * 8 + F.col("tile") % 4 * 2 + at("r"))
    return px.join(parts.select("p_partkey"), "p_partkey", "left_semi").groupBy("v").agg(F.count(F.lit(1)).alias("pixels"))  # no padding


@query("select count(*) as n_lines, cast(sum(n) as bigint) as n_points from (select l_orderkey, count(*) as n from lineitem group by l_orderkey) t")
def wkt_round_trip(v: Views) -> DataFrame:
    text = v.line().select(vectors.wkt_line(F.col("pts")).alias("wkt"))
    return text.select(vectors.points_of_wkt(F.col("wkt")).alias("pts")).agg(F.count("pts").alias("n_lines"), F.sum(F.size("pts")).alias("n_points"))


@query("select name, zoom, round(south, 9) as south, round(east, 9) as east from (select *, 19 as zoom from region_box) t", "region_box")
def city_info(v: Views) -> DataFrame:
    box = F.array("south", "west", "north", "east")
    text = v.region_box().select(vectors.city_info(F.col("name"), box, F.lit(19), F.lit(1), F.lit(4326)).alias("j"))
    return text.select(vectors.parse_city_info(F.col("j")).alias("i")).select("i.name", "i.zoom", F.round(F.col("i.bbox")[0], 9).alias("south"), F.round(F.col("i.bbox")[3], 9).alias("east"))


@query()
def class_polygons(v: Views) -> DataFrame:
    """Components of at least three pixels with their outline length: rows for a polygon layer."""
    px = v.mask_px()
    parts = masks.mask_components(px)
    areas = parts.groupBy("component").agg(F.min("tile").alias("tile"), F.min("v").alias("v"), F.count(F.lit(1)).alias("area")).filter("area >= 3")
    outline = masks.boundary_edges(parts.select(F.col("component").alias("tile"), "r", "c", F.col("v"))).groupBy(F.col("tile").alias("component")).agg(F.count(F.lit(1)).alias("edges"))
    return areas.join(outline, "component")
