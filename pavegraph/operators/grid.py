"""Tile grids: enumeration, numbering, stitching and boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tilemath as tm


def regions_to_tiles(regions: DataFrame, zoom: int, step: int = 1) -> DataFrame:
    """(name, col, row, idd, xtile, ytile) of every tile that a region's box touches.

    ``regions``: (name, south, west, north, east). Tiles are made lazily where their region is, one row at a time.
    """
    box = regions.select("name", tm.tile_x("west", zoom).alias("x0"), tm.tile_x("east", zoom).alias("x1"), tm.tile_y("north", zoom).alias("y0"), tm.tile_y("south", zoom).alias("y1"))
    cols = box.withColumn("xtile", F.explode(F.sequence("x0", "x1", F.lit(step).cast("bigint"))))
    tiles = cols.withColumn("ytile", F.explode(F.sequence("y0", "y1", F.lit(step).cast("bigint"))))
    height = F.floor((F.col("y1") - F.col("y0")) / step) + 1
    placed = tiles.withColumn("col", F.floor((F.col("xtile") - F.col("x0")) / step)).withColumn("row", F.floor((F.col("ytile") - F.col("y0")) / step))
    return placed.select("name", "col", "row", tm.grid_id("col", "row", height).alias("idd"), "xtile", "ytile")


def tile_corners(tiles: DataFrame, zoom: int, step: int = 1) -> DataFrame:
    """Adds west, north, east and south in degrees."""
    return tiles.withColumns({
        "west": tm.tile_lon("xtile", zoom),
        "north": tm.tile_lat("ytile", zoom),
        "east": tm.tile_lon(F.col("xtile") + step, zoom),
        "south": tm.tile_lat(F.col("ytile") + step, zoom),
    })


def tile_ring(west: Column, south: Column, east: Column, north: Column, lat_shift: float = -1e-5) -> Column:
    """The closed ring of a tile, both edges shifted by ``lat_shift`` degrees."""
    s, n = south + F.lit(lat_shift), north + F.lit(lat_shift)
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((west, s), (west, n), (east, n), (east, s), (west, s))))


def stitch_index(tiles: DataFrame, k: int, height: int) -> DataFrame:
    """For each tile its super-tile, and its column-major place in it."""
    big_height = -(-height // k)
    return tiles.select(
        "idd", "col", "row",
        F.floor(F.col("col") / k).alias("big_col"),
        F.floor(F.col("row") / k).alias("big_row"),
        (F.floor(F.col("col") / k) * big_height + F.floor(F.col("row") / k)).alias("big_id"),
        (F.pmod("col", F.lit(k)) * k + F.pmod("row", F.lit(k))).alias("place"),
    )


def stitch_pixels(pixels: DataFrame, tiles: DataFrame, k: int, size: int) -> DataFrame:
    """Pixels (tile, r, c, v) in coordinates of their super-tile; pixels of tiles without data are 0.

    ``tiles`` (idd, col, row) is the whole grid, joined by tile number; only tiles without data are filled.
    """
    placed = pixels.withColumnRenamed("tile", "idd").join(tiles, "idd").select("col", "row", F.col("r").cast("int"), F.col("c").cast("int"), "v")
    missing = tiles.join(pixels.select(F.col("tile").alias("idd")).distinct(), "idd", "left_anti")
    blank = missing.select("col", "row", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("i"))
    blank = blank.select("col", "row", F.floor(F.col("i") / size).cast("int").alias("r"), F.pmod("i", F.lit(size)).cast("int").alias("c"), F.lit(0).alias("v"))
    return placed.unionByName(blank).select(
        F.floor(F.col("col") / k).alias("big_col"), F.floor(F.col("row") / k).alias("big_row"),
        (F.pmod("row", F.lit(k)) * size + F.col("r")).alias("r"), (F.pmod("col", F.lit(k)) * size + F.col("c")).alias("c"),
        "v",
    )


def neighbor_block(tiles: DataFrame, d: int) -> DataFrame:
    """The d*d tiles from each tile on, itself included."""
    return tiles.select("idd", "col", "row", F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("dc")).select("idd", "col", "row", "dc", F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("dr")).select("idd", (F.col("col") + F.col("dc")).alias("ncol"), (F.col("row") + F.col("dr")).alias("nrow"))


def overlapping(tiles: DataFrame, boxes: DataFrame, how: str, cell: float) -> DataFrame:
    """Tiles (with corners) that overlap any box (``left_semi``) or none (``left_anti``).

    Boxes are dealt into cells of ``cell`` degrees, so the join has keys; both sides grow with their own cells only.
    """
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    small = lambda df: df.withColumn("cx", F.explode(cells("west", "east"))).withColumn("cy", F.explode(cells("south", "north")))
    t, b = small(tiles).alias("t"), small(boxes.select("west", "south", "east", "north")).alias("b")
    meet = (F.col("t.cx") == F.col("b.cx")) & (F.col("t.cy") == F.col("b.cy")) & (F.col("t.west") < F.col("b.east")) & (F.col("b.west") < F.col("t.east")) & (F.col("t.south") < F.col("b.north")) & (F.col("b.south") < F.col("t.north"))
    hit = t.join(b, meet, "left_semi").select("idd").distinct()
    return tiles.join(hit, "idd", how)
