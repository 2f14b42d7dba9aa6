"""Spatial joins as equi-joins on grid cells with an exact test after them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import dealt, table

#: Points of a square that one group takes at most, about, on either side; pairs of them compared at once.
GROUP, PAIRS = 20_000, 1 << 18
#: Points in a point's cell, on average, above which the nearest is first looked for in smaller cells.
CROWD = 4.0


def cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size)))


def near_cells(df: DataFrame, size: float) -> DataFrame:
    """Each point once for its cell and the eight around it."""
    around = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    return df.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around)).withColumn("cx", cell(F.col("x"), size) + F.col("_dx")).withColumn("cy", cell(F.col("y"), size) + F.col("_dy")).drop("_dx", "_dy")


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(left_id, right_id, dist) of points (id, x, y) at most ``radius`` apart."""
    a = near_cells(left, radius).select(F.col("id").alias("left_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy")
    b = right.select(F.col("id").alias("right_id"), F.col("x").alias("bx"), F.col("y").alias("by"), cell(F.col("x"), radius).alias("cx"), cell(F.col("y"), radius).alias("cy"))
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), F.lit(2.0)) + F.pow(F.col("ay") - F.col("by"), F.lit(2.0)))
    return a.join(b, ["cx", "cy"]).withColumn("dist", d).filter(F.col("dist") <= radius).select("left_id", "right_id", "ax", "ay", "bx", "by", "dist")


def count_within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(left_id, n): how many right points are at most ``radius`` from each left point that has any.

    No pair leaves the group that compares it. Squares of twice the radius are groups, with the right points around them;
    crowded ones are dealt into parts of bounded size on both sides, whose counts add up.
    """
    size = 2.0 * radius
    span = lambda c: F.explode(F.sequence(cell(F.col(c) - radius, size), cell(F.col(c) + radius, size)))
    a = left.select(F.col("id").alias("left_id"), F.col("x").cast("double").alias("ax"), F.col("y").cast("double").alias("ay")).withColumns({"cx": cell(F.col("ax"), size), "cy": cell(F.col("ay"), size)})
    b = right.select(F.xxhash64("id").alias("h"), F.col("x").cast("double").alias("bx"), F.col("y").cast("double").alias("by")).withColumn("cx", span("bx")).withColumn("cy", span("by"))
    parts = lambda df, name: df.groupBy("cx", "cy").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias(name))
    both = table(parts(a, "na").join(parts(b, "nb"), ["cx", "cy"]))
    one, every = (lambda h, n: F.pmod(h, F.col(n))), (lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    keys = ["cx", "cy", "pa", "pb"]
    a = a.join(both, ["cx", "cy"]).withColumn("pa", one(F.xxhash64("left_id", "ax", "ay"), "na")).withColumn("pb", every("nb")).select("left_id", "ax", "ay", *keys)
    b = b.join(both, ["cx", "cy"]).withColumn("pb", one(F.xxhash64("h", "bx", "by"), "nb")).withColumn("pa", every("na")).select("bx", "by", *keys)

    def count(l: pa.Table, r: pa.Table) -> pa.Table:
        column = lambda t, c: t.column(c).to_numpy()
        order = np.argsort(column(l, "ax"), kind="stable")
        ax, ay = column(l, "ax")[order], column(l, "ay")[order]
        by_x = np.argsort(column(r, "bx"), kind="stable")
        bx, by = column(r, "bx")[by_x], column(r, "by")[by_x]
        n, at = np.zeros(len(ax), np.int64), 0
        step = max(1, PAIRS // max(len(bx), 1))
        while at < len(ax):
            some = slice(at, at + step)
            near = slice(np.searchsorted(bx, ax[some][0] - radius * (1 + 1e-9), "left"), np.searchsorted(bx, ax[some][-1] + radius * (1 + 1e-9), "right"))
            n[some] = (np.sqrt((ax[some, None] - bx[None, near]) ** 2 + (ay[some, None] - by[None, near]) ** 2) <= radius).sum(1)
            at += step
        return pa.table({"left_id": l.column("left_id").take(pa.array(order)), "n": pa.array(n)})

    kind = a.schema["left_id"].dataType.simpleString()
    grouped = [dealt(df, *keys).groupBy(*keys) for df in (a, b)]
    found = grouped[0].cogroup(grouped[1]).applyInArrow(count, f"left_id {kind}, n long")
    return found.groupBy("left_id").agg(F.sum("n").alias("n")).filter("n > 0")


def _nearest(left: DataFrame, right: DataFrame, radius: float, digits: int) -> DataFrame:
    pairs = within(left, right, radius).withColumn("dist", F.round("dist", digits))
    least = pairs.groupBy("left_id").agg(F.min("dist").alias("least"))
    return pairs.join(least, "left_id").filter("dist = least").drop("least")


def nearest_within(left: DataFrame, right: DataFrame, radius: float, digits: int = 9) -> DataFrame:
    """For each left point its nearest right points within ``radius``, all of them on a tie.

    Only pairs of neighbouring cells meet; the least distance is aggregated before it is joined back, so a crowded
    cell is not sorted in one task. Where cells of the radius are crowded, smaller ones come first, and only points that
    found nothing there go on with cells four times as wide; so pairs grow with the points, not with their square.
    """
    count = right.groupBy(cell(F.col("x"), radius).alias("cx"), cell(F.col("y"), radius).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    crowd = count.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0
    rounds, done = 0, None
    while crowd > CROWD * 16**rounds and rounds < 8:
        rounds += 1
    for k in range(rounds, 0, -1):
        small = radius / 4**k
        found = _nearest(left, right, small, digits)
        found = table(found.filter(F.col("dist") <= small - 2 * 10.0**-digits))  # so that no tie is beyond the cells
        left = table(left.join(found.select(F.col("left_id").alias("id")).distinct(), "id", "left_anti"))
        done = found if done is None else done.unionByName(found)
    found = _nearest(left, right, radius, digits)
    return found if done is None else done.unionByName(found)


def boxes_overlapping(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """(left_id, right_id, overlap) of boxes (id, west, south, east, north) that share area; cells of ``size``.

    A pair that meets in several cells is reported from the cell of the lower corner of what it shares.
    """
    span = lambda lo, hi: F.sequence(cell(F.col(lo), size), cell(F.col(hi), size))
    spread = lambda df: df.withColumn("cx", F.explode(span("west", "east"))).withColumn("cy", F.explode(span("south", "north")))
    a, b = spread(left).alias("a"), spread(right).alias("b")
    west, south = F.greatest("a.west", "b.west"), F.greatest("a.south", "b.south")
    east, north = F.least("a.east", "b.east"), F.least("a.north", "b.north")
    met = a.join(b, (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")))
    return met.filter((west < east) & (south < north) & (cell(west, size) == F.col("a.cx")) & (cell(south, size) == F.col("a.cy"))).select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), ((east - west) * (north - south)).alias("overlap"))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a closed ring of structs (x, y), by crossings of a ray."""
    crosses = F.zip_with(
        F.slice(ring, 1, F.size(ring) - 1),
        F.slice(ring, 2, F.size(ring) - 1),
        lambda a, b: F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0),
    )
    return F.aggregate(crosses, F.lit(0), lambda s, v: s + v) % 2 == 1


#: Sources that a catalogue has at most; every region is held against each.
CATALOGUE_ROWS = 10_000


def catalogue(sources: DataFrame) -> DataFrame:
    """``sources``, after a check that there are few enough to broadcast."""
    if sources.limit(CATALOGUE_ROWS + 1).count() > CATALOGUE_ROWS:
        raise ValueError(f"a catalogue has at most {CATALOGUE_ROWS} sources")
    return sources


def select_source(regions: DataFrame, sources: DataFrame, address: Column | None = None) -> DataFrame:
    """(name, source, share): for each region box the source whose coverage it overlaps most, relative to the coverage.

    ``sources`` is the small catalogue: (source, keyword, west, south, east, north). With ``address`` a source that has
    a keyword in the address beats those without. Regions without a source are left out; ties go to the first name.
    """
    r, s = regions.alias("r"), F.broadcast(catalogue(sources)).alias("s")
    east, west = F.least("r.east", "s.east"), F.greatest("r.west", "s.west")
    north, south = F.least("r.north", "s.north"), F.greatest("r.south", "s.south")
    share = (east - west) * (north - south) / ((F.col("s.east") - F.col("s.west")) * (F.col("s.north") - F.col("s.south")))
    named = F.lit(False) if address is None else F.exists("s.keyword", lambda k: F.contains(F.lower(address), F.lower(k)))
    met = r.join(s, (west < east) & (south < north)).select("r.name", "s.source", share.alias("share"), named.alias("named"))
    order = Window.partitionBy("name").orderBy(F.desc("named"), F.desc("share"), "source")
    return met.withColumn("k", F.row_number().over(order)).filter("k = 1").select("name", "source", "share")
