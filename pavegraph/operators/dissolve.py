"""Buffer, union and erosion of polygon layers on a grid of cells.

A layer becomes the cells whose centres its polygons cover; union is distinct cells, a mitred buffer moves every cell to
its square surroundings, and erosion keeps cells all of whose surroundings are there. What comes out is as exact as the
cells are small, needs no geometry to be whole in one task, and polygons that overlap a thousandfold cost their cells once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shape import bounding_box
from ..functions.storage import dealt, table
from .arrangement import least_labels
from .components import components
from .polygonize import label_grid

#: Cells along a side of the squares that are labelled at once.
BLOCK = 256
#: Cells of a row that are merged in one group.
WIDTH = 1 << 14


def runs(polygons: DataFrame, cell: float, by: str = "f_type") -> DataFrame:
    """(by, cy, first, last): the cells of each class whose centre lies in a polygon (ring), as runs along rows that do not meet, but where WIDTH parts them.

    The line through the centres of a row goes in and out of a ring where it crosses its sides; so a polygon has as many
    rows as it is high, whatever its area.
    """
    boxed = dealt(polygons.select(by, "ring")).withColumn("box", bounding_box(F.col("ring")))
    rows = boxed.withColumn("cy", F.explode(F.sequence(F.floor(F.col("box.south") / cell), F.floor(F.col("box.north") / cell))))
    y, n = (F.col("cy") + F.lit(0.5)) * cell, F.greatest(F.size("ring") - 1, F.lit(0))
    cross = lambda a, b: F.when((a["y"] > y) != (b["y"] > y), (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])
    at = F.array_sort(F.array_compact(F.zip_with(F.slice("ring", 1, n), F.slice("ring", 2, n), cross)))
    at = F.when(F.size(at) % 2 == 1, F.concat(F.array(F.least(F.col("box.west"), F.get(at, F.lit(0)))), at)).otherwise(at)  # a ring that is not shut
    held = rows.select(by, "cy", at.cast("array<double>").alias("at")).filter(F.size("at") > 0)
    first = lambda x: F.ceil(x / cell - 0.5)
    pair = F.explode(F.sequence(F.lit(0), F.size("at") - 2, F.lit(2)))
    found = held.withColumn("k", pair).select(by, "cy", first(F.get("at", F.col("k"))).alias("first"), (first(F.get("at", F.col("k") + 1)) - 1).alias("last"))
    return _merged(found.filter("first <= last"), by).drop("block")


def _merged(found: DataFrame, by: str, halo: int = 0) -> DataFrame:
    """(by, cy, block, first, last): runs of any order as runs that do not meet, within blocks of a row and ``halo`` cells around them."""
    low, high = F.col("block") * WIDTH - halo, (F.col("block") + 1) * WIDTH - 1 + halo
    blocks = F.sequence(F.floor((F.col("first") - halo) / WIDTH), F.floor((F.col("last") + halo) / WIDTH))
    parts = found.select(by, "cy", "first", "last").withColumn("block", F.explode(blocks)).withColumns({"first": F.greatest("first", low), "last": F.least("last", high)})
    row = Window.partitionBy(by, "cy", "block").orderBy("first", "last")
    before = F.max("last").over(row.rowsBetween(Window.unboundedPreceding, -1))
    begun = parts.withColumn("begins", F.when(before.isNull() | (F.col("first") > before + 1), 1).otherwise(0))
    return begun.withColumn("run", F.sum("begins").over(row)).groupBy(by, "cy", "block", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def _rows_around(found: DataFrame, radius: int) -> DataFrame:
    return found.withColumn("cy", F.explode(F.sequence(F.col("cy") - radius, F.col("cy") + radius)))


def wider(found: DataFrame, radius: int, by: str = "f_type") -> DataFrame:
    """Runs of all cells at most ``radius`` away from a cell of ``found``, along rows and across."""
    return _merged(_rows_around(found.withColumns({"first": F.col("first") - radius, "last": F.col("last") + radius}), radius), by).drop("block")


def narrower(found: DataFrame, radius: int, by: str = "f_type") -> DataFrame:
    """Runs of the cells all of whose surroundings are cells too: those left of each row, where 2 * radius + 1 rows have them."""
    left = _merged(found, by, radius).withColumns({"first": F.col("first") + radius, "last": F.col("last") - radius}).filter("first <= last")
    ends = F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("n")), F.struct((F.col("last") + 1).alias("at"), F.lit(-1).alias("n"))))
    steps = _rows_around(left, radius).select(by, "cy", "block", ends.alias("e")).groupBy(by, "cy", "block", "e.at").agg(F.sum("e.n").alias("n"))
    row = Window.partitionBy(by, "cy", "block").orderBy("at")
    swept = steps.withColumns({"depth": F.sum("n").over(row), "next": F.lead("at").over(row)})
    return swept.filter(F.col("depth") == 2 * radius + 1).select(by, "cy", F.col("at").alias("first"), (F.col("next") - 1).alias("last"))


def n_cells() -> Column:
    """How many cells runs that do not meet have."""
    return F.coalesce(F.sum(F.col("last") - F.col("first") + 1), F.lit(0)).cast("long")


def cells_of(found: DataFrame, by: str = "f_type") -> DataFrame:
    """(by, cx, cy) of runs that do not meet."""
    return found.select(by, F.explode(F.sequence("first", "last")).alias("cx"), "cy")


def rasterised(polygons: DataFrame, cell: float, by: str = "f_type") -> DataFrame:
    """(by, cx, cy): the cells of each class whose centre lies in a polygon (ring)."""
    return cells_of(runs(polygons, cell, by), by)


def _around(cells: DataFrame, radius: int) -> DataFrame:
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    return cells.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps)).withColumn("cx", F.col("cx") + F.col("_dx")).withColumn("cy", F.col("cy") + F.col("_dy")).drop("_dx", "_dy")


def buffered(cells: DataFrame, radius: int, by: str = "f_type") -> DataFrame:
    return _around(cells, radius).select(by, "cx", "cy").distinct()


def eroded(cells: DataFrame, radius: int, by: str = "f_type") -> DataFrame:
    """Cells all of whose surroundings are cells too, counted before the shuffle."""
    full = (2 * radius + 1) ** 2
    return _around(cells, radius).groupBy(by, "cx", "cy").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == full).select(by, "cx", "cy")


def closed(polygons: DataFrame, cell: float, radius: int, by: str = "f_type") -> DataFrame:
    """Buffer, union and erode: gaps of up to twice the radius are closed, outlines come back."""
    return cells_of(narrower(wider(runs(polygons, cell, by), radius, by), radius, by), by)


def dissolved(cells: DataFrame, by: str = "f_type", width: int = 1 << 20) -> DataFrame:
    """(by, part, n_cells): the connected parts of each class, named by their first cell; coordinates lie within +-width/2.

    Squares of BLOCK cells are labelled in one Arrow group each. Only parts that touch over the edges of squares, a row
    for each such pair, go through the rounds of ``components``.
    """
    off = width // 2

    def label(t: pa.Table) -> pa.Table:
        x, y = t.column("cx").to_numpy(), t.column("cy").to_numpy()
        west, south = int(x.min()), int(y.min())
        there = np.zeros((int(x.max()) - west + 1, int(y.max()) - south + 1), bool)
        there[x - west, y - south] = True
        first = label_grid(np.zeros(there.shape, np.int64), there)[x - west, y - south]
        local = (west + first // there.shape[1] + off) * width + south + first % there.shape[1] + off
        return pa.table({by: t.column(by), "cx": t.column("cx"), "cy": t.column("cy"), "local": pa.array(local.astype(np.int64))})

    square = lambda c: F.floor(F.col(c) / BLOCK)
    narrow = cells.select(by, F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy"))
    labelled = table(narrow.groupBy(by, square("cx"), square("cy")).applyInArrow(label, f"`{by}` {cells.schema[by].dataType.simpleString()}, cx long, cy long, local long"))
    return _parts(labelled, labelled.groupBy(by, "local").agg(F.count(F.lit(1)).alias("n")), by)


def run_parts(found: DataFrame, by: str = "f_type", width: int = 1 << 20) -> DataFrame:
    """What ``dissolved`` tells of cells, from runs that do not meet: a square's runs are linked from row to row, and only cells at its sides leave it."""
    off = width // 2

    def label(t: pa.Table) -> pa.Table:
        t = t.sort_by([("cy", "ascending"), ("first", "ascending")])
        cy, first, last = (t.column(c).to_numpy() for c in ("cy", "first", "last"))
        big = 4 * BLOCK
        west, row = int(first.min()), (cy - cy.min()) * big
        starts, ends = row + first - west, row + last - west
        low, high = np.searchsorted(ends, starts + big), np.searchsorted(starts, ends + big, "right")  # those in the next row that begin before one's end and end after its start
        count = np.maximum(high - low, 0)
        a = np.repeat(np.arange(len(cy)), count)
        b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        part = least_labels(len(cy), a, b)
        name = np.full(len(cy), np.iinfo(np.int64).max)
        np.minimum.at(name, part, (first + off) * width + cy + off)
        size = np.bincount(part, last - first + 1, len(cy)).astype(np.int64)
        top = np.flatnonzero(part == np.arange(len(cy)))
        south, north = cy % BLOCK == 0, cy % BLOCK == BLOCK - 1
        whole = np.flatnonzero(south | north)
        n = (last - first + 1)[whole]
        along = np.repeat(first[whole], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        w, e = np.flatnonzero(~(south | north) & (first % BLOCK == 0)), np.flatnonzero(~(south | north) & (last % BLOCK == BLOCK - 1))
        at = np.concatenate([top, np.repeat(whole, n), w, e])
        cx = np.concatenate([first[top], along, first[w], last[e]])
        cells = np.concatenate([size[top], np.zeros(len(at) - len(top), np.int64)])
        return pa.table({by: t.column(by).take(pa.array(at)), "cx": pa.array(cx), "cy": pa.array(cy[at]), "local": pa.array(name[part[at]]), "n": pa.array(cells)})

    square = lambda c: F.floor(F.col(c) / BLOCK)
    parts = found.select(by, F.col("cy").cast("long").alias("cy"), "first", "last", F.explode(F.sequence(square("first"), square("last"))).alias("_x"), square("cy").alias("_y"))
    parts = parts.select(by, "cy", F.greatest("first", F.col("_x") * BLOCK).alias("first"), F.least("last", F.col("_x") * BLOCK + BLOCK - 1).alias("last"), "_x", "_y")
    labelled = table(dealt(parts, by, "_x", "_y").groupBy(by, "_x", "_y").applyInArrow(lambda t: label(t.drop(["_x", "_y"])), f"`{by}` {found.schema[by].dataType.simpleString()}, cx long, cy long, local long, n long"))
    return _parts(labelled.filter("n = 0").drop("n").distinct(), labelled.filter("n > 0").select(by, "local", "n"), by)


def _parts(labelled: DataFrame, parts: DataFrame, by: str) -> DataFrame:
    """(by, part, n_cells) of the parts (by, local, n) of squares; ``labelled`` has their cells, those at the sides of squares at least."""
    node = lambda c: F.struct(F.col(by).alias("k"), F.col(c).alias("c"))
    links = []
    for c in ("cx", "cy"):
        last = labelled.filter(F.pmod(c, F.lit(BLOCK)) == BLOCK - 1).withColumn(c, F.col(c) + 1).withColumnRenamed("local", "before")
        first = labelled.filter(F.pmod(c, F.lit(BLOCK)) == 0)
        links.append(last.join(first, [by, "cx", "cy"]).select(node("before").alias("a"), node("local").alias("b")))
    roots = components(links[0].union(links[1]))
    parts = parts.withColumn("own", node("local"))
    merged = parts.join(roots, F.col("own") == roots["node"], "left")
    return merged.groupBy(by, F.coalesce("root", "own").alias("part")).agg(F.sum("n").alias("n_cells")).select(by, F.col("part.c").alias("part"), "n_cells")
