"""Tiles against polygons of any shape: a quadtree cover of each polygon, joined with the ancestors of tiles.

A polygon is covered by squares of tiles that lie wholly in it, as large as can be, and by single tiles that its outline
goes through. A tile meets the polygon if and only if one of its ancestors, or itself, is in the cover. So no tile is
held against a polygon, and a cover is as long as its outline is in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import dealt, table
from .overlay import plain

#: Pairs of square and side that are compared at once.
PAIRS = 1 << 20


def _crossed(cells: np.ndarray, size: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether any of the sides a-b goes through the inside of each square (cx, cy)."""
    out = np.zeros(len(cells), bool)
    d = b - a
    step = max(1, PAIRS // max(len(a), 1))
    for at in range(0, len(cells), step):
        low = cells[at : at + step, None, :] * size
        near, far = np.zeros((len(low), len(a))), np.ones((len(low), len(a)))
        for k in (0, 1):
            flat = d[:, k] == 0
            with np.errstate(divide="ignore", invalid="ignore"):
                t0, t1 = (low[:, :, k] - a[None, :, k]) / d[None, :, k], (low[:, :, k] + size - a[None, :, k]) / d[None, :, k]
            inside = (a[None, :, k] > low[:, :, k]) & (a[None, :, k] < low[:, :, k] + size)
            near = np.maximum(near, np.where(flat, np.where(inside, -1.0, 2.0), np.minimum(t0, t1)))
            far = np.minimum(far, np.where(flat, np.where(inside, 2.0, -1.0), np.maximum(t0, t1)))
        out[at : at + step] = (near < far).any(1)
    return out


def _holds(rings: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Whether points lie within the rings, an odd number of times."""
    odd = np.zeros(len(at), bool)
    for ring in rings:
        for a, b in zip(ring[:-1], ring[1:]):
            up = (a[1] > at[:, 1]) != (b[1] > at[:, 1])
            if up.any():
                odd ^= up & (at[:, 0] < a[0] + (at[:, 1] - a[1]) * (b[0] - a[0]) / ((b[1] - a[1]) or 1.0))
    return odd


def cover(rings: list[np.ndarray], size: float, levels: int) -> list[tuple[int, int, int]]:
    """(level, cx, cy): squares of 2^level tiles a side that lie in the rings, and tiles (level 0) that an outline goes through."""
    a, b = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    low, high = np.minimum(a, b).min(0), np.maximum(a, b).max(0)
    fits = float((high - low).min()) / size  # no larger square lies in the rings
    levels = min(levels, max(int(np.floor(np.log2(fits))), 0)) if fits >= 1 else 0
    top = size * 2**levels
    first, last = np.floor(low / top).astype(np.int64), np.floor(high / top).astype(np.int64)
    cells = np.stack(np.meshgrid(np.arange(first[0], last[0] + 1), np.arange(first[1], last[1] + 1), indexing="ij"), -1).reshape(-1, 2)
    out = []
    for level in range(levels, -1, -1):
        side = size * 2**level
        edge = _crossed(cells, side, a, b)
        whole = cells[~edge]
        whole = whole[_holds(rings, (whole + 0.5) * side)] if len(whole) else whole
        out += [(level, x, y) for x, y in whole.tolist()]
        cells = cells[edge]
        if level:
            cells = (cells[:, None, :] * 2 + np.array([(0, 0), (1, 0), (0, 1), (1, 1)])).reshape(-1, 2)
    return out + [(0, x, y) for x, y in cells.tolist()]


def covers(polygons: DataFrame, size: float, levels: int = 12, key: str = "geom_id", rings: str = "rings") -> DataFrame:
    """(key, level, cx, cy) of polygons (key, rings) on a grid of tiles of ``size``; polygons without sides have none."""
    kind = polygons.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for row, lists in enumerate(batch.column(1).to_pylist()):
                whole = [np.array([(p["x"], p["y"]) for p in r], float) for r in lists or [] if r and len(r) > 3]
                got = cover(whole, size, levels) if whole else []
                rows += [row] * len(got)
                found += got
            columns = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64())))], names=[key, "level", "cx", "cy"])

    return dealt(polygons.select(key, F.transform(rings, plain).alias("rings"))).mapInArrow(run, f"`{key}` {kind}, level int, cx long, cy long")


def _ancestors(tiles: DataFrame, squares: DataFrame) -> DataFrame:
    """Tiles with their ancestors at the levels that ``squares`` have, some ten at most."""
    levels = sorted(r.level for r in squares.select("level").distinct().collect())
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level")))
    return tiles.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumns({"cx": up("col"), "cy": up("row")})


def _shuffled(df: DataFrame) -> DataFrame:
    """``df`` to be joined by a shuffle: what Spark thinks of its size comes from the file, before ancestors and covers multiplied it."""
    return df.hint("merge")


def meeting(tiles: DataFrame, polygons: DataFrame, size: float, levels: int = 12, key: str = "geom_id", rings: str = "rings") -> DataFrame:
    """(idd, key): every tile (idd, col, row) with every polygon that it shares area with, once."""
    found = table(covers(polygons, size, levels, key, rings))
    return _ancestors(tiles.select("idd", "col", "row"), found).join(_shuffled(found), ["level", "cx", "cy"]).select("idd", key)


def tiles_marked(tiles: DataFrame, polygons: DataFrame, size: float, levels: int = 12, key: str = "geom_id", rings: str = "rings") -> DataFrame:
    """The tiles (idd, col, row, ...) with ``inside``: whether they share area with some polygon. Squares that several polygons cover count once."""
    squares = table(covers(polygons, size, levels, key, rings).select("level", "cx", "cy").distinct())
    hit = _ancestors(tiles.select("idd", "col", "row"), squares).join(_shuffled(squares), ["level", "cx", "cy"], "left_semi").select("idd").distinct()
    marked = tiles.join(_shuffled(hit.withColumn("inside", F.lit(True))), "idd", "left")
    return marked.withColumn("inside", F.coalesce("inside", F.lit(False)))


def tiles_meeting(tiles: DataFrame, polygons: DataFrame, size: float, levels: int = 12, outside: bool = False, key: str = "geom_id", rings: str = "rings") -> DataFrame:
    """The tiles (idd, col, row, ...) that share area with some polygon, or with none if ``outside``."""
    return tiles_marked(tiles, polygons, size, levels, key, rings).filter(F.col("inside") != F.lit(outside)).drop("inside")
