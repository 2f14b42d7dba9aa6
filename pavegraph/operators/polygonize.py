"""Masks to polygons: components and rings of each tile, placed on the ground and typed by class.

A tile is bounded, so its pixels are labelled and its rings traced in one Arrow group; only tiles are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shape import fill_holes, ring_area
from . import polygons

POINTS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
RINGS = "array<array<struct<x:double,y:double>>>"
#: Class values with their names and the least area of a hole that stays open. Fixed values.
FEATURES = ((0, "sidewalk", 25.0), (2, "crosswalk", 15.0), (1, "road", 30.0))


def merge_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for ``n`` nodes and links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def label_grid(grid: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The number of the first pixel of each pixel's 4-connected component of one value; -1 where no pixel is."""
    number = np.arange(grid.size).reshape(grid.shape)
    east = there[:, 1:] & there[:, :-1] & (grid[:, 1:] == grid[:, :-1])
    south = there[1:] & there[:-1] & (grid[1:] == grid[:-1])
    a = np.r_[number[:, :-1][east], number[:-1][south]]
    b = np.r_[number[:, 1:][east], number[1:][south]]
    return np.where(there, merge_labels(grid.size, a, b).reshape(grid.shape), -1)


def _grid(t: pa.Table) -> tuple[int, np.ndarray, np.ndarray, int, int]:
    """Tile, values and mask of the pixels of one tile, and its first row and column."""
    r, c, v = (t.column(n).to_numpy() for n in ("r", "c", "v"))
    top, left = int(r.min()), int(c.min())
    grid = np.zeros((int(r.max()) - top + 1, int(c.max()) - left + 1), np.int64)
    there = np.zeros(grid.shape, bool)
    grid[r - top, c - left], there[r - top, c - left] = v, True
    return t.column("tile")[0].as_py(), grid, there, top, left


def mask_components(px: DataFrame, width: int = 1 << 12) -> DataFrame:
    """(tile, r, c, v, component): 4-connected runs of one value, named by their first pixel's number."""

    def label(t: pa.Table) -> pa.Table:
        tile, grid, there, top, left = _grid(t)
        found = label_grid(grid, there)
        r, c = np.nonzero(there)
        first = found[r, c]
        component = (tile * width + top + first // grid.shape[1]) * width + left + first % grid.shape[1]
        columns = (np.full(len(r), tile, np.int64), (r + top).astype(np.int32), (c + left).astype(np.int32), grid[r, c].astype(np.int32), component.astype(np.int64))
        return pa.Table.from_arrays([pa.array(x) for x in columns], names=["tile", "r", "c", "v", "component"])

    narrow = px.select(F.col("tile").cast("long"), F.col("r").cast("int"), F.col("c").cast("int"), F.col("v").cast("int"))
    return narrow.groupBy("tile").applyInArrow(label, "tile long, r int, c int, v int, component long")


def trace(label: np.ndarray) -> dict[int, list[list[tuple[int, int]]]]:
    """Closed rings (x, y) of each label, without collinear points; insides lie to the right in row-down coordinates.

    A side of a pixel goes on to the next side of the same pixel, so parts that meet in a corner only stay apart.
    """
    h, w = label.shape
    wide = np.full((h + 2, w + 2), -1)
    wide[1:-1, 1:-1] = label
    sides = []  # start, end, pixel
    for dr, dc, (ax, ay), (bx, by) in ((-1, 0, (0, 0), (1, 0)), (0, 1, (1, 0), (1, 1)), (1, 0, (1, 1), (0, 1)), (0, -1, (0, 1), (0, 0))):
        r, c = np.nonzero((label >= 0) & (wide[1 + dr : h + 1 + dr, 1 + dc : w + 1 + dc] != label))
        sides.append(np.stack([c + ax, r + ay, c + bx, r + by, r * w + c], 1))
    flat = np.concatenate(sides)
    after: dict[tuple[int, int], list[int]] = {}
    for k, (x, y) in enumerate(flat[:, :2].tolist()):
        after.setdefault((x, y), []).append(k)
    rows, of = flat.tolist(), label.ravel()
    used = [False] * len(rows)
    rings: dict[int, list[list[tuple[int, int]]]] = {}
    for k in range(len(rows)):
        if used[k]:
            continue
        ring, at = [], k
        while not used[at]:
            used[at] = True
            x, y, bx, by, pixel = rows[at]
            nexts = [j for j in after[bx, by] if of[rows[j][4]] == of[pixel]]
            nxt = next((j for j in nexts if rows[j][4] == pixel), nexts[0])
            ring.append((x, y, bx - x, by - y))
            at = nxt
        corners = [(x, y) for i, (x, y, dx, dy) in enumerate(ring) if (dx, dy) != ring[i - 1][2:]]
        rings.setdefault(int(of[rows[k][4]]), []).append([*corners, corners[0]])
    return rings


def ring_extent(ring: list[tuple[int, int]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2


def mask_rings(px: DataFrame, width: int = 1 << 12) -> DataFrame:
    """(tile, v, component, rings): a polygon for each component, its outer ring first, in pixel coordinates."""

    def outline(t: pa.Table) -> pa.Table:
        tile, grid, there, top, left = _grid(t)
        found = trace(label_grid(grid, there))
        rows = []
        for first, rings in sorted(found.items()):
            r, c = divmod(first, grid.shape[1])
            ordered = sorted(rings, key=lambda ring: -ring_extent(ring))
            shapes = [[{"x": float(x + left), "y": float(y + top)} for x, y in ring] for ring in ordered]
            rows.append((tile, int(grid[r, c]), (tile * width + top + r) * width + left + c, shapes))
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), POINTS))], names=["tile", "v", "component", "rings"])

    narrow = px.select(F.col("tile").cast("long"), F.col("r").cast("int"), F.col("c").cast("int"), F.col("v").cast("int"))
    return narrow.groupBy("tile").applyInArrow(outline, f"tile long, v int, component long, rings {RINGS}")


def plain(rings: Column) -> Column:
    """Rings of points with x and y alone."""
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))))


def rings_area(rings: Column) -> Column:
    """The area of a polygon: its outer ring less its holes."""
    return F.aggregate(F.transform(rings, lambda r, i: F.when(i == 0, ring_area(r)).otherwise(-ring_area(r))), F.lit(0.0), lambda s, x: s + x)


def placed(rings: Column, west: Column, north: Column, east: Column, south: Column, size: Column | int) -> Column:
    """Rings in pixels of a tile of ``size`` pixels, moved to the ground coordinates of its bounds."""
    n = F.lit(size) if isinstance(size, int) else size
    dx, dy = (east - west) / n, (south - north) / n
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct((west + p["x"] * dx).alias("x"), (north + p["y"] * dy).alias("y"))))


def has_class(px: DataFrame, value: int) -> DataFrame:
    """(tile, present): whether a tile has any pixel of a class."""
    return px.groupBy("tile").agg(F.bool_or(F.col("v") == value).alias("present"))


def feature_layers(px: DataFrame, least_area: float = 20.0, convexity: float = 0.8) -> DataFrame:
    """(tile, f_type, component, rings): polygons of the three classes of at least ``least_area`` pixels.

    Holes under the class's size are filled, and polygons that nearly fill their hull become it.
    """
    kinds = px.sparkSession.createDataFrame([(v, name, hole) for v, name, hole in FEATURES], "v int, f_type string, hole double")
    large = mask_rings(px).filter(rings_area(F.col("rings")) >= least_area).join(F.broadcast(kinds), "v")  # three rows
    whole = large.select("tile", "f_type", "component", fill_holes(F.col("rings"), F.col("hole")).alias("rings"))
    return hull_if_convex(whole, convexity)


def hull_if_convex(layer: DataFrame, convexity: float = 0.8) -> DataFrame:
    """``layer`` with the hull in place of the rings of polygons whose area is more than ``convexity`` of it."""
    outlined = polygons.hull_rings(layer.withColumn("_outer", F.element_at("rings", 1)), "_outer")
    share = rings_area(F.col("rings")) / F.nullif(ring_area(F.col("hull")), F.lit(0.0))
    return outlined.withColumn("rings", F.when(share > convexity, F.array("hull")).otherwise(plain(F.col("rings")))).drop("_outer", "hull")


def box_if_straight(layer: DataFrame, convexity: float = 0.8, compactness: float = 0.2) -> DataFrame:
    """``layer`` (rings) with the least rotated box in place of long convex polygons.

    These fill more than ``convexity`` of their hull and less than ``compactness`` of their enclosing circle.
    """
    outlined = polygons.hull_rings(layer.withColumn("_outer", F.element_at("rings", 1)), "_outer")
    outlined = polygons.enclosing_circles(polygons.box_rings(outlined, "_outer"), "_outer")
    area = rings_area(F.col("rings"))
    straight = (area / F.nullif(ring_area(F.col("hull")), F.lit(0.0)) > convexity) & (area / (F.lit(np.pi) * F.pow("radius", F.lit(2.0))) < compactness)
    return outlined.withColumn("rings", F.when(straight, F.array("box")).otherwise(plain(F.col("rings")))).drop("_outer", "hull", "box", "centre_x", "centre_y", "radius")
