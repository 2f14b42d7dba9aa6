"""From polygons to centrelines: the branches of crosswalk and sidewalk construction, and centrelines by thinning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shape import PI, line_length, ring_area
from ..functions.storage import dealt
from . import polygons

#: Areas and lengths at which construction branches. Fixed values.
CROSSWALK_LEAST, CONVEX, SHORT = 5.0, 0.8, 8.0
SIDEWALK_LEAST, ROUND, SPACING = 20.0, 0.8, 0.2


def crosswalk_branches(layer: DataFrame, convexity: float = CONVEX) -> DataFrame:
    """``layer`` (ring) with branch, erosion, length and ax, ay, bx, by_ of the middle line.

    Small polygons are skipped; those that fill little of their hull (crossings grown together) are eroded by a quarter
    of their mean width before they get centrelines; the others get the middle line of their least box, which is drawn
    out to the outline where it is short.
    """
    boxed = polygons.mid_axes(polygons.hull_rings(layer))
    area, perimeter = ring_area(F.col("ring")), line_length(F.col("ring"))
    length = F.sqrt(F.pow(F.col("bx") - F.col("ax"), F.lit(2.0)) + F.pow(F.col("by_") - F.col("ay"), F.lit(2.0)))
    convex = area / F.nullif(ring_area(F.col("hull")), F.lit(0.0))
    branch = F.when(area < CROSSWALK_LEAST, "skip").when(convex < convexity, "erode").when(length < SHORT, "extend").otherwise("middle")
    found = boxed.withColumn("branch", branch)
    return found.withColumns({"erosion": F.when(F.col("branch") == "erode", area / perimeter), "length": F.when(F.col("branch").isin("middle", "extend"), length)}).drop("hull")


def sidewalk_branches(layer: DataFrame) -> DataFrame:
    """``layer`` (ring) with branch and the spacing at which a centreline samples the outline: finer where it is nearly a circle."""
    area, perimeter = ring_area(F.col("ring")), line_length(F.col("ring"))
    roundness = F.lit(2.0) * F.sqrt(F.lit(PI) * area) / perimeter
    branch = F.when(area <= SIDEWALK_LEAST, "skip").when(roundness > ROUND, "round").otherwise("long")
    spacing = F.when(F.col("branch") == "round", F.sqrt(area / F.lit(PI)) / 4.0).when(F.col("branch") == "long", F.lit(SPACING))
    return layer.withColumn("branch", branch).withColumn("spacing", spacing)


def filled(xy: np.ndarray, cell: float) -> tuple[np.ndarray, float, float]:
    """Cells whose centre a closed ring holds, with a free margin, and the corner of the grid."""
    west, south = np.floor(xy.min(0) / cell) * cell - cell
    w, h = (np.ceil((xy.max(0) - (west, south)) / cell) + 1).astype(int)
    x = west + (np.arange(w) + 0.5) * cell
    inside = np.zeros((h, w), bool)
    a, b = xy[:-1], xy[1:]
    for r in range(h):
        y = south + (r + 0.5) * cell
        cross = (a[:, 1] > y) != (b[:, 1] > y)
        if cross.any():
            p, q = a[cross], b[cross]
            at = np.sort((q[:, 0] - p[:, 0]) * (y - p[:, 1]) / (q[:, 1] - p[:, 1]) + p[:, 0])
            inside[r] = np.searchsorted(at, x) % 2 == 1
    return inside, west, south


def thinned(cells: np.ndarray) -> np.ndarray:
    """A skeleton one cell wide: border cells go from all sides in turn as long as that parts nothing."""
    img = cells.copy()
    while True:
        changed = False
        for first in (True, False):
            p = np.pad(img, 1)
            n, ne, e, se, s, sw, w, nw = (p[1 + dr : p.shape[0] - 1 + dr, 1 + dc : p.shape[1] - 1 + dc] for dr, dc in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)))
            around = [n, ne, e, se, s, sw, w, nw]
            count = sum(x.astype(int) for x in around)
            turns = sum((~a & b).astype(int) for a, b in zip(around, around[1:] + around[:1]))
            sides = ~(n & e & s) & ~(e & s & w) if first else ~(n & e & w) & ~(n & s & w)
            gone = img & (count >= 2) & (count <= 6) & (turns == 1) & sides
            if gone.any():
                img &= ~gone
                changed = True
        if not changed:
            return img


def skeleton_lines(skeleton: np.ndarray) -> list[list[tuple[int, int]]]:
    """Lines (row, column) between the ends and forks of a skeleton; a closed loop is one line."""
    cells = {(int(r), int(c)) for r, c in zip(*np.nonzero(skeleton))}

    def near(p: tuple[int, int]) -> list[tuple[int, int]]:
        straight = [(p[0] + a, p[1] + b) for a, b in ((-1, 0), (0, 1), (1, 0), (0, -1)) if (p[0] + a, p[1] + b) in cells]
        slanted = [(p[0] + a, p[1] + b) for a, b in ((-1, -1), (-1, 1), (1, 1), (1, -1)) if (p[0] + a, p[1] + b) in cells]
        return straight + [q for q in slanted if (q[0], p[1]) not in cells and (p[0], q[1]) not in cells]

    links = {p: near(p) for p in sorted(cells)}
    nodes = [p for p, q in links.items() if len(q) != 2]
    seen: set[frozenset] = set()
    out = []

    def walk(p: tuple[int, int], q: tuple[int, int]) -> None:
        line = [p, q]
        seen.add(frozenset((p, q)))
        while len(links[q]) == 2 and q != line[0]:
            nxt = links[q][0] if links[q][0] != line[-2] else links[q][1]
            if frozenset((q, nxt)) in seen:
                break
            seen.add(frozenset((q, nxt)))
            line.append(nxt)
            q = nxt
        out.append(line)

    for p in nodes + list(links):
        for q in links[p]:
            if frozenset((p, q)) not in seen:
                walk(p, q)
    return out


def centerlines(layer: DataFrame, cell: float, key: str = "geom_id", tolerance: float = 1.0) -> DataFrame:
    """(key, part, pts): the centrelines of polygons (key, ring), simplified by ``tolerance`` cells.

    A polygon is filled with cells and thinned to a skeleton in one task, being bounded by itself.
    """
    point = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten()
            xy = np.stack([pc.struct_field(flat, c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y")], 1)
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
            rows = []
            for k, (end, n) in enumerate(zip(np.cumsum(size).tolist(), size.tolist())):
                if n < 4:
                    continue
                inside, west, south = filled(xy[end - n : end], cell)
                for part, line in enumerate(skeleton_lines(thinned(inside))):
                    pts = polygons.simplify(np.array([(west + (c + 0.5) * cell, south + (r + 0.5) * cell) for r, c in line]), tolerance * cell)
                    rows.append((k, part, [{"x": float(x), "y": float(y)} for x, y in pts]))
            which, parts, bodies = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), pa.array(parts, pa.int32()), pa.array(bodies, point)], names=[key, "part", "pts"])

    return dealt(layer.select(F.col(key).cast("long").alias(key), "ring")).mapInArrow(run, f"{key} long, part int, pts array<struct<x:double,y:double>>")
