"""Exact overlay of polygon layers: union, intersection, difference, mending, buffers and erosion of any polygons.

A layer is a table of directed rings with the inside on their left. Its segments are merged where they are equal, cut
along the lines of a grid, and each cell is solved by itself as a planar arrangement; windings at the corners of cells
come from crossings, summed along each row of cells. Lines that separate inside from outside are joined over the sides
of cells to rings. Coordinates are snapped to a grid of ``grain``; nothing else is approximate.

A buffer is the union of a polygon with a strip along each side and a mitre at each corner that points outwards;
an erosion is the difference to such strips on the other side. So corners are mitred and caps are square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import dealt, table
from .arrangement import chained, distinct, runs, several_boundaries
from .components import SMALL_LINKS, components

#: Side of a cell and of the snapping grid, in units of the plane.
CELL, GRAIN = 64.0, 1e-6
#: Segments that are solved by one call, about; a cell is never parted.
SEGMENTS = 16_384
#: Lines are joined in squares of STEP x STEP cells, and LEVELS times in squares of squares, before they are joined one by one.
STEP, LEVELS = 8, 4
#: Where the lines between rows of cells lie that ways to points go along, in cells: not where corners are.
LINE = 0.3090169943749474
CHAIN = "cx long, cy long, closed boolean, pts array<struct<x:long,y:long>>"
#: Sharper corners than this ratio of mitre to distance are cut off straight.
MITRE = 5.0
RING = "array<struct<x:double,y:double>>"
RULES = {
    "union": lambda w: (w[:, 0] > 0) | (w[:, 1] > 0),
    "intersection": lambda w: (w[:, 0] > 0) & (w[:, 1] > 0),
    "difference": lambda w: (w[:, 0] > 0) & (w[:, 1] <= 0),
    "symmetric": lambda w: (w[:, 0] > 0) != (w[:, 1] > 0),
    "odd": lambda w: w[:, 0] % 2 == 1,
}


def signed_area(ring: Column) -> Column:
    """Twice the area of a closed ring, positive counter-clockwise; relative to its first point, for the sake of digits."""
    x, y = (lambda p: p["x"] - F.get(ring, F.lit(0))["x"]), (lambda p: p["y"] - F.get(ring, F.lit(0))["y"])
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.aggregate(F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: x(a) * y(b) - x(b) * y(a)), F.lit(0.0), lambda s, v: s + v)


def plain(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))


def directed(polygons: DataFrame, by: str, rings: str = "rings", *more: str) -> DataFrame:
    """(by, ring) and the columns ``more``: the rings of polygons, the first of each counter-clockwise and its holes clockwise; rings of less than three sides go."""
    each = polygons.select(by, F.posexplode(rings).alias("_no", "ring"), *more).withColumn("ring", plain(F.col("ring"))).filter(F.size("ring") > 3)
    turn = (signed_area(F.col("ring")) < 0) != (F.col("_no") > 0)
    return each.select(by, F.when(turn, F.reverse("ring")).otherwise(F.col("ring")).alias("ring"), *more)


def _segments(rings: DataFrame, by: str, grain: float, layer: int) -> DataFrame:
    """(by, ax, ay, bx, by_, na, nb): distinct segments, smaller end first, in whole numbers, with how often the layer goes along them."""
    snap = lambda p: F.struct((F.round(p["x"] / grain) * 2).cast("long").alias("x"), (F.round(p["y"] / grain) * 2).cast("long").alias("y"))
    pts = F.transform("ring", snap)
    n = F.greatest(F.size("ring") - 1, F.lit(0))
    sides = rings.select(F.col(by), F.explode(F.arrays_zip(F.slice(pts, 1, n).alias("a"), F.slice(pts, 2, n).alias("b"))).alias("s")).filter("s.a != s.b")
    back = F.col("s.a") > F.col("s.b")
    lo, hi = F.least("s.a", "s.b"), F.greatest("s.a", "s.b")
    kept = sides.select(by, lo.alias("lo"), hi.alias("hi"), F.when(back, -1).otherwise(1).alias("n")).groupBy(by, "lo", "hi").agg(F.sum("n").alias("n")).filter("n != 0")
    counts = (F.col("n"), F.lit(0).cast("long")) if layer == 0 else (F.lit(0).cast("long"), F.col("n"))
    return kept.select(by, F.col("lo.x").alias("ax"), F.col("lo.y").alias("ay"), F.col("hi.x").alias("bx"), F.col("hi.y").alias("by_"), counts[0].alias("na"), counts[1].alias("nb"))


def _cut_at(p: np.ndarray, n: np.ndarray, of: np.ndarray, axis: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments (ax, ay, bx, by) cut where they cross the lines k * size + 1 of an axis; ``of`` goes along."""
    a, b = p[:, axis], p[:, 2 + axis]
    first = np.floor_divide(np.minimum(a, b) - 1, size)
    last = -np.floor_divide(1 - np.maximum(a, b), size)  # the first line at or after the greater end
    count = np.maximum(last - first - 1, 0)
    which = np.repeat(np.arange(len(p)), count)
    k = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    at = (np.repeat(first, count) + 1 + k) * size + 1
    other = 1 - axis
    t = (at - p[which, axis]) / (p[which, 2 + axis] - p[which, axis])
    cross = np.rint((p[which, other] + t * (p[which, 2 + other] - p[which, other])) / 2) * 2
    if axis == 1:  # within the column of cells that the segment is in
        column = np.floor_divide(np.minimum(p[which, 0], p[which, 2]) - 1, size) * size
        cross = np.clip(cross, column + 2, column + size)
    marks = np.empty((len(which), 2), np.int64)
    marks[:, axis], marks[:, other] = at, cross
    every = np.arange(len(p))
    ids = np.concatenate([every, which, every])
    points = np.concatenate([p[:, :2], marks, p[:, 2:]])
    along = np.concatenate([np.full(len(p), -1.0), t, np.full(len(p), 2.0)])
    order = np.lexsort((along, ids))
    ids, points = ids[order], points[order]
    same = ids[:-1] == ids[1:]
    return np.hstack([points[:-1], points[1:]])[same], n[ids[:-1][same]], of[ids[:-1][same]]


def _pieces(segments: DataFrame, by: str, size: int) -> DataFrame:
    """(by, cx, cy, ax, ay, bx, by_, na, nb): the segments' pieces in each cell, relative to its corner."""
    names = ["cx", "cy", "ax", "ay", "bx", "by_", "na", "nb"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.stack([batch.column(i).to_numpy() for i in range(1, 5)], 1)
            n = np.stack([batch.column(i).to_numpy() for i in (5, 6)], 1)
            p, n, of = _cut_at(p, n, np.arange(len(p)), 0, size)
            p, n, of = _cut_at(p, n, of, 1, size)
            cell = np.stack([np.floor_divide(np.minimum(p[:, i], p[:, 2 + i]) - 1, size) for i in (0, 1)], 1)
            p = p - np.tile(cell * size + 1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *(pa.array(c) for c in np.hstack([cell, p, n]).T)], names=[by, *names])

    kind = segments.schema[by].dataType.simpleString()
    return dealt(segments).mapInArrow(cut, f"`{by}` {kind}, " + ", ".join(f"{c} long" for c in names))


def lists(length: np.ndarray, points: np.ndarray) -> pa.ListArray:
    """Points (x, y) that follow each other as lists, ``length`` of them each."""
    xy = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], names=["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), xy)


def points_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(length, points): the opposite; a null list has no points."""
    xy = column.flatten()
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), np.stack([pc.struct_field(xy, c).to_numpy(zero_copy_only=False) for c in ("x", "y")], 1)


def _chains(pieces: DataFrame, by: str, size: int, rules: tuple[str, ...]) -> DataFrame:
    """(by, cx, cy, closed, pts, how): lines between inside and outside by each rule in each cell, in whole numbers of the plane."""
    down = lambda n: F.sum(F.when(F.col("by_") == 0, F.col(n)).otherwise(0) - F.when(F.col("ay") == 0, F.col(n)).otherwise(0))
    before = Window.partitionBy(by, "cy").orderBy("cx").rowsBetween(Window.unboundedPreceding, -1)
    cells = pieces.groupBy(by, "cx", "cy").agg(down("na").alias("da"), down("nb").alias("db"))
    wound = [F.coalesce(F.sum(d).over(before), F.lit(0)).alias(n) for d, n in (("da", "na"), ("db", "nb"))]
    nil = [F.lit(0).cast("long").alias(c) for c in ("ax", "ay", "bx", "by_")]
    rows = pieces.count()
    several = max(rows // SEGMENTS, 2 * pieces.sparkSession.sparkContext.defaultParallelism)
    every = pieces.withColumn("corner", F.lit(False)).unionByName(cells.select(by, "cx", "cy", *nil, *wound, F.lit(True).alias("corner")))

    def solve(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        col = lambda *names: np.stack([t.column(c).to_numpy() for c in names], 1)
        key = t.column(by).combine_chunks()
        code = key.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        cell, lines, n = col("cx", "cy"), col("ax", "ay", "bx", "by_"), col("na", "nb")
        order, first, number = distinct(np.column_stack([code, cell]))
        one = order[first]  # a row of each cell
        corner = t.column("corner").to_numpy()
        base = np.zeros((len(one), 2), np.int64)
        base[number[corner]] = n[corner]
        parts = []
        for rule, (where, closed, length, points) in zip(rules, several_boundaries(lines[~corner], n[~corner], number[~corner], size, base, [RULES[r] for r in rules])):
            rows = one[where]
            points = points + np.repeat(cell[rows] * size + 1, length, axis=0)
            parts.append(pa.table({by: key.take(pa.array(rows)), "cx": cell[rows, 0], "cy": cell[rows, 1], "closed": closed, "pts": lists(length, points), "how": pa.repeat(rule, len(rows))}))
        return pa.concat_tables(parts)

    kind = pieces.schema[by].dataType.simpleString()
    some = every.withColumn("_some", F.pmod(F.xxhash64(by, "cx", "cy"), F.lit(several)))
    found = dealt(some, "_some", rows=rows).groupBy("_some").applyInArrow(solve, f"`{by}` {kind}, {CHAIN}, how string")
    return table(found)


def _turns(back: np.ndarray, out: np.ndarray) -> np.ndarray:
    """How far one turns clockwise from the ways back to the ways out."""
    angle = lambda v: np.arctan2(v[:, 1].astype(float), v[:, 0].astype(float))
    return (angle(back) - angle(out)) % (2 * math.pi)


def _joined(t: pa.Table) -> pa.Table:
    """Lines of one square, those that go on within it as one; a line goes on with the next one clockwise from its way back.

    All steps are ones on arrays, however many lines there are and however long they are.
    """
    t = t.combine_chunks()
    key = t.column(0).combine_chunks()
    code = key.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    length, points = points_of(t.column("pts").combine_chunks())
    n, ends = len(length), np.cumsum(length)
    begins = ends - length
    _, first, number = distinct(np.column_stack([np.tile(code, 2), np.concatenate([points[begins], points[ends - 1]])]))
    at, to = number[:n], number[n:]
    order = np.argsort(at, kind="stable")
    count = np.bincount(at, minlength=len(first))
    line, start = np.repeat(np.arange(n), count[to]), order[runs((np.cumsum(count) - count)[to], count[to])]
    turn = _turns(points[ends[line] - 2] - points[ends[line] - 1], points[begins[start] + 1] - points[begins[start]])
    best = np.lexsort((turn, line))
    best = best[np.diff(line[best], prepend=-1) > 0]
    order = np.argsort(start[best], kind="stable")  # of lines that lead to the same one the first goes on; the others wait for the next larger square
    best = best[order[np.diff(start[best[order]], prepend=-1) > 0]]
    after = np.full(n, -1)
    after[line[best]] = start[best]
    way, member, closed = chained(after)
    new = np.flatnonzero(np.diff(way, prepend=-1))
    less = np.ones(len(member), np.int64)
    less[new] = 0
    pts = points[runs(begins[member] + less, length[member] - less)]
    rows = pa.array(member[new])
    own = np.add.reduceat(length[member] - less, new) if len(new) else np.empty(0, np.int64)
    return pa.table({t.column_names[0]: key.take(rows), "cx": t.column("cx").combine_chunks().take(rows), "cy": t.column("cy").combine_chunks().take(rows), "closed": pa.array(closed), "pts": lists(own, pts)})


def _joined_up(chains: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(closed, open) lines after joining them in squares of STEP x STEP cells, of STEP x STEP of these, and so on."""
    done, open_ = chains.filter("closed"), chains.filter("not closed")
    kind = chains.schema[by].dataType.simpleString()
    for level in range(1, LEVELS + 1):
        if open_.isEmpty():
            break
        square = [F.floor(F.col(c) / STEP**level).alias(f"_{c}") for c in ("cx", "cy")]
        more = table(dealt(open_.select("*", *square), "_cx", "_cy").groupBy("_cx", "_cy").applyInArrow(lambda t: _joined(t.drop(["_cx", "_cy"])), f"`{by}` {kind}, {CHAIN}"))
        done, open_ = done.unionByName(more.filter("closed")), more.filter("not closed")
    return done, open_


def _linked(open_: DataFrame, by: str) -> DataFrame:
    """(id, next): which line goes on from the end of each; of several at one place the next one clockwise from the way back."""
    point = lambda i: F.element_at("pts", i)
    angle = lambda a, b: F.atan2((b["y"] - a["y"]).cast("double"), (b["x"] - a["x"]).cast("double"))
    ends = open_.select(F.col(by).alias("k"), "id", point(-1).alias("at"), angle(point(-1), point(-2)).alias("back"))
    starts = open_.select(F.col(by).alias("k2"), F.col("id").alias("next"), point(1).alias("at2"), angle(point(1), point(2)).alias("out"))
    met = ends.join(starts, F.col("k").eqNullSafe(F.col("k2")) & (F.col("at") == F.col("at2")), "left")
    return met.groupBy("id").agg(F.min_by("next", F.pmod(F.col("back") - F.col("out") + 4 * math.pi, F.lit(2 * math.pi))).alias("next"))


def simple_loops(points: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """A closed walk (first point not repeated) as loops without a repeated point; those without area go."""
    out, way, at = [], [], {}
    for p in [*points, *points[:1]]:
        if p in at:
            k = at[p]
            out.append(way[k:])
            for q in way[k + 1 :]:
                del at[q]
            del way[k + 1 :]
        else:
            at[p] = len(way)
            way.append(p)
    return [loop for loop in out if len(loop) > 2]


def _uncut(way: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A closed walk without the points where it only passes from cell to cell; those have an odd coordinate and lie on a side.

    Where sides cross on the very line between cells the point stays, moved onto the snapping grid: onto a node of the
    walk, or a point that it passes twice, if one is there or next to it. So the walk touches itself where it crossed.
    """
    moved = lambda p: (p[0] - p[0] % 2, p[1] - p[1] % 2)
    out, seen, nodes = [], set(), set()
    for p in way:
        if p in seen or moved(p) == p:
            nodes.add(moved(p))
        seen.add(p)
    for k, p in enumerate(way):
        at = moved(p)
        if at != p and at not in nodes:
            q = out[-1][0] if out else way[-1]
            r = way[k + 1] if k + 1 < len(way) else (out[0][0] if out else way[0])  # a first point that went says nothing of the last one
            ax, ay, bx, by = p[0] - q[0], p[1] - q[1], r[0] - q[0], r[1] - q[1]
            if abs(ax * by - ay * bx) <= 2 * math.hypot(bx, by) and 0 < ax * bx + ay * by < bx * bx + by * by:
                continue
            at = next((n for n in ((at[0] + dx, at[1] + dy) for dx in (0, -2, 2) for dy in (0, -2, 2)) if n in nodes), at)
        out.append((p, at))
    return [at for k, (_, at) in enumerate(out) if at != out[k - 1][1]]


def _straight(loop: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A loop without points that lie on a side."""
    a = loop[-1:] + loop[:-1]
    b = loop[1:] + loop[:1]
    return [p for p, q, r in zip(loop, a, b) if (p[0] - q[0]) * (r[1] - p[1]) != (p[1] - q[1]) * (r[0] - p[0])]


def _loops(ways: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, twice the area, length, points) of the closed simple loops that closed walks (row, points) are made of."""
    rows, areas, length, points = [], [], [], []
    for row, way in ways:
        for loop in simple_loops(_uncut(way)) if len(way) > 2 else []:
            loop = _straight(loop)
            if len(loop) < 3:
                continue
            twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(loop, loop[1:] + loop[:1]))
            if twice:
                rows.append(row)
                areas.append(float(twice))
                length.append(len(loop) + 1)
                points += loop + loop[:1]
    return np.array(rows, np.int64), np.array(areas, float), np.array(length, np.int64), np.array(points, np.int64).reshape(-1, 2)


def _plain_loops(length: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(plain, as of ``_loops``): which closed lines pass no side of a cell and no point twice, and what they come to, all at once."""
    ends = np.cumsum(length)
    row = np.repeat(np.arange(len(length)), length)
    last = np.zeros(len(row), bool)
    last[ends - 1] = True
    row, p = row[~last], points[~last]
    plain = np.ones(len(length), bool)
    plain[row[(p % 2 != 0).any(1)]] = False
    order, first, _ = distinct(np.column_stack([row, p]))
    again = np.ones(len(order), bool)
    again[first] = False
    plain[row[order[again]]] = False
    begin = ends - length  # points of a row, and so products of their differences, lie within a long
    far = np.abs(p - points[begin[row]]).max(1, initial=0)
    plain[row[far >= 2**29]] = False

    def turned(row: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.diff(row, prepend=-1))
        size = np.diff(first, append=len(row))
        back, on = np.arange(-1, len(row) - 1), np.arange(1, len(row) + 1)
        back[first], on[first + size - 1] = first + size - 1, first
        return first, size, back, on

    ok = plain[row]
    row, p = row[ok], p[ok]
    _, _, back, on = turned(row, p)
    a, b = p - p[back], p[on] - p
    bent = a[:, 0] * b[:, 1] != a[:, 1] * b[:, 0]
    row, p = row[bent], p[bent]
    first, size, _, on = turned(row, p)
    if not len(row):
        return plain, _loops([])
    q = p - np.repeat(p[first], size, axis=0)
    twice = np.add.reduceat(q[:, 0] * q[on, 1] - q[on, 0] * q[:, 1], first)
    kept = (size > 2) & (twice != 0)
    at = runs(first[kept], size[kept] + 1)
    at[np.cumsum(size[kept] + 1) - 1] = first[kept]
    return plain, (row[first[kept]], twice[kept].astype(float), size[kept] + 1, p[at])


def _rings(chains: DataFrame, by: str, grain: float) -> DataFrame:
    """(by, ring, area): closed rings, the inside on the left; the area is negative for holes."""
    done, open_ = _joined_up(chains, by)
    kind = f"`{by}` {chains.schema[by].dataType.simpleString()}, ring {RING}, area double"

    def emit(batch: pa.RecordBatch, rows: np.ndarray, twice: np.ndarray, length: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists(length, points * grain / 2), pa.array(twice / 8 * grain * grain)], names=[by, "ring", "area"])

    def shut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, points = points_of(batch.column(1))
            plain, found = _plain_loops(length, points)
            yield emit(batch, *found)
            rest = np.flatnonzero(~plain)
            if len(rest):
                ends = np.cumsum(length)
                yield emit(batch, *_loops([(k, list(map(tuple, points[ends[k] - length[k] : ends[k] - 1].tolist()))) for k in rest.tolist()]))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ways = []
            for row, parts in enumerate(batch.column(1).to_pylist()):
                of = {p["id"]: p for p in parts}
                heads = set(of) - {p["next"] for p in parts}
                way, k = [], min(heads) if heads else min(of)
                while k in of:
                    part = of.pop(k)
                    way += [(p["x"], p["y"]) for p in part["pts"][:-1]]
                    k = part["next"]
                ways.append((row, way))
            yield emit(batch, *_loops(ways))

    rings = dealt(done.select(by, "pts")).mapInArrow(shut, kind)
    if not open_.isEmpty():  # what is larger than any square
        known = table(open_.withColumn("id", F.monotonically_increasing_id()))
        links = table(_linked(known, by))
        roots = components(links.select(F.col("id").alias("a"), F.coalesce("next", "id").alias("b")), SMALL_LINKS)
        keyed = known.join(links, "id").join(roots, F.col("id") == F.col("node"))
        parts = keyed.groupBy(by, "root").agg(F.collect_list(F.struct("id", F.coalesce("next", F.lit(-1)).alias("next"), "pts")).alias("parts")).select(by, "parts")
        rings = rings.unionByName(dealt(parts).mapInArrow(close, kind))
    return rings


def overlay(a: DataFrame, b: DataFrame | None = None, how: str = "union", by: str = "f_type", cell: float = CELL, grain: float = GRAIN) -> DataFrame:
    """(by, ring, area) of the result for each value of ``by``: rings without crossings, the inside on the left.

    ``a`` and ``b`` have (by, ring), directed; ``how`` is a key of RULES ("odd" takes ``a`` alone, in any direction). Rings
    that touch themselves come apart at the point. Areas of holes are negative, so they add up. A null ``by`` is a value.
    A cell should hold some hundred segments; rings are values of one row each.
    """
    size = 2 * round(cell / grain)
    segments = _segments(a, by, grain, 0)
    if b is not None:
        segments = segments.unionByName(_segments(b, by, grain, 1))
    pieces = table(_pieces(segments, by, size))
    return _rings(_chains(pieces, by, size, (how,)).drop("how"), by, grain)


def overlays(a: DataFrame, b: DataFrame, hows: tuple[str, ...], by: str = "f_type", cell: float = CELL, grain: float = GRAIN) -> DataFrame:
    """(how, by, ring, area): ``overlay`` for several keys of RULES; segments are cut, and cells arranged, once for all of them."""
    size = 2 * round(cell / grain)
    pieces = table(_pieces(_segments(a, by, grain, 0).unionByName(_segments(b, by, grain, 1)), by, size))
    found = _chains(pieces, by, size, tuple(hows))
    kind = found.schema[by].dataType
    key = F.concat("how", F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")))  # both as one, as lines are joined by one column
    rings = _rings(found.select(key.alias("_key"), "cx", "cy", "closed", "pts"), "_key", grain)
    return rings.select(F.substring_index("_key", "=", 1).alias("how"), F.when(F.col("_key").contains("="), F.regexp_replace("_key", "^[^=]*=", "")).cast(kind).alias(by), "ring", "area")


def dissolved(polygons: DataFrame, by: str = "f_type", rings: str = "rings", **how) -> DataFrame:
    """The union of all polygons of each class, as rings."""
    return overlay(directed(polygons, by, rings), by=by, **how)


def mended(polygons: DataFrame, key: str, rings: str = "rings", **how) -> DataFrame:
    """Valid rings of each polygon, whatever crosses or touches in it: the inside is what an odd number of windings surrounds."""
    every = polygons.select(key, F.explode(rings).alias("ring")).select(key, plain(F.col("ring")).alias("ring")).filter(F.size("ring") > 3)
    shut = F.when(F.element_at("ring", 1) == F.element_at("ring", -1), F.col("ring")).otherwise(F.concat("ring", F.slice("ring", 1, 1)))
    return overlay(every.withColumn("ring", shut), how="odd", by=key, **how)


def _strips(row: np.ndarray, p: np.ndarray, distance: np.ndarray, shut: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, length, points): closed counter-clockwise pieces to the right of lines (to the left if ``distance`` is negative) that make up their offsets.

    ``row`` tells the line of each point, ``distance`` that of each line. One that is not shut goes on by the distance at both ends.
    """
    same = row[:-1] == row[1:]
    stay = np.ones(len(row), bool)
    stay[1:] = ~same | (p[1:] != p[:-1]).any(1)
    row, p = row[stay], p[stay].copy()
    side = np.flatnonzero(row[:-1] == row[1:])  # sides by their first point
    if not len(side):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 2))
    of = row[side]
    first, last = np.flatnonzero(np.diff(of, prepend=-1)), np.flatnonzero(np.diff(of, append=-1))
    d = p[side + 1] - p[side]
    if not shut:
        unit = d / np.hypot(d[:, 0], d[:, 1])[:, None] * np.abs(distance[of])[:, None]
        p[side[first]] -= unit[first]
        p[side[last] + 1] += unit[last]
        d = p[side + 1] - p[side]
    u = d / np.hypot(d[:, 0], d[:, 1])[:, None]
    out = np.stack([u[:, 1], -u[:, 0]], 1) * distance[of][:, None]
    a, b = p[side], p[side + 1]
    quads = np.stack([a, a + out, b + out, b], 1)
    j = np.arange(len(side))  # corners by the side that leaves them
    i = j - 1
    i[first] = last
    if not shut:
        j = np.delete(j, first)
        i = i[j]
    turn = u[i, 0] * u[j, 1] - u[i, 1] * u[j, 0]
    cos = u[i, 0] * u[j, 0] + u[i, 1] * u[j, 1]
    outwards = (turn * distance[of[j]] > 0) | ((turn == 0) & (cos < 0))
    i, j, cos = i[outwards], j[outwards], cos[outwards]
    mitred = np.sqrt(np.maximum((1 + cos) / 2, 0.0)) * MITRE >= 1
    q = p[side[j]]
    tip = (out[i] + out[j]) / np.where(mitred, 1 + cos, 1.0)[:, None]
    wedges = np.stack([q, q + out[i], q + tip, q + out[j]], 1)
    rings, rows = np.concatenate([quads, wedges]), np.concatenate([of, of[j]])
    there = np.ones((len(rings), 5), bool)
    there[len(quads) :, 2] = mitred
    inwards = distance[rows] < 0
    rings[inwards], there[inwards, :4] = rings[inwards, ::-1], there[inwards, 3::-1]
    return rows, there.sum(1), np.concatenate([rings, rings[:, :1]], 1)[there]


def strips(lines: DataFrame, distance: float | dict | str, by: str, column: str = "ring", shut: bool = True, inwards: bool = False) -> DataFrame:
    """(by, ring): pieces beside closed rings (or open lines), to the right by ``distance``, or to the left if ``inwards``.

    A dictionary has a distance for each value of ``by``, a text names a column. What has no distance has no pieces.
    """
    far = F.col(distance).cast("double") if isinstance(distance, str) else F.lit(None if isinstance(distance, dict) else float(distance)).cast("double")
    sign = -1.0 if inwards else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, points = points_of(batch.column(1))
            if isinstance(distance, dict):
                own = np.array([distance.get(name) or 0.0 for name in batch.column(0).to_pylist()], float)
            else:
                own = pc.fill_null(batch.column(2), 0.0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(length)), length)
            some = own[row] != 0
            rows, length, points = _strips(row[some], points[some], sign * own, shut)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists(length, points)], names=[by, "ring"])

    kind = lines.schema[by].dataType.simpleString()
    return dealt(lines.select(by, plain(F.col(column)).alias("ring"), far.alias("far"))).mapInArrow(run, f"`{by}` {kind}, ring {RING}")


def grown(rings: DataFrame, distance: float | dict, by: str = "f_type", **how) -> DataFrame:
    """Directed rings (by, ring) moved outwards by ``distance`` (of each class, if a dictionary) and dissolved by class."""
    return overlay(rings.select(by, "ring").unionByName(strips(rings, distance, by)), by=by, **how)


def shrunk(rings: DataFrame, distance: float | dict, by: str = "f_type", **how) -> DataFrame:
    """Directed rings (by, ring) moved inwards. Those that overlap within a class have to be dissolved before."""
    return overlay(rings.select(by, "ring"), strips(rings, distance, by, inwards=True), "difference", by, **how)


#: Distances out and back of each class. Fixed values.
CLASS_DISTANCES = {"crosswalk": (0.3, 0.25), "sidewalk": (0.3, 0.3), "road": (0.4, 0.4)}


def closed_by_class(polygons: DataFrame, distances: dict[str, tuple[float, float]] | None = None, by: str = "f_type", rings: str = "rings", **how) -> DataFrame:
    """Buffer, dissolve and erode by each class's distances: gaps of up to twice the first close. Other classes are left out."""
    both = distances or CLASS_DISTANCES
    known = polygons.filter(F.col(by).isin(*both))
    wide = table(grown(directed(known, by, rings), {k: out for k, (out, _) in both.items()}, by, **how))
    return shrunk(wide, {k: back for k, (_, back) in both.items()}, by, **how)


def merged_by_class(one: DataFrame, other: DataFrame, by: str = "f_type", rings: str = "rings", **how) -> DataFrame:
    """Two layers of polygons as one, dissolved by class."""
    return overlay(directed(one.select(by, rings), by, rings).unionByName(directed(other.select(by, rings), by, rings)), by=by, **how)


def line_buffers(lines: DataFrame, distance: float, key: str = "line_id", column: str = "pts", **how) -> DataFrame:
    """Rings around each line, square at its ends, mitred at its corners; a line without length has none."""
    pts = plain(F.col(column))
    both = lines.select(key, F.explode(F.array(pts, F.reverse(pts))).alias("ring"))
    return overlay(strips(both, distance, key, shut=False), by=key, **how)


def _surrounded(points: DataFrame, sides: DataFrame) -> DataFrame:
    """Those of ``points`` (id, hole, x, y) that lie in the ring ``id``, whose ``sides`` (id, ax, ay, bx, by_) are rows of their own.

    The way from the far west goes along the line between two rows of cells and then straight up to the point. Sides that
    cross the line are counted in the order of x for all points of a row, those that cross the rest within a cell.
    """
    line = lambda k: (F.col(k) + LINE) * CELL
    row = lambda y: F.floor(y / CELL - LINE)
    asked = points.withColumn("k", row(F.col("y"))).withColumn("c", F.floor(F.col("x") / CELL))
    lo, hi = F.least("ay", "by_"), F.greatest("ay", "by_")
    over = sides.withColumn("k", F.explode(F.sequence(row(lo), row(hi)))).filter((lo <= line("k")) & (line("k") < hi))
    nothing = F.lit(None).cast("long")
    crossed = over.select("id", "k", (F.col("ax") + (F.col("bx") - F.col("ax")) * ((line("k") - F.col("ay")) / (F.col("by_") - F.col("ay")))).alias("x"), nothing.alias("hole"), F.lit(1).alias("n"))
    every = crossed.unionByName(asked.select("id", "k", "x", "hole", F.lit(0).alias("n")))
    before = Window.partitionBy("id", "k").orderBy("x", F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    west = every.withColumn("n", F.sum("n").over(before)).filter("hole is not null").select("id", "hole", "n")
    least, most = F.least("ax", "bx"), F.greatest("ax", "bx")
    at = lambda x: F.col("ay") + (F.col("by_") - F.col("ay")) * ((x - F.col("ax")) / (F.col("bx") - F.col("ax")))
    columns = sides.filter("ax != bx").withColumn("c", F.explode(F.sequence(F.floor(least / CELL), F.floor(most / CELL))))
    columns = columns.withColumns({"_p": at(F.greatest(least, F.col("c") * CELL)), "_q": at(F.least(most, (F.col("c") + 1) * CELL))})
    cells = columns.withColumn("k", F.explode(F.sequence(row(F.least("_p", "_q") - 0.01), row(F.greatest("_p", "_q") + 0.01)))).drop("_p", "_q")
    below = (least <= F.col("x")) & (F.col("x") < most) & (at(F.col("x")) > line("k")) & (at(F.col("x")) < F.col("y"))
    up = asked.join(cells, ["id", "c", "k"]).filter(below).groupBy("id", "hole").agg(F.count(F.lit(1)).alias("m"))
    return west.join(up, ["id", "hole"], "left").filter((F.col("n") + F.coalesce("m", F.lit(0))) % 2 == 1).select("id", "hole")


def nested(rings: DataFrame, by: str = "f_type") -> DataFrame:
    """(by, rings, area): polygons, each an outer ring with its holes, of what ``overlay`` returns.

    A hole belongs to the smallest outer ring around it. Boxes of outer rings lie in at most four squares of a size that
    fits them, and holes look into the squares of all sizes, so nothing but near boxes meets. Rings do not travel with
    the holes in their boxes; their sides, a row each, meet them cell by cell.
    """
    span = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    known = rings.withColumn("id", F.monotonically_increasing_id())
    kept = table(known)
    shells = kept.filter("area > 0").select(F.col(by).alias("_k2"), "id", "area", span(F.array_min, "x").alias("w"), span(F.array_max, "x").alias("e"), span(F.array_min, "y").alias("s"), span(F.array_max, "y").alias("n"))
    shells = table(shells.withColumn("level", F.ceil(F.log2(F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s"), F.lit(1.0)))).cast("int")))
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / F.pow(F.lit(2.0), F.col("level"))), F.floor(F.col(hi) / F.pow(F.lit(2.0), F.col("level"))))
    boxed = shells.withColumn("cx", F.explode(cells("w", "e"))).withColumn("cy", F.explode(cells("s", "n")))
    levels = [r.level for r in shells.select("level").distinct().collect()]  # as many as sizes have powers of two
    a, b = F.get("ring", F.lit(0)), F.get("ring", F.lit(1))
    part = lambda c: a[c] + (b[c] - a[c]) * 0.382  # a point of a hole's first side that is no corner of others
    holes = kept.filter("area < 0").select(F.col(by).alias("_k"), F.col("id").alias("hole"), F.col("area").alias("hole_area"), part("x").alias("x"), part("y").alias("y"))
    placed = holes.withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level")))
    met = placed.withColumns({"cx": at("x"), "cy": at("y")}).join(boxed, ["level", "cx", "cy"])
    near = met.filter(F.col("_k").eqNullSafe(F.col("_k2")) & F.col("x").between(F.col("w"), F.col("e")) & F.col("y").between(F.col("s"), F.col("n")) & (F.col("area") > -F.col("hole_area")))
    pairs = table(near.select("id", "area", "hole", "x", "y"))
    corners = F.arrays_zip(F.slice("ring", 1, F.size("ring") - 1).alias("a"), F.slice("ring", 2, F.size("ring") - 1).alias("b"))
    asked = kept.filter("area > 0").join(pairs.select("id").distinct(), "id", "left_semi")
    sides = table(asked.select("id", F.explode(corners).alias("s")).select("id", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by_")))
    around = _surrounded(pairs.select("id", "hole", "x", "y"), sides).join(pairs.select("id", "hole", "area"), ["id", "hole"])
    owner = around.groupBy("hole").agg(F.min_by("id", F.struct("area", "id")).alias("owner"))
    owned = kept.filter("area < 0").join(owner, F.col("id") == F.col("hole")).groupBy("owner").agg(F.collect_list("ring").alias("holes"), F.sum("area").alias("less"))
    return kept.filter("area > 0").join(owned, F.col("id") == F.col("owner"), "left").select(by, F.concat(F.array("ring"), F.coalesce("holes", F.array().cast(f"array<{RING}>"))).alias("rings"), (F.col("area") + F.coalesce("less", F.lit(0.0))).alias("area"))
