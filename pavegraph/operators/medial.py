"""Centrelines by the medial axis: Voronoi edges of points along the outline, inner ones, with short spurs pruned.

Points along an outline are triangulated one after another (each replaces the triangles whose circles hold it), those of
many outlines at a time. Centres of
neighbouring circles within the polygon are the edges of its medial axis. Branches that only lead into a corner are no
longer than their junction is away from the outline, by a factor, and go.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import dealt, table
from . import centerlines, overlay, polygons
from .arrangement import chained, distinct, portions, runs

#: A spur goes if it is at most this many times as long as its junction is away from the outline; a right corner has 1.42.
SPUR = 1.6
#: Points along an outline, at most: longer outlines are sampled more widely.
POINTS = 600
#: Least area of what erosion leaves of a crosswalk. Fixed value.
ERODED_LEAST = 2.0
#: Points that are triangulated together.
TOGETHER = 65_536
LINE = "array<struct<x:double,y:double>>"


def outlines(size: np.ndarray, points: np.ndarray, spacing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, points): corners of closed rings with points between them, about ``spacing`` apart, in general position.

    Points of all rings follow each other, ``size`` of them a ring.
    """
    begins = np.ones(len(points), bool)
    begins[np.cumsum(size) - 1] = False  # the last point of a ring is its first one
    side = np.flatnonzero(begins)
    of = np.repeat(np.arange(len(size)), size)[side]
    d = points[side + 1] - points[side]
    length = np.hypot(d[:, 0], d[:, 1])
    some = length > 0
    side, of, d, length = side[some], of[some], d[some], length[some]
    gap = np.maximum(spacing, np.bincount(of, length, len(size)) / POINTS)
    n = np.maximum(1, np.ceil(length / gap[of])).astype(np.int64)
    which = np.repeat(np.arange(len(n)), n)
    p = points[side[which]] + d[which] * (runs(np.zeros_like(n), n) / n[which])[:, None]
    count = np.bincount(of, n, len(size)).astype(np.int64)
    moved = np.random.default_rng(0).uniform(-1e-5, 1e-5, (int(count.max(initial=0)), 2))
    return count, p + moved[runs(np.zeros_like(count), count)] * np.repeat(spacing, count)[:, None]


@functools.lru_cache(1 << 12)
def _order(n: int) -> np.ndarray:
    """The order in which n points are triangulated."""
    return np.random.default_rng(1).permutation(n)


def _together(n: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set, triangle, centre, squared radius) of sets of ``n`` points in general position that fall in size.

    A row of the arrays is a set, a column a triangle, and squared radii of -1 are free; a point of every set is put in
    at a time.
    """
    base = np.cumsum(n + 3) - (n + 3)
    q = np.empty((int((n + 3).sum()), 2))
    orders = np.zeros((len(n), max(int(n.max(initial=0)), 1)), np.int64)
    some = np.flatnonzero(n)
    if len(some):
        begin = (np.cumsum(n) - n)[some]
        low, high = np.minimum.reduceat(points, begin), np.maximum.reduceat(points, begin)
        q[runs(base, n)] = points
        wide = np.maximum((high - low).max(1), 1e-9)
        around = np.array([(-40.0, -30.0), (40.0, -30.0), (0.0, 50.0)])
        q[(base + n)[some, None] + np.arange(3)] = ((low + high) / 2)[:, None] + wide[:, None, None] * around
    for k in some.tolist():
        orders[k, : n[k]] = _order(int(n[k]))
    room, far = 2 * int(n.max(initial=0)) + 8, int(n.max(initial=0)) + 3
    shape = (len(n), room)
    tri, born = np.zeros((*shape, 3), np.int64), np.zeros(shape, np.int64)
    x, y, r2 = np.zeros(shape), np.zeros(shape), np.full(shape, -1.0)
    used = np.ones(len(n), np.int64)

    def put(row: np.ndarray, slot: np.ndarray, t: np.ndarray) -> None:
        a, b, c = (q[base[row] + t[:, i]] for i in range(3))
        b, c = b - a, c - a
        det = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
        bb, cc = (b * b).sum(1), (c * c).sum(1)
        o = np.stack([c[:, 1] * bb - b[:, 1] * cc, b[:, 0] * cc - c[:, 0] * bb], 1) / det[:, None]
        tri[row, slot] = t
        x[row, slot], y[row, slot], r2[row, slot] = a[:, 0] + o[:, 0], a[:, 1] + o[:, 1], (o * o).sum(1)

    put(some, np.zeros(len(some), np.int64), n[some, None] + np.arange(3))
    for k in range(int(n.max(initial=0))):
        rows = int(np.searchsorted(-n, -k, "left"))  # those that have a point left
        wide = int(used[:rows].max())
        point = orders[:rows, k]
        at = q[base[:rows] + point]
        dx, dy = x[:rows, :wide] - at[:, :1], y[:rows, :wide] - at[:, 1:]
        dx *= dx
        dy *= dy
        dx += dy
        row, slot = np.divmod(np.flatnonzero(dx < r2[:rows, :wide]), wide)
        t = tri[row, slot]
        a, b = t.ravel(), t[:, [1, 2, 0]].ravel()
        code = np.sort((np.repeat(row, 3) * far + np.minimum(a, b)) * far + np.maximum(a, b))
        once = np.ones(len(code), bool)
        once[1:] &= code[1:] != code[:-1]
        once[:-1] &= code[1:] != code[:-1]
        rest, high = np.divmod(code[once], far)
        of, low = np.divmod(rest, far)
        r2[row, slot] = -1.0
        less, more = np.bincount(row, minlength=rows), np.bincount(of, minlength=rows)
        rank = np.arange(len(of)) - np.repeat(np.cumsum(more) - more, more)
        anew = rank >= less[of]
        place = used[of] + rank - less[of]
        place[~anew] = slot[((np.cumsum(less) - less)[of] + rank)[~anew]]
        used[:rows] += np.maximum(more - less, 0)
        if used[:rows].max() > x.shape[1]:
            pad = lambda arr, v=0: np.concatenate([arr, np.full((len(arr), room, *arr.shape[2:]), v, arr.dtype)], 1)
            tri, born, x, y, r2 = pad(tri), pad(born), pad(x), pad(y), pad(r2, -1.0)
        put(of, place, np.stack([low, high, point[of]], 1))
        born[of, place] = (k + 1) * far * far + rank
    row, slot = np.nonzero((r2 >= 0) & (tri < n[:, None, None]).all(2))
    order = np.lexsort((born[row, slot], row))
    row, slot = row[order], slot[order]
    return row, tri[row, slot], np.stack([x[row, slot], y[row, slot]], 1), r2[row, slot]


def delaunays(sets: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(triangles, centres, squared radii) of each set of points in general position; sets of about as many points each are triangulated together."""
    out: list = [None] * len(sets)
    by_size = sorted(range(len(sets)), key=lambda k: -len(sets[k]))
    while by_size:
        some = by_size[: max(1, TOGETHER // max(len(sets[by_size[0]]), 1))]
        del by_size[: len(some)]
        row, *found = _together(np.array([len(sets[k]) for k in some]), np.concatenate([sets[k] for k in some]))
        cuts = np.searchsorted(row, np.arange(1, len(some)))
        for k, *own in zip(some, *(np.split(f, cuts) for f in found)):
            out[k] = tuple(own)
    return out


def delaunay(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(triangles, centres, squared radii) of points in general position."""
    return delaunays([p])[0]


def _within(at: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which points lie in the ring ``row``, whose sides (a, b) are ``count`` from ``first`` on."""
    odd = np.zeros(len(at), bool)
    for lo, hi in portions(count[row]):
        i, j = np.repeat(np.arange(lo, hi), count[row[lo:hi]]), runs(first[row[lo:hi]], count[row[lo:hi]])
        up = (a[j, 1] > at[i, 1]) != (b[j, 1] > at[i, 1])
        i, j = i[up], j[up]
        d = b[j] - a[j]
        east = at[i, 0] < a[j, 0] + (at[i, 1] - a[j, 1]) * d[:, 0] / d[:, 1]
        odd[lo:hi] = np.bincount(i[east] - lo, minlength=hi - lo) % 2 == 1
    return odd


def _ways(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, member, closed, node, degree): the ways between ends and junctions of a graph of edges (a, b), in both directions.

    A way is the half-edges ``member`` from ``first`` on; half-edge k leaves from node k of a and b in a row. Loops are closed.
    """
    m = len(a)
    tail, head = np.concatenate([a, b]), np.concatenate([b, a])
    twin = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    degree = np.bincount(tail, minlength=n)
    order, first = np.argsort(tail, kind="stable"), np.cumsum(degree) - degree
    after = np.full(2 * m, -1)
    on = np.flatnonzero(degree[head] == 2)
    one, other = order[first[head[on]]], order[first[head[on]] + 1]
    after[on] = np.where(one == twin[on], other, one)
    line, member, closed = chained(after)
    return np.flatnonzero(np.diff(line, prepend=-1)), member, closed, tail, degree


def _pruned(a: np.ndarray, b: np.ndarray, nodes: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (a, b) without short spurs; of several at one junction the two longest stay if there would be nothing else."""
    while len(a):
        m = len(a)
        first, member, closed, node, degree = _ways(a, b, len(nodes))
        step = nodes[b] - nodes[a]
        length = np.add.reduceat(np.hypot(step[:, 0], step[:, 1])[member % m], first)
        last = np.append(first[1:], len(member)) - 1
        end = node[(member[last] + m) % (2 * m)]
        short = np.flatnonzero(~closed & (degree[node[member[first]]] == 1) & (degree[end] > 2) & (length <= SPUR * radii[end]))
        short = short[np.lexsort((length[short], end[short]))]
        begin = np.flatnonzero(np.diff(end[short], prepend=-1))
        count = np.diff(begin, append=len(short))
        longer = np.repeat(begin + count, count) - 1 - np.arange(len(short))
        gone = short[(degree[end[short]] > np.repeat(count, count)) | (longer > 1)]
        if not len(gone):
            break
        kept = np.ones(m, bool)
        kept[member[runs(first[gone], last[gone] + 1 - first[gone])] % m] = False
        a, b = a[kept], b[kept]
    return a, b


def _drawn_out(length: np.ndarray, points: np.ndarray, asked: np.ndarray, far: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines (length, points), of which those ``asked`` have their ends drawn out straight on to the ring ``row``; the direction is that of their last ``far`` units."""
    ends = np.cumsum(length)
    p = points[ends - 1]
    off = points - np.repeat(p, length, axis=0)
    wide = np.hypot(off[:, 0], off[:, 1]) >= np.repeat(far, length)
    back = np.maximum(np.maximum.reduceat(np.where(wide, np.arange(len(points)), -1), ends - length), ends - length)
    u = p - points[back]
    some = np.flatnonzero(asked & u.any(1))
    share = np.full(len(length), np.inf)
    ring = row[some]
    for lo, hi in portions(count[ring]):
        i, j = np.repeat(some[lo:hi], count[ring[lo:hi]]), runs(first[ring[lo:hi]], count[ring[lo:hi]])
        d, q = b[j] - a[j], a[j] - p[i]
        det = u[i, 0] * d[:, 1] - u[i, 1] * d[:, 0]
        cut = np.flatnonzero(det)
        i, d, q, det = i[cut], d[cut], q[cut], det[cut]
        t, s = (q[:, 0] * d[:, 1] - q[:, 1] * d[:, 0]) / det, (q[:, 0] * u[i, 1] - q[:, 1] * u[i, 0]) / det
        hit = (t > 0) & (s >= 0) & (s <= 1)
        np.minimum.at(share, i[hit], t[hit])
    met = np.flatnonzero(np.isfinite(share))
    return length + np.isfinite(share), np.insert(points, ends[met], p[met] + u[met] * share[met, None], axis=0)


def _reversed(length: np.ndarray, points: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return points[np.repeat(ends, length) - 1 - runs(np.zeros_like(length), length)]


def _centre_lines(size: np.ndarray, points: np.ndarray, spacing: np.ndarray, n: np.ndarray, p: np.ndarray, extend: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, length, points): lines of the medial axes of closed rings, whose ``outlines`` are (n, p) and fall in size.

    Nodes nearer than a hundredth of the spacing are one.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 2))
    row, tri, centre, r2 = _together(n, p)
    if not len(tri):
        return none
    sides = np.delete(np.arange(len(points)), np.cumsum(size) - 1)
    ring = points[sides], points[sides + 1], np.cumsum(size - 1) - (size - 1), size - 1
    inner = _within(centre, row, *ring)
    tri = tri + (np.cumsum(n) - n)[row][:, None]
    edges = np.sort(np.concatenate([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]]), axis=1)
    code = edges[:, 0] * len(p) + edges[:, 1]
    owner = np.tile(np.arange(len(tri)), 3)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    two = np.flatnonzero(code[:-1] == code[1:])
    a, b = owner[two], owner[two + 1]
    both = inner[a] & inner[b]
    place = np.column_stack([row, np.rint(centre / (spacing / 100)[row, None]).astype(np.int64)])
    _, first, name = distinct(place)
    nodes, radii, of = np.zeros((len(first), 2)), np.zeros(len(first)), np.zeros(len(first), np.int64)
    nodes[name], radii[name], of[name] = centre, np.sqrt(r2), row
    a, b = name[a[both]], name[b[both]]
    code = np.unique((np.minimum(a, b) * len(nodes) + np.maximum(a, b))[a != b])
    a, b = _pruned(*np.divmod(code, len(nodes)), nodes, radii)
    if not len(a):
        return none
    m = len(a)
    first, member, closed, node, degree = _ways(a, b, len(nodes))
    count = np.diff(first, append=len(member))
    for k in np.flatnonzero(closed).tolist():  # loops begin with their least node
        own = member[first[k] : first[k] + count[k]]
        member[first[k] : first[k] + count[k]] = np.roll(own, -int(node[own].argmin()))
    head = (member + m) % (2 * m)
    start, then = node[member[first]], node[head[first]]
    same = np.minimum.reduceat(member % m, first)  # both directions have the same edges
    order = np.lexsort((then, start, same))
    one = order[::2]
    one = one[np.lexsort((then[one], start[one], closed[one], of[start[one]]))]
    row, length = of[start[one]], count[one] + 1
    at = np.insert(node[head[runs(first[one], count[one])]], np.cumsum(count[one]) - count[one], start[one])
    free = degree[at] == 1
    ends = np.cumsum(length)
    free_start, free_end = free[ends - length], free[ends - 1]
    points_ = nodes[at]
    kept = polygons.simplest(length, points_, spacing[row] / 4)
    length, points_ = np.add.reduceat(kept.astype(np.int64), ends - length), points_[kept]
    if extend:
        for asked in (free_end, free_start):
            length, points_ = _drawn_out(length, points_, asked, 4 * spacing[row], row, *ring)
            points_ = _reversed(length, points_)
    return row, length, points_


def centre_lines_of(size: np.ndarray, points: np.ndarray, spacing: np.ndarray, extend: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, length, points): centrelines of closed rings; ``size`` points a ring, and ``length`` a line, follow each other.

    Rings of about as many points along the outline are gone through together: all steps are ones on arrays. A ring
    without any centreline, like a square, has the line between the middles of its shorter sides.
    """
    n, p = outlines(size, points, spacing)
    order = np.argsort(-n, kind="stable")
    first, begin = np.cumsum(n) - n, np.cumsum(size) - size
    rows, lengths, lines, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty((0, 2))], 0
    while at < len(order):
        some = order[at : at + max(1, TOGETHER // max(int(n[order[at]]), 1))]
        at += len(some)
        row, length, pts = _centre_lines(size[some], points[runs(begin[some], size[some])], spacing[some], n[some], p[runs(first[some], n[some])], extend)
        rows.append(some[row])
        lengths.append(length)
        lines.append(pts)
    rest = np.setdiff1d(order, np.concatenate(rows))
    middles = polygons.mid_axes_of([points[begin[k] : begin[k] + size[k]] for k in rest.tolist()])
    known = [k for k, middle in enumerate(middles) if middle is not None]
    rows.append(rest[known])
    lengths.append(np.full(len(known), 2))
    lines.append(np.array([middles[k] for k in known], float).reshape(-1, 2))
    row, length = np.concatenate(rows), np.concatenate(lengths)
    order = np.argsort(row, kind="stable")
    return row[order], length[order], np.concatenate(lines)[runs((np.cumsum(length) - length)[order], length[order])]


def centre_lines(ring: np.ndarray, spacing: float, extend: bool = False) -> list[np.ndarray]:
    """Centrelines of one closed ring."""
    _, length, points = centre_lines_of(np.array([len(ring)]), ring, np.array([float(spacing)]), extend)
    return np.split(points, np.cumsum(length)[:-1]) if len(length) else []


def medial_lines(layer: DataFrame, key: str = "geom_id", spacing: str | float = 0.5, extend: bool = False, ring: str = "ring", more: tuple[str, ...] = ()) -> DataFrame:
    """(key, part, pts) and the columns ``more``: the centrelines of rings; ``spacing`` of points along the outline may be a column's name.

    Rings of less than three sides have none. A polygon is a value; its triangulation is done in its task.
    """
    step = F.col(spacing) if isinstance(spacing, str) else F.lit(float(spacing))
    narrow = layer.select(key, overlay.plain(F.col(ring)).alias("ring"), step.cast("double").alias("gap"), *more)
    names = [key, "part", "pts", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, points = overlay.points_of(batch.column(1))
            gap = pc.fill_null(batch.column(2), 0.0).to_numpy(zero_copy_only=False)
            some = np.flatnonzero((size > 3) & (gap != 0))
            begin = np.cumsum(size) - size
            row, length, lines = centre_lines_of(size[some], points[runs(begin[some], size[some])], gap[some], extend)
            at = pa.array(some[row])
            part = runs(np.zeros(len(some), np.int64), np.bincount(row, minlength=len(some)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(part, pa.int32()), overlay.lists(length, lines), *(batch.column(k).take(at) for k in range(3, 3 + len(more)))], names=names)

    kind = lambda c: f"`{c}` {narrow.schema[c].dataType.simpleString()}"
    tasks = int(layer.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small file is a lot of work here
    return narrow.repartition(tasks).mapInArrow(run, ", ".join([kind(key), "part int", f"pts {LINE}", *map(kind, more)]))


def crosswalk_lines(layer: DataFrame, key: str = "geom_id", convexity: float = centerlines.CONVEX) -> DataFrame:
    """(key, branch, pts): a line or more for each crosswalk polygon (key, ring) that is not skipped.

    Convex ones get the middle line of their least box; others are eroded by a quarter of their mean width, and the
    parts that are left, if large enough, get centrelines drawn out to their outline.
    """
    eroded = F.col("branch") == "erode"
    branches = centerlines.crosswalk_branches(layer, convexity).filter("branch <> 'skip'")
    found = table(branches.select(key, "branch", "erosion", "ax", "ay", "bx", "by_", F.when(eroded, F.array("ring")).alias("rings")))
    end = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    straight = found.filter("branch in ('middle', 'extend')").select(key, "branch", F.array(end("ax", "ay"), end("bx", "by_")).cast(LINE).alias("pts"))
    rings = overlay.directed(found.filter(eroded), key, "rings", "erosion")
    inner = overlay.overlay(rings, overlay.strips(rings, "erosion", key, inwards=True), "difference", key, cell=256.0)
    parts = inner.filter(F.col("area") > ERODED_LEAST).withColumn("gap", F.sqrt("area") / 12)
    return straight.unionByName(medial_lines(parts, key, "gap", True).select(key, F.lit("erode").alias("branch"), "pts"))


def sidewalk_lines(layer: DataFrame, key: str = "geom_id") -> DataFrame:
    """(key, branch, pts): centrelines of each sidewalk polygon (key, ring) that is not skipped, drawn out to the outline."""
    found = centerlines.sidewalk_branches(dealt(layer))  # those skipped have no spacing, and so no lines
    return medial_lines(found, key, "spacing", True, more=("branch",)).select(key, "branch", "pts")
