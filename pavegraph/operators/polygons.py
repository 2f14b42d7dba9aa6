"""Iterative polygon kernels, run on Arrow batches of whole geometries; each geometry is bounded by itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.storage import dealt
from .arrangement import distinct, runs

#: Rings of more points than this are gone through alone.
SHORT = 64
POINT = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])


def _with(df: DataFrame, column: str, fields: dict[str, object], kernel: Callable[[np.ndarray], tuple | None]) -> DataFrame:
    """``df`` with the kernel's values for an array of points; null where there is none.

    A kernel that does many arrays of a batch at once has that as its attribute ``together``.
    Rows are dealt out over all cores before the first of several kernels.
    """
    out = StructType([*df.schema.fields, *(StructField(n, t) for n, t in fields.items())])
    at, names, n = df.columns.index(column), [*df.columns, *fields], len(fields)
    types = [pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])) if isinstance(t, ArrayType) else pa.float64() for t in fields.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            flat = column.flatten()
            xy = np.stack([pc.struct_field(flat, c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y")], 1)
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
            ends = np.cumsum(size)
            rings = [xy[b - k : b] for b, k in zip(ends.tolist(), size.tolist())]
            rows = [row or (None,) * n for row in (kernel.together(rings) if hasattr(kernel, "together") else map(kernel, rings))]
            columns = [_lists(c) if pa.types.is_list(t) else pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * n, types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    found = (df if getattr(df, "_dealt", False) else dealt(df)).mapInArrow(run, out)
    found._dealt = True
    return found


def _lists(lines: tuple) -> pa.ListArray:
    """Arrays of points as a column; None is null."""
    known = [line for line in lines if line is not None]
    ends = np.cumsum([0, *(0 if line is None else len(line) for line in lines)])
    xy = np.concatenate([np.empty((0, 2)), *known])
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["x", "y"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), points, mask=pa.array([line is None for line in lines], pa.bool_()))


def hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull counter-clockwise, without collinear ones."""
    p = sorted(set(map(tuple, xy.tolist())))
    if len(p) < 3:
        return np.array(p, float).reshape(-1, 2)

    def chain(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for x, y in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= 0:
                out.pop()
            out.append((x, y))
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def hulls(rings: list[np.ndarray]) -> list[np.ndarray]:
    """``hull`` of each of many rings: those of up to SHORT points are gone through together, a point of every ring at a time."""
    out = [hull(xy) if len(xy) > SHORT else np.empty((0, 2)) for xy in rings]
    few = [k for k, xy in enumerate(rings) if 0 < len(xy) <= SHORT]
    if not few:
        return out
    rows = np.column_stack([np.repeat(np.arange(len(few)), [len(rings[k]) for k in few]), np.concatenate([rings[k] for k in few])])
    order, first, _ = distinct(rows)
    rows = rows[order[first]]
    of, p = rows[:, 0].astype(np.int64), rows[:, 1:]
    n = np.bincount(of, minlength=len(few))
    begin, every = np.cumsum(n) - n, np.arange(len(few))
    chains = []
    for back in (False, True):
        line, top = np.zeros((len(few), int(n.max()), 2)), np.zeros(len(few), np.int64)
        for k in range(int(n.max())):
            row = every[n > k]
            q = p[begin[row] + (n[row] - 1 - k if back else k)]
            todo = np.flatnonzero(top[row] > 1)
            while len(todo):
                a, b, c = line[row[todo], top[row[todo]] - 2], line[row[todo], top[row[todo]] - 1], q[todo]
                bent = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
                todo = todo[bent <= 0]
                top[row[todo]] -= 1
                todo = todo[top[row[todo]] > 1]
            line[row, top[row]] = q
            top[row] += 1
        chains.append((line, top - 1))
    for j, k in enumerate(few):
        out[k] = np.concatenate([line[j, : top[j]] for line, top in chains]) if n[j] > 2 else p[begin[j] : begin[j] + n[j]]
    return out


def area(xy: np.ndarray) -> float:
    """Signed area of a ring, closed or not."""
    return float((xy[:, 0] * np.roll(xy[:, 1], -1) - np.roll(xy[:, 0], -1) * xy[:, 1]).sum() / 2)


def rotated_boxes(rings: list[np.ndarray]) -> list[np.ndarray | None]:
    """Corners of the least box of any angle around each ring; one of its sides lies on a side of the hull.

    Hulls of as many corners each are gone through together.
    """
    out: list = [None] * len(rings)
    corners_of = hulls(rings)
    of_size: dict[int, list[int]] = {}
    for k, h in enumerate(corners_of):
        if len(h) > 2:
            of_size.setdefault(len(h), []).append(k)
    for rows in of_size.values():
        h = np.stack([corners_of[k] for k in rows])
        d = np.roll(h, -1, 1) - h
        u = d / np.hypot(d[..., 0], d[..., 1])[..., None]
        w = np.stack([-u[..., 1], u[..., 0]], -1)
        along, across = h @ u.transpose(0, 2, 1), h @ w.transpose(0, 2, 1)
        a, b, c, e = along.min(1), along.max(1), across.min(1), across.max(1)
        size = (b - a) * (e - c)
        one = np.arange(len(rows)), (size <= size.min(1, keepdims=True) + 1e-12).argmax(1)
        corners = [u[one] * s[one][:, None] + w[one] * t[one][:, None] for s, t in ((a, c), (b, c), (b, e), (a, e))]
        for k, box in zip(rows, np.stack(corners, 1)):
            out[k] = box
    return out


def rotated_box(xy: np.ndarray) -> np.ndarray | None:
    """Corners of the least box of any angle around a ring; one of its sides lies on a side of the hull."""
    return rotated_boxes([xy])[0]


def circle(xy: np.ndarray) -> tuple[float, float, float] | None:
    """The least circle around points: it rests on two or three corners of the hull."""
    h = hull(xy)
    if not len(h):
        return None
    c, r = h[0], 0.0
    order = np.random.default_rng(0).permutation(len(h))
    inside = lambda q: np.hypot(*(q - c)) <= r + 1e-9 * (1 + r)
    for i, p in enumerate(h[order]):
        if inside(p):
            continue
        c, r = p, 0.0
        for j, q in enumerate(h[order[:i]]):
            if inside(q):
                continue
            c, r = (p + q) / 2, np.hypot(*(p - q)) / 2
            for s in h[order[:j]]:
                if inside(s):
                    continue
                a, b = q - p, s - p
                d = 2 * (a[0] * b[1] - a[1] * b[0])
                if abs(d) > 1e-12:
                    c = p + np.array([b[1] * (a @ a) - a[1] * (b @ b), a[0] * (b @ b) - b[0] * (a @ a)]) / d
                    r = np.hypot(*(c - p))
    return float(c[0]), float(c[1]), float(r)


def hulls_and_boxes(df: DataFrame, column: str = "ring") -> DataFrame:
    """Adds hull_area, box_area and box_perimeter; null for rings without area."""
    def kernel(xy: np.ndarray) -> tuple | None:
        box = rotated_box(xy)
        if box is None:
            return None
        sides = np.hypot(*(box[1] - box[0])), np.hypot(*(box[2] - box[1]))
        return abs(area(hull(xy))), float(sides[0] * sides[1]), float(2 * (sides[0] + sides[1]))

    return _with(df, column, {"hull_area": DoubleType(), "box_area": DoubleType(), "box_perimeter": DoubleType()}, kernel)


def _closed(xy: np.ndarray) -> np.ndarray:
    return np.concatenate([xy, xy[:1]])


def hull_rings(df: DataFrame, column: str = "ring") -> DataFrame:
    """Adds ``hull``, the closed ring of the convex hull; null for rings without area."""
    def kernel(xy: np.ndarray) -> tuple | None:
        return kernel.together([xy])[0]

    kernel.together = lambda rings: [(_closed(h),) if len(h) > 2 else None for h in hulls(rings)]
    return _with(df, column, {"hull": ArrayType(POINT)}, kernel)


def box_rings(df: DataFrame, column: str = "ring") -> DataFrame:
    """Adds ``box``, the closed ring of the least box of any angle; null for rings without area."""
    def kernel(xy: np.ndarray) -> tuple | None:
        box = rotated_box(xy)
        return None if box is None else (_closed(box),)

    return _with(df, column, {"box": ArrayType(POINT)}, kernel)


def enclosing_circles(df: DataFrame, column: str = "ring") -> DataFrame:
    """Adds the centre and radius of the least circle around the points."""
    return _with(df, column, {"centre_x": DoubleType(), "centre_y": DoubleType(), "radius": DoubleType()}, circle)


def mid_axes_of(rings: list[np.ndarray]) -> list[tuple[float, float, float, float] | None]:
    """Of each ring the line between the middles of the two shorter sides of the least box, lower end first."""
    boxes = rotated_boxes(rings)
    known = [k for k, box in enumerate(boxes) if box is not None]
    out: list = [None] * len(rings)
    if known:
        box = np.stack([boxes[k] for k in known])
        d = np.roll(box, -1, 1) - box
        first = np.where(np.hypot(d[:, 0, 0], d[:, 0, 1]) <= np.hypot(d[:, 1, 0], d[:, 1, 1]), 0, 1)
        every = np.arange(len(box))
        middles = [(box[every, first + k] + box[every, (first + k + 1) % 4]) / 2 for k in (0, 2)]
        for k, *ends in zip(known, middles[0].tolist(), middles[1].tolist()):
            a, b = sorted(ends, key=lambda p: (round(p[0], 9), round(p[1], 9)))
            out[k] = (a[0], a[1], b[0], b[1])
    return out


def mid_axis(xy: np.ndarray) -> tuple[float, float, float, float] | None:
    """The line between the middles of the two shorter sides of the least box, lower end first."""
    return mid_axes_of([xy])[0]


mid_axis.together = mid_axes_of


def mid_axes(df: DataFrame, column: str = "ring") -> DataFrame:
    """Adds ax, ay, bx, by_ of each ring's mid axis."""
    return _with(df, column, {"ax": DoubleType(), "ay": DoubleType(), "bx": DoubleType(), "by_": DoubleType()}, mid_axis)


def simplest(length: np.ndarray, points: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """Which points of lines (``length`` of them a line, one after another) Douglas-Peucker keeps, so that each line is at most its ``tolerance`` away.

    All parts of all lines are split at once, at their farthest points.
    """
    ends = np.cumsum(length)
    i, j, far = ends - length, ends - 1, tolerance
    i, j, far = i[length > 0], j[length > 0], far[length > 0]
    keep = np.zeros(len(points), bool)
    keep[i] = keep[j] = True
    while True:
        wide = j - i > 1
        i, j, far = i[wide], j[wide], far[wide]
        if not len(i):
            return keep
        n = j - i - 1
        of, inner, first = np.repeat(np.arange(len(n)), n), runs(i + 1, n), np.cumsum(n) - n
        d, p = points[j] - points[i], points[inner] - points[i][of]
        square = (d * d).sum(1)
        t = np.clip((p * d[of]).sum(1) / np.where(square > 0, square, 1.0)[of], 0, 1)
        off = p - t[:, None] * d[of]
        away = np.hypot(off[:, 0], off[:, 1])
        most = np.maximum.reduceat(away, first)
        at = np.flatnonzero(away == most[of])
        k = inner[at[np.diff(of[at], prepend=-1) > 0]]
        over = most > far
        k = k[over]
        keep[k] = True
        i, j, far = np.concatenate([i[over], k]), np.concatenate([k, j[over]]), np.tile(far[over], 2)


def simplify(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: the fewest of its points from which the line is at most ``tolerance`` away; ends stay."""
    return xy[simplest(np.array([len(xy)]), xy, np.array([float(tolerance)]))]


def simplified(df: DataFrame, tolerance: float, column: str = "pts") -> DataFrame:
    """Adds ``simple``: the line with fewer points."""
    return _with(df, column, {"simple": ArrayType(POINT)}, lambda xy: (simplify(xy, tolerance),))


def drop_collinear(xy: np.ndarray, degrees: float) -> np.ndarray:
    """A closed ring without vertices at which it turns by at most ``degrees``."""
    p = xy[:-1] if len(xy) > 1 and (xy[0] == xy[-1]).all() else xy
    if len(p) < 4:
        return xy
    a, b = p - np.roll(p, 1, 0), np.roll(p, -1, 0) - p
    angle = np.degrees(np.arctan2(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0], (a * b).sum(1)))
    q = p[np.abs(angle) > degrees]
    return np.concatenate([q, q[:1]]) if len(q) > 2 else xy


def straightened(df: DataFrame, degrees: float, column: str = "ring") -> DataFrame:
    """Adds ``simple``: the ring without near-collinear vertices."""
    return _with(df, column, {"simple": ArrayType(POINT)}, lambda xy: (drop_collinear(xy, degrees),))


def offset(xy: np.ndarray, distance: float) -> np.ndarray | None:
    """A convex ring moved out (or in) by ``distance`` with mitred corners; null if nothing is left."""
    h = hull(xy)
    if len(h) < 3:
        return None
    d = np.roll(h, -1, 0) - h
    n = np.stack([d[:, 1], -d[:, 0]], 1) / np.hypot(*d.T)[:, None]
    c = (h * n).sum(1) + distance
    out = []
    for k in range(len(h)):
        (a, b), (u, v) = n[k - 1], n[k]
        det = a * v - b * u
        out.append(((c[k - 1] * v - c[k] * b) / det, (a * c[k] - u * c[k - 1]) / det))
    ring = np.array(out)
    turned = (np.roll(ring, -1, 0) - ring) * d
    return None if distance < 0 and (turned.sum(1) <= 0).any() else np.concatenate([ring, ring[:1]])


def buffered(df: DataFrame, distance: float, column: str = "ring") -> DataFrame:
    """Adds ``moved``: the convex ring's buffer with mitred corners."""
    def kernel(xy: np.ndarray) -> tuple | None:
        ring = offset(xy, distance)
        return None if ring is None else (ring,)

    return _with(df, column, {"moved": ArrayType(POINT)}, kernel)
