"""Cleaning the topology of line networks: lines are (line_id, pts) with pts an array of structs (x, y)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shape import line_length
from ..functions.storage import dealt
from .arrangement import distinct, portions, runs
from .components import SMALL_LINKS, components

EPSILON = 1e-6
#: Side of the cells in which rays are held against lines, at least, as a multiple of their length.
WIDE = 3.0
#: Pairs of ray and segment that are judged at once, and by how much of their length they may miss each other before they are judged exactly.
PAIRS, SLACK = 1 << 17, 1e-6
#: Segments in a bucket of cells, about, and cells along the side of a wide one, at most.
BUCKET_SIDES, MOST_WITHIN = 8_000, 16
#: Digits of rounded distances; how far apart places have to be for these not to change places; what divisions may be off by.
DIGITS, MARGIN, EXACT = 6, 4e-6, 1e-12
#: The part of a ray that is held against the cell it begins in, first.
BEGINNING = 1 / 32


def endpoints(lines: DataFrame) -> DataFrame:
    """(line_id, which, x, y): the two ends of each line."""
    ends = F.array(F.struct(F.lit("start").alias("which"), F.element_at("pts", 1).alias("p")), F.struct(F.lit("end").alias("which"), F.element_at("pts", -1).alias("p")))
    return lines.select("line_id", F.explode(ends).alias("e")).select("line_id", "e.which", "e.p.x", "e.p.y")


def node_degree(ends: DataFrame) -> DataFrame:
    """(x, y, degree) of each node."""
    return ends.groupBy("x", "y").agg(F.count(F.lit(1)).alias("degree"))


def free_ends(lines: DataFrame) -> DataFrame:
    """(line_id, start_free, end_free): ends that no other end touches; a closed line touches itself."""
    ends = endpoints(lines)
    marked = ends.join(node_degree(ends), ["x", "y"])
    free = lambda w: F.bool_or((F.col("which") == w) & (F.col("degree") == 1))
    return marked.groupBy("line_id").agg(free("start").alias("start_free"), free("end").alias("end_free"))


def drop_dangles(lines: DataFrame, island: float = 25.0, dangle: float = 18.0) -> DataFrame:
    """Lines but for short ones with both ends free (under ``island``) or one end free (under ``dangle``)."""
    known = lines.withColumn("length", line_length(F.col("pts"))).join(free_ends(lines), "line_id")
    both, one = F.col("start_free") & F.col("end_free"), F.col("start_free") != F.col("end_free")
    return known.filter(~(both & (F.col("length") < island)) & ~(one & (F.col("length") < dangle))).drop("start_free", "end_free")


def chains(lines: DataFrame) -> DataFrame:
    """(line_id, chain): lines joined through nodes of degree two have one chain, named by its smallest line."""
    ends = endpoints(lines)
    links = ends.groupBy("x", "y").agg(F.count(F.lit(1)).alias("degree"), F.min("line_id").alias("a"), F.max("line_id").alias("b")).filter("degree = 2 and a < b")
    roots = components(links.select("a", "b"), SMALL_LINKS)
    return lines.select("line_id").join(roots, lines["line_id"] == roots["node"], "left").select("line_id", F.coalesce("root", "line_id").alias("chain"))


def merge_chains(lines: DataFrame) -> DataFrame:
    """(chain, n_lines, length): what merging lines over false nodes leaves, by chain."""
    return lines.select("line_id", line_length(F.col("pts")).alias("length")).join(chains(lines), "line_id").groupBy("chain").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("length").alias("length"))


def extrapolated(ax: Column, ay: Column, bx: Column, by: Column, reach: Column | float) -> tuple[Column, Column]:
    """The point ``reach`` beyond b on the ray from a to b.

    The slope's parts get a small number added before the ratio is taken, so a ray along an axis still has a quadrant.
    """
    dx, dy = F.abs(bx - ax + EPSILON), F.abs(by - ay + EPSILON)
    angle = F.atan(dy / dx)
    step = lambda f, a, b: F.when(b >= a, reach * f(angle)).otherwise(-reach * f(angle))
    return bx + step(F.cos, ax, bx), by + step(F.sin, ay, by)


def lengthened(lines: DataFrame, ratio: float) -> DataFrame:
    """Lines with both ends moved out by the whole part of their length times ``ratio``."""
    reach = F.floor(line_length(F.col("pts")) * ratio).cast("double")
    p = lambda i, c: F.try_element_at("pts", F.lit(i))[c]
    sx, sy = extrapolated(p(2, "x"), p(2, "y"), p(1, "x"), p(1, "y"), reach)
    ex, ey = extrapolated(p(-2, "x"), p(-2, "y"), p(-1, "x"), p(-1, "y"), reach)
    return lines.select("line_id", F.concat(F.array(F.struct(sx.alias("x"), sy.alias("y"))), F.slice("pts", 2, F.greatest(F.size("pts") - 2, F.lit(0))), F.array(F.struct(ex.alias("x"), ey.alias("y")))).alias("pts"))


def segments(lines: DataFrame) -> DataFrame:
    """(line_id, seg, ax, ay, bx, by): the segments of each line."""
    steps = F.zip_with(F.slice("pts", 1, F.size("pts") - 1), F.slice("pts", 2, F.size("pts") - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    return lines.filter(F.size("pts") > 1).select("line_id", F.posexplode(steps).alias("seg", "s")).select("line_id", "seg", "s.*")


def crossings(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """(left_id, right_id, x, y): points in which segments of different lines cross, touching included, parallels not."""
    return _meetings(left, right, size).select("left_id", "right_id", "x", "y").distinct()


def _spread(df: DataFrame, size: float) -> DataFrame:
    """Segments with every cell (cx, cy) that they run through, column by column."""
    low, high, at = F.least("ax", "bx"), F.greatest("ax", "bx"), F.col("cx") * size
    cols = df.withColumn("cx", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    slope = (F.col("by") - F.col("ay")) / F.nullif(F.col("bx") - F.col("ax"), F.lit(0.0))
    y = lambda x: F.col("ay") + (x - F.col("ax")) * slope
    y1 = F.coalesce(y(F.greatest(low, at)), F.col("ay"))
    y2 = F.coalesce(y(F.least(high, at + size)), F.col("by"))
    slack = F.lit(1e-6 * size)  # a point on a cell's edge belongs to both
    return cols.withColumn("cy", F.explode(F.sequence(F.floor((F.least(y1, y2) - slack) / size), F.floor((F.greatest(y1, y2) + slack) / size))))


def _meetings(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Crossings with the start (x1, y1) of the left segment, some of them repeated.

    Segments are dealt into the cells they run through, column by column, and a pair is judged in each cell it shares.
    """
    l = _spread(segments(left), size).select(F.col("line_id").alias("left_id"), F.col("ax").alias("x1"), F.col("ay").alias("y1"), F.col("bx").alias("x2"), F.col("by").alias("y2"), "cx", "cy")
    r = _spread(segments(right), size).select(F.col("line_id").alias("right_id"), F.col("ax").alias("x3"), F.col("ay").alias("y3"), F.col("bx").alias("x4"), F.col("by").alias("y4"), "cx", "cy")
    met = l.join(r, ["cx", "cy"]).filter("left_id <> right_id")
    return _crossed(met)


def _crossed(met: DataFrame) -> DataFrame:
    """Pairs of segments (x1, y1)-(x2, y2) and (x3, y3)-(x4, y4) that meet, with the point; parallels do not."""
    c = F.col
    det = (c("x2") - c("x1")) * (c("y4") - c("y3")) - (c("y2") - c("y1")) * (c("x4") - c("x3"))
    t = ((c("x3") - c("x1")) * (c("y4") - c("y3")) - (c("y3") - c("y1")) * (c("x4") - c("x3"))) / c("det")
    u = ((c("x3") - c("x1")) * (c("y2") - c("y1")) - (c("y3") - c("y1")) * (c("x2") - c("x1"))) / c("det")
    met = met.withColumn("det", det).filter("det <> 0").withColumn("t", t).withColumn("u", u)
    return met.filter("t between 0 and 1 and u between 0 and 1").select("left_id", "right_id", F.round(c("x1") + c("t") * (c("x2") - c("x1")), 6).alias("x"), F.round(c("y1") + c("t") * (c("y2") - c("y1")), 6).alias("y"), "x1", "y1")


def _cells(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cx, cy): ``_spread`` on arrays."""
    low, high, slack = np.minimum(x1, x2), np.maximum(x1, x2), 1e-6 * size
    first = np.floor(low / size).astype(np.int64)
    count = np.floor(high / size).astype(np.int64) - first + 1
    row, cx = np.repeat(np.arange(len(x1)), count), runs(first, count)
    run = (x2 - x1)[row]
    upright = run == 0
    slope = (y2 - y1)[row] / np.where(upright, 1.0, run)
    at = y1[row] + (np.maximum(low[row], cx * size) - x1[row]) * slope
    to = np.where(upright, y2[row], y1[row] + (np.minimum(high[row], (cx + 1) * size) - x1[row]) * slope)
    first = np.floor((np.minimum(at, to) - slack) / size).astype(np.int64)
    count = np.floor((np.maximum(at, to) + slack) / size).astype(np.int64) - first + 1
    return np.repeat(row, count), np.repeat(cx, count), runs(first, count)


def _by_number(number: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, count): things by their number below ``n``; small numbers are sorted by digits."""
    count = np.bincount(number, minlength=n)
    return np.argsort(number.astype(np.uint16) if n <= 1 << 16 else number, kind="stable"), np.cumsum(count) - count, count


def _where(mask: np.ndarray) -> np.ndarray:
    """Places, row by row, where a mask is true; eight at a time, as it seldom is."""
    flat = mask.reshape(-1)
    whole = len(flat) // 8 * 8
    some = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.concatenate([some[flat[some]], whole + np.flatnonzero(flat[whole:])])


def _near_pairs(rays: np.ndarray, own: np.ndarray, ray_cell: np.ndarray, far: np.ndarray, sides: np.ndarray, other: np.ndarray, at: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, t): pairs of a ray, of which ``far`` is looked at, and a side of its cell that may decide where the ray first meets another line.

    Those are the pairs that meet as near as numbers tell, up to the first that is sure to, and a little beyond, where
    rounded distances may change places. Touches that are sure to have no distance are left out. Cells have their sides
    at ``at``, from ``first`` on, ``count`` of them.
    """
    x1, y1, dx, dy = rays
    x3, y3, ex, ey = sides
    length = np.hypot(dx, dy)
    whole = (np.round(x1, DIGITS) == x1) & (np.round(y1, DIGITS) == y1) & (np.abs(x1) < 1e8) & (np.abs(y1) < 1e8)
    least = np.where(whole, 0.4 * 10.0**-DIGITS / np.maximum(length, 1e-300), -np.inf)

    def met(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs those that meet, with the place along the ray and whether it is sure."""
        qx, qy = x3[j] - x1[i], y3[j] - y1[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            inverse = 1.0 / (dx[i] * ey[j] - dy[i] * ex[j])
            t, u = (qx * ey[j] - qy * ex[j]) * inverse, (qx * dy[i] - qy * dx[i]) * inverse
        ok = (t >= -SLACK) & (t <= far[i] + SLACK) & (u >= -SLACK) & (u <= 1 + SLACK) & (np.abs(t) >= least[i]) & (own[i] != other[j])
        i, j, t, u = i[ok], j[ok], t[ok], u[ok]
        return i, j, t, (t * length[i] > MARGIN) & (t < 1 - EXACT) & (u > EXACT) & (u < 1 - EXACT)

    def nearest(i: np.ndarray, j: np.ndarray, t: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        end = np.full(len(x1), np.inf)
        np.minimum.at(end, i[sure], t[sure])
        ok = t <= (end + MARGIN / np.maximum(length, 1e-300) + EXACT)[i]
        return i[ok], j[ok], t[ok]

    many = count[ray_cell]
    asked = np.bincount(ray_cell, minlength=len(first))
    large = (asked * count > PAIRS >> 5)[ray_cell]
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    small = np.flatnonzero(~large & (many > 0))
    small = small[np.argsort(ray_cell[small], kind="stable")]
    for lo, hi in portions(many[small], PAIRS):
        own_rows = small[lo:hi]
        found.append(nearest(*met(np.repeat(own_rows, many[own_rows]), at[runs(first[ray_cell[own_rows]], many[own_rows])])))
    rows = np.flatnonzero(large)
    rows = rows[np.argsort(ray_cell[rows], kind="stable")]
    begins = np.flatnonzero(np.diff(ray_cell[rows], prepend=-1))
    for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(rows)]):
        cell = ray_cell[rows[begin]]
        j = at[first[cell] : first[cell] + count[cell]]
        ox, oy = x1[rows[begin]], y1[rows[begin]]
        size = np.hypot(ex[j], ey[j])
        size[size == 0] = 1.0
        lines = np.stack([ey[j] / size, -ex[j] / size, ((y3[j] - oy) * ex[j] - (x3[j] - ox) * ey[j]) / size])
        reach = float(max(np.abs(x3[j] - ox).max(), np.abs(y3[j] - oy).max(), np.abs(ex[j]).max(), np.abs(ey[j]).max(), 1.0))
        step = max(1, PAIRS // len(j))
        for k in range(begin, end, step):
            i = rows[k : min(k + step, end)]
            px, py, one = x1[i] - ox, y1[i] - oy, np.ones(len(i))
            here = np.stack([px, py, one], 1) @ lines  # how far left of each side's line a ray begins
            there = np.stack([px + far[i] * dx[i], py + far[i] * dy[i], one], 1) @ lines
            here *= there
            a, b = np.divmod(_where(here <= 1e-12 * reach * max(reach, float(length[i].max()))), len(j))
            found.append(nearest(*met(i[a], j[b])))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _met_by_rays(rays: DataFrame, lines: DataFrame, size: float) -> DataFrame:
    """(left_id, right_id, x1, ..., y4): rays with those segments of other lines that they may meet first, as near as numbers tell.

    A line has a row for every wide cell that it goes through, about two a segment, so that few rows are shuffled. Whole
    cells are dealt into buckets, and within one into cells of ``size``. The beginning of a ray is held against all of
    the cell that it begins in; the whole of it, or as much as lies before what was found, against all others that it goes through.
    """
    sides = segments(lines).filter("line_id is not null")
    extent = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))).cast("double")
    n, mean = sides.agg(F.count(F.lit(1)), F.avg(F.when(extent < float("inf"), extent))).first()
    within = max(1, min(MOST_WITHIN, math.ceil((mean or 0.0) / size)))
    wide = within * size
    ends = [F.col(a).cast("double").alias(b) for a, b in (("ax", "x1"), ("ay", "y1"), ("bx", "x2"), ("by", "y2"))]
    l = _spread(segments(rays), wide).select("line_id.own", "line_id.which", *ends, "cx", "cy")
    ends = [F.col(a).cast("double").alias(b) for a, b in (("ax", "x3"), ("ay", "y3"), ("bx", "x4"), ("by", "y4"))]
    r = _spread(sides, wide).select(F.col("line_id").alias("right_id"), *ends, "cx", "cy")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """All cells of a bucket: small ones together, large ones one by one."""
        left, right = left.combine_chunks(), right.combine_chunks()
        col = lambda t, *names: [t.column(c).to_numpy() for c in names]
        ids = pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (left.column("own"), right.column("right_id"))])
        ids = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        own, other = ids[: left.num_rows], ids[left.num_rows :]
        cells = np.column_stack([np.concatenate(both) for both in zip(col(left, "cx", "cy"), col(right, "cx", "cy"))])
        order, begin, number = distinct(cells)
        cells = cells[order[begin]]
        (x1, y1, x2, y2), (x3, y3, x4, y4) = col(left, "x1", "y1", "x2", "y2"), col(right, "x3", "y3", "x4", "y4")
        dx, dy, ex, ey = x2 - x1, y2 - y1, x4 - x3, y4 - y3

        def small(of: np.ndarray, row: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(row, number) of the cells within the wide cell that a row stands for."""
            wx, wy = cells[of[row]].T
            ok = (cx // within == wx) & (cy // within == wy)
            return row[ok], ((of[row] * within + cx - wx * within) * within + cy - wy * within)[ok]

        of_rays, of_sides = number[: left.num_rows], number[left.num_rows :]
        side, place = small(of_sides, *_cells(x3, y3, x4, y4, size))

        def judged(row: np.ndarray, cell: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            asked, cell = np.unique(cell, return_inverse=True)
            which = np.searchsorted(asked, place)
            there = np.append(asked, -1)[which] == place
            order, first, count = _by_number(which[there], len(asked))
            i, j, t = _near_pairs((x1[row], y1[row], dx[row], dy[row]), own[row], cell, far, (x3, y3, ex, ey), other, side[there][order], first, count)
            return row[i], j, t

        every = np.arange(left.num_rows)
        begun, cell = small(of_rays, every, *(np.floor((a + d * BEGINNING / 2) / size).astype(np.int64) for a, d in ((x1, dx), (y1, dy))))
        i, j, t = judged(begun, cell, np.full(len(begun), BEGINNING))
        length = np.hypot(dx, dy)
        end = np.full(left.num_rows, 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            u = ((x3[j] - x1[i]) * dy[i] - (y3[j] - y1[i]) * dx[i]) / (dx[i] * ey[j] - dy[i] * ex[j])
        sure = (t * length[i] > MARGIN) & (t < BEGINNING) & (u > EXACT) & (u < 1 - EXACT)
        np.minimum.at(end, i[sure], (t + 2 * MARGIN / np.maximum(length[i], 1e-300))[sure])
        known = np.full(left.num_rows, -1)
        known[begun[end[begun] < BEGINNING]] = cell[end[begun] < BEGINNING]
        row, cell = small(of_rays, *_cells(x1, y1, np.where(end < 1, x1 + end * dx, x2), np.where(end < 1, y1 + end * dy, y2), size))
        new = known[row] != cell
        row, cell = row[new], cell[new]
        i2, j2, _ = judged(row, cell, end[row])
        kept = known[i] >= 0
        a, b = np.concatenate([i[kept], i2]), np.concatenate([j[kept], j2])
        a, b = left.drop(["cx", "cy", "bucket"]).take(pa.array(a)), right.drop(["cx", "cy", "bucket"]).take(pa.array(b))
        return pa.table([*a.columns, *b.columns], names=[*a.column_names, *b.column_names])

    kind = {c: r.schema["right_id"].dataType.simpleString() for c in ("own", "right_id")}
    schema = f"own {kind['own']}, which string, x1 double, y1 double, x2 double, y2 double, right_id {kind['right_id']}, x3 double, y3 double, x4 double, y4 double"
    several = max(n // BUCKET_SIDES, 4 * lines.sparkSession.sparkContext.defaultParallelism)
    l, r = (dealt(s.withColumn("bucket", F.pmod(F.xxhash64("cx", "cy"), F.lit(several))), "bucket", rows=2 * n) for s in (l, r))
    found = l.groupBy("bucket").cogroup(r.groupBy("bucket")).applyInArrow(meet, schema)
    return found.filter("own <> right_id").select(F.struct("own", "which").alias("left_id"), "right_id", *(f"{c}{k}" for k in range(1, 5) for c in "xy"))


def _rays(lines: DataFrame, reach: float) -> DataFrame:
    """(line_id, pts): the way ``reach`` ahead from each end that no other end touches; ``line_id`` has the line's own and which end it is."""
    p = lambda i: F.try_element_at("pts", F.lit(i))
    ends = [F.struct(F.lit(last).alias("last"), *(point[c].alias(f"{c}{k}") for k, point in enumerate((p(i), p(j))) for c in "xy")) for last, i, j in ((False, 1, 2), (True, -1, -2))]
    each = lines.select(F.col("line_id").alias("own"), F.explode(F.array(*ends)).alias("e")).select("own", "e.*")
    names = [c for c in each.columns if c not in ("x0", "y0")]
    # what an end that is alone at its place has is all that there is at the place
    alone = each.groupBy("x0", "y0").agg(F.count(F.lit(1)).alias("degree"), *(F.first(c).alias(c) for c in names)).filter("degree = 1 and own is not null and x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    x, y = extrapolated(F.col("x1"), F.col("y1"), F.col("x0"), F.col("y0"), F.lit(float(reach)))
    pts = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(x.alias("x"), y.alias("y")))
    return alone.select(F.struct("own", F.when(F.col("last"), "end").otherwise("start").alias("which")).alias("line_id"), pts.alias("pts"))


def extension_hits(lines: DataFrame, reach: float, size: float) -> DataFrame:
    """(line_id, which, x, y, dist): for each free end, the nearest point of another line within ``reach`` straight ahead."""
    ray = _rays(lines, reach)
    hits = _crossed(_met_by_rays(ray, lines, max(size, WIDE * reach)))
    dist = F.round(F.sqrt(F.pow(F.col("x") - F.col("x1"), F.lit(2.0)) + F.pow(F.col("y") - F.col("y1"), F.lit(2.0))), DIGITS)
    best = hits.withColumn("dist", dist).filter("dist > 0").groupBy("left_id").agg(F.min(F.struct("dist", "x", "y")).alias("b"))
    return best.select("left_id.own", "left_id.which", "b.x", "b.y", "b.dist").withColumnRenamed("own", "line_id")


def trim_parts(parts: DataFrame, least: float, group: str) -> DataFrame:
    """Parts of multi-part lines but for short ones with an end that no other part of the line touches."""
    ends = endpoints(parts).join(parts.select("line_id", group), "line_id")
    degree = ends.groupBy(group, "x", "y").agg(F.countDistinct("line_id").alias("n"))
    loose = ends.join(degree, [group, "x", "y"]).groupBy("line_id").agg(F.bool_or(F.col("n") == 1).alias("loose"))
    return parts.withColumn("length", line_length(F.col("pts"))).join(loose, "line_id").filter(~(F.col("loose") & (F.col("length") <= least))).drop("loose")
