"""Geometry of line networks: merging, extending, noding, connecting, clipping; lines are (line_id, pts)."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shape import line_length
from ..functions.storage import dealt, table
from . import overlay, polygons, topology
from .spatial import cell

POINTS = "array<struct<x:double,y:double>>"
#: Lines in a bucket of chains, about.
BUCKET_LINES = 2_000
#: A point is on a line if it is this near to it.
TOUCH = 1e-9
#: Lines of more points than this are taken for zigzags. Fixed value.
ZIGZAG_POINTS = 8


def squared(dx: Column, dy: Column) -> Column:
    return dx * dx + dy * dy


def spread(segments: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """Segments with the cells (cx, cy) that they come within ``margin`` of, column by column; so these grow with the length, not its square."""
    c = F.col
    columns = segments.withColumn("cx", F.explode(F.sequence(cell(F.least("ax", "bx") - margin, size), cell(F.greatest("ax", "bx") + margin, size))))
    flat = F.abs(c("bx") - c("ax")) <= TOUCH
    at = lambda x: c("ay") + (F.least(F.greatest(x, F.least("ax", "bx")), F.greatest("ax", "bx")) - c("ax")) * (c("by") - c("ay")) / (c("bx") - c("ax"))
    p, q = (F.when(flat, c(end)).otherwise(at(x)) for end, x in (("ay", c("cx") * size - margin), ("by", (c("cx") + 1) * size + margin)))
    return columns.withColumn("cy", F.explode(F.sequence(cell(F.least(p, q) - margin - TOUCH, size), cell(F.greatest(p, q) + margin + TOUCH, size))))


def nearest_share() -> Column:
    """How far along segment (ax, ay)-(bx, by) its nearest point to (x, y) is, from 0 to 1."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / F.nullif(squared(dx, dy), F.lit(0.0))
    return F.coalesce(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def nearest_point() -> tuple[Column, Column]:
    """The point of segment (ax, ay)-(bx, by) nearest to (x, y)."""
    t = nearest_share()
    return F.col("ax") + t * (F.col("bx") - F.col("ax")), F.col("ay") + t * (F.col("by") - F.col("ay"))


def away(t: Column) -> Column:
    """How far (x, y) is from the point of segment (ax, ay)-(bx, by) at share ``t``.

    The segment's start is taken off first: far from the origin, the nearest point itself has lost digits, and with them ties.
    """
    off = lambda p, a, b: F.col(p) - F.col(a) - t * (F.col(b) - F.col(a))
    return F.sqrt(squared(off("x", "ax", "bx"), off("y", "ay", "by")))


def nearest_on_lines(points: DataFrame, lines: DataFrame, radius: float, size: float | None = None, digits: int = 9) -> DataFrame:
    """(id, line_id, x, y, nx, ny, dist): for each point (id, x, y) its nearest point of each nearest line within ``radius``; ties kept.

    A point meets the segments of its own cell only, as these are dealt into all cells within the radius, once.
    """
    size = size or max(radius, 1.0)
    segs = spread(topology.segments(lines), size, radius).select("line_id", "ax", "ay", "bx", "by", "cx", "cy")
    met = points.withColumns({"cx": cell(F.col("x"), size), "cy": cell(F.col("y"), size)}).join(segs, ["cx", "cy"])
    nx, ny = nearest_point()
    near = met.withColumns({"nx": nx, "ny": ny, "dist": F.round(away(nearest_share()), digits)}).filter(F.col("dist") <= radius)
    by_line = near.groupBy("id", "line_id").agg(F.min(F.struct("dist", "nx", "ny", "x", "y")).alias("b")).select("id", "line_id", "b.*")
    least = F.min("dist").over(Window.partitionBy("id"))  # over the lines near one point
    return by_line.withColumn("_least", least).filter("dist = _least").drop("_least")


def touching(lines: DataFrame, size: float) -> DataFrame:
    """(line_id, which, n): of each end, how many other lines go through it, with their ends or between them."""
    ends = topology.endpoints(lines).select(F.struct("line_id", "which").alias("id"), "x", "y")
    segs = spread(topology.segments(lines), size, TOUCH).select("line_id", "ax", "ay", "bx", "by", "cx", "cy")
    met = ends.withColumns({"cx": cell(F.col("x"), size), "cy": cell(F.col("y"), size)}).join(segs, ["cx", "cy"])
    nx, ny = nearest_point()
    on = met.filter((F.col("id.line_id") != F.col("line_id")) & (squared(F.col("x") - nx, F.col("y") - ny) <= TOUCH * TOUCH))
    counted = on.groupBy("id").agg(F.countDistinct("line_id").alias("n"))
    return ends.select("id").join(counted, "id", "left").select("id.line_id", "id.which", F.coalesce("n", F.lit(0)).alias("n"))


def end_cases(lines: DataFrame, size: float) -> DataFrame:
    """(line_id, open_end): which ends of a line no other line touches: start, end, both or none."""
    n = lambda w: F.max(F.when(F.col("which") == w, F.col("n")))
    sides = touching(lines, size).groupBy("line_id").agg(n("start").alias("s"), n("end").alias("e"))
    case = F.when((F.col("s") == 0) & (F.col("e") == 0), "both").when(F.col("s") == 0, "start").when(F.col("e") == 0, "end").otherwise("none")
    return sides.select("line_id", case.alias("open_end"))


def merged_lines(lines: DataFrame) -> DataFrame:
    """(chain, n_lines, pts): lines joined over nodes of degree two, as one line for each chain.

    A chain is one line of the result, so its parts fit in a task. An open chain starts at its smaller end; a closed
    one at the start of its first line.
    """
    ends = topology.endpoints(lines)
    joint = ends.join(topology.node_degree(ends), ["x", "y"]).groupBy("line_id").agg(*(F.max(F.when(F.col("which") == w, F.col("degree") == 2)).alias(w) for w in ("start", "end")))
    chained = lines.join(topology.chains(lines), "line_id").select("chain", "line_id", F.col("pts").cast(POINTS).alias("pts"))
    sizes = chained.groupBy("chain").agg(F.count(F.lit(1)).alias("n_lines"))
    counted = chained.join(sizes, "chain")

    def walk(parts: list[tuple]) -> list[tuple[float, float]]:
        """The points of one chain; ``parts``: (points, whether each end is a joint), by line."""
        at: dict[tuple[float, float], list[int]] = {}
        loose = []
        for k, (pts, joints) in enumerate(parts):
            for end, is_joint in zip((pts[0], pts[-1]), joints):
                (at.setdefault(end, []) if is_joint else loose).append(k if is_joint else (end, k))
        end, k = min(loose) if loose else (parts[0][0][0], 0)
        out, left = [end], set(range(len(parts)))
        while True:
            pts = parts[k][0] if parts[k][0][0] == end else parts[k][0][::-1]
            left.discard(k)
            out += pts[1:]
            end = out[-1]
            nexts = [j for j in at.get(end, ()) if j in left]
            if not nexts:
                return out
            k = nexts[0]

    def walks(t: pa.Table) -> pa.Table:
        """All chains of a bucket."""
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("chain", "line_id", "pts", "start", "end"))), key=lambda r: r[:2])
        chains, sizes, bodies = [], [], []
        for chain, own in itertools.groupby(rows, key=lambda r: r[0]):
            parts = [([(p["x"], p["y"]) for p in pts], (s, e)) for _, _, pts, s, e in own]
            chains.append(chain)
            sizes.append(len(parts))
            bodies.append([{"x": x, "y": y} for x, y in walk(parts)])
        return pa.table({"chain": pa.array(chains, pa.int64()), "n_lines": pa.array(sizes, pa.int64()), "pts": pa.array(bodies, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))})

    several = counted.filter("n_lines > 1").drop("n_lines").join(joint, "line_id")
    buckets = max(1, -(-lines.count() // BUCKET_LINES))  # chains of a bucket are walked by one call
    dealt = several.groupBy(F.pmod(F.xxhash64("chain"), F.lit(buckets)).alias("bucket"))
    return counted.filter("n_lines = 1").select("chain", "n_lines", "pts").unionByName(dealt.applyInArrow(lambda t: walks(t.drop(["bucket"]) if "bucket" in t.column_names else t), f"chain long, n_lines long, pts {POINTS}"))


def extended_lines(lines: DataFrame, reach: float, size: float, barrier: DataFrame | None = None) -> DataFrame:
    """``lines`` with their free ends drawn out to the nearest other line within ``reach`` straight ahead.

    Free starts, free ends and lines free on both sides are extended where they hit; with ``barrier`` an extension that
    crosses one of its lines is left out.
    """
    hits = topology.extension_hits(lines, reach, size)
    end = lambda which: F.element_at("pts", 1 if which == "start" else -1)
    if barrier is not None:
        both = hits.join(lines.select("line_id", "pts"), "line_id")
        own = F.when(F.col("which") == "start", end("start")).otherwise(end("end"))
        stubs = both.select(F.concat_ws("/", F.col("line_id").cast("string"), "which").alias("stub"), "line_id", "which", F.array(own, F.struct("x", "y")).alias("pts"))
        across = topology.crossings(stubs.select(F.col("stub").alias("line_id"), "pts"), barrier.select(F.concat(F.lit("b"), F.col("line_id").cast("string")).alias("line_id"), "pts"), size)
        stopped = stubs.join(across.select(F.col("left_id").alias("stub")).distinct(), "stub", "left_semi").select("line_id", "which")
        hits = hits.join(stopped, ["line_id", "which"], "left_anti")
    point = lambda which: F.max(F.when(F.col("which") == which, F.struct("x", "y")))
    drawn = hits.groupBy("line_id").agg(point("start").alias("_s"), point("end").alias("_e"))
    grown = lines.withColumn("pts", F.col("pts").cast(POINTS)).join(drawn, "line_id", "left")
    some = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast(POINTS))
    return grown.withColumn("pts", F.concat(some("_s"), "pts", some("_e"))).drop("_s", "_e")


def cuts(lines: DataFrame, size: float) -> DataFrame:
    """(line_id, at, x, y): places where another line meets a line, ``at`` counting segments from its start; its own ends left out.

    Parallel segments that lie on each other are not cut; ``planar`` parts these first.
    """
    segs = topology.segments(lines)
    a = spread(segs, size, TOUCH).select("line_id", "seg", "ax", "ay", "bx", "by", "cx", "cy")
    b = spread(segs, size, TOUCH).select(F.col("line_id").alias("other"), F.col("ax").alias("px"), F.col("ay").alias("py"), F.col("bx").alias("qx"), F.col("by").alias("qy"), "cx", "cy")
    c = F.col
    det = (c("bx") - c("ax")) * (c("qy") - c("py")) - (c("by") - c("ay")) * (c("qx") - c("px"))
    t = ((c("px") - c("ax")) * (c("qy") - c("py")) - (c("py") - c("ay")) * (c("qx") - c("px"))) / c("det")
    u = ((c("px") - c("ax")) * (c("by") - c("ay")) - (c("py") - c("ay")) * (c("bx") - c("ax"))) / c("det")
    met = a.join(b, ["cx", "cy"]).filter("line_id <> other").withColumn("det", det).filter("det <> 0").withColumns({"t": t, "u": u}).filter("t between 0 and 1 and u between 0 and 1")
    places = met.select("line_id", F.round(c("seg") + c("t"), 9).alias("at"), F.round(c("ax") + c("t") * (c("bx") - c("ax")), 9).alias("x"), F.round(c("ay") + c("t") * (c("by") - c("ay")), 9).alias("y"))
    last = lines.select("line_id", (F.size("pts") - 1).cast("double").alias("_last"))
    once = places.groupBy("line_id", "at").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    return once.join(last, "line_id").filter("at > 0 and at < _last").drop("_last")


def disjoint_segments(lines: DataFrame) -> DataFrame:
    """(ax, ay, bx, by): all that the segments of lines cover, in segments of which no two lie on each other.

    Segments on one straight line share its direction and offset (rounded to nine and six digits). A sweep along each
    straight line counts the segments that begin and end, and keeps what lies between two such points under any of them.
    """
    s = topology.segments(lines).select(*(F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by")))
    back = (F.col("ax") > F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") > F.col("by")))
    a, b = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    s = s.select(F.when(back, b).otherwise(a).alias("a"), F.when(back, a).otherwise(b).alias("b")).filter("a != b").distinct()
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    length = F.sqrt(squared(dx, dy))
    u = s.withColumns({"ux": dx / length, "uy": dy / length})
    on = F.struct(F.round("ux", 9).alias("ux"), F.round("uy", 9).alias("uy"), F.round(F.col("ux") * F.col("a.y") - F.col("uy") * F.col("a.x"), 6).alias("offset"))
    along = lambda p: F.round(F.col("ux") * F.col(f"{p}.x") + F.col("uy") * F.col(f"{p}.y"), 6)
    event = lambda p, n: F.struct(along(p).alias("t"), F.lit(n).alias("n"), F.col(p).alias("p"))
    events = u.select(on.alias("on"), F.explode(F.array(event("a", 1), event("b", -1))).alias("e")).groupBy("on", "e.t").agg(F.sum("e.n").alias("n"), F.min("e.p").alias("p"))
    order = Window.partitionBy("on").orderBy("t")
    swept = events.select("p", F.sum("n").over(order).alias("depth"), F.lead("p").over(order).alias("q")).filter("depth > 0")
    return swept.select(F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by"))


def planar(lines: DataFrame, size: float) -> DataFrame:
    """(pts): the network of ``lines`` in pieces of one segment, which meet at their ends only; what lies on each other comes once."""
    apart = table(disjoint_segments(lines).withColumn("line_id", F.monotonically_increasing_id()))
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return noded(apart.select("line_id", F.array(point("ax", "ay"), point("bx", "by")).alias("pts")), size).select("pts")


def noded(lines: DataFrame, size: float) -> DataFrame:
    """(line_id, piece, pts): the network of ``lines`` cut wherever another line meets them."""
    at = cuts(lines, size).groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("at", "x", "y"))).alias("marks"))
    joined = lines.filter(F.size("pts") > 1).join(at, "line_id", "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<struct<at:double,x:double,y:double>>")))
    own = F.transform("pts", lambda p, i: F.struct(i.cast("double").alias("at"), p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    whole = joined.select("line_id", own.alias("own"), F.concat(F.slice(own, 1, 1), "marks", F.slice(own, -1, 1)).alias("marks"))
    each = whole.select("line_id", "own", F.posexplode(F.arrays_zip(F.slice("marks", 1, F.size("marks") - 1).alias("a"), F.slice("marks", 2, F.size("marks") - 1).alias("b"))).alias("piece", "m"))
    inner = F.filter("own", lambda p: (p["at"] > F.col("m.a.at")) & (p["at"] < F.col("m.b.at")))
    body = F.concat(F.array(F.col("m.a")), inner, F.array(F.col("m.b")))
    return each.select("line_id", "piece", F.transform(body, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("pts"))


def connectors(points: DataFrame, lines: DataFrame, radius: float, f_type: str, size: float | None = None) -> DataFrame:
    """(id, line_id, f_type, pts, dist): the shortest lines from points to the nearest lines within ``radius``."""
    near = nearest_on_lines(points, lines, radius, size)
    pts = F.array(F.struct(F.col("nx").alias("x"), F.col("ny").alias("y")), F.struct(F.col("x").alias("x"), F.col("y").alias("y")))
    return near.select("id", "line_id", F.lit(f_type).alias("f_type"), pts.alias("pts"), "dist")


def walk_network(sidewalks: DataFrame, crosswalks: DataFrame, size: float, reach: float = 12.0, islands: DataFrame | None = None, island_reach: float = 7.0) -> DataFrame:
    """(f_type, pts): sidewalks, crosswalks, connectors from the open ends of crosswalks to sidewalks, and medians.

    An end is open if no other crosswalk touches it; ``islands`` are points (id, x, y) that the open ends of crosswalks
    free on both sides are also connected to. Equal geometries come once.
    """
    cases = end_cases(crosswalks, size)
    ends = topology.endpoints(crosswalks).join(cases, "line_id").filter("open_end = 'both' or open_end = which").select(F.struct("line_id", "which", "open_end").alias("id"), "x", "y")
    layers = [crosswalks.select(F.lit("crosswalk").alias("f_type"), F.col("pts").cast(POINTS)), connectors(ends, sidewalks, reach, "sidewalk_connection", size).select("f_type", F.col("pts").cast(POINTS)), sidewalks.select(F.lit("sidewalk").alias("f_type"), F.col("pts").cast(POINTS))]
    if islands is not None:
        from .spatial import nearest_within

        met = nearest_within(ends.filter("id.open_end = 'both'"), islands, island_reach)
        layers.append(met.select(F.lit("medians").alias("f_type"), F.array(F.struct(F.col("bx").alias("x"), F.col("by").alias("y")), F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"))).cast(POINTS).alias("pts")))
    out = layers[0]
    for layer in layers[1:]:
        out = out.union(layer)
    return distinct_lines(out.na.drop())


def network(sidewalk_lines: DataFrame, crosswalk_lines: DataFrame, size: float, reach: float = 12.0) -> DataFrame:
    """(f_type, pts): lines (pts) of sidewalks and crosswalks as one network.

    Sidewalks become planar, crosswalks are drawn out to the lines ahead of them, and their open ends are connected.
    """
    side = table(planar(sidewalk_lines.select(F.monotonically_increasing_id().alias("line_id"), F.col("pts").cast(POINTS).alias("pts")), size).withColumn("line_id", F.monotonically_increasing_id()))
    cross = table(crosswalk_lines.select((-1 - F.monotonically_increasing_id()).alias("line_id"), F.col("pts").cast(POINTS).alias("pts")))
    return walk_network(side, table(extended_lines(cross, reach, size)), size, reach)


def distinct_lines(lines: DataFrame) -> DataFrame:
    """One of each equal geometry; a line and its reverse are different."""
    return lines.groupBy("pts").agg(F.min("f_type").alias("f_type")).select("f_type", "pts")


def smoothed(lines: DataFrame, tolerance: float) -> DataFrame:
    """``lines`` with zigzags, those of more than ZIGZAG_POINTS points, simplified."""
    simple = polygons.simplified(lines, tolerance)
    return simple.withColumn("pts", F.when(F.size("pts") > ZIGZAG_POINTS, F.col("simple")).otherwise(F.col("pts"))).drop("simple")


def is_zigzag(pts: Column) -> Column:
    return F.size(pts) > ZIGZAG_POINTS


def longest_part(parts: DataFrame, group: str) -> DataFrame:
    """(group, line_id, length): the longest part of each multi-part line; ties go to the smallest id."""
    length = F.round(line_length(F.col("pts")), 6)
    best = F.max_by(F.struct("line_id", length.alias("length")), F.struct(length.alias("length"), (-F.col("line_id")).alias("turn")))
    return parts.groupBy(group).agg(best.alias("b")).select(group, "b.line_id", "b.length")


def trimmed(parts: DataFrame, group: str, least: float) -> DataFrame:
    """(group, line_id, length, level): parts left by ``trim_parts`` with the limit, else its half, else its quarter, else all.

    ``level`` is 0 to 2 by the limit that left something, and 3 where none did.
    """
    whole = parts.withColumn("length", line_length(F.col("pts"))).select(group, "line_id", "length")
    tries = [topology.trim_parts(parts, least / 2**k, group).select("line_id", F.lit(k).alias("level")) for k in range(3)]
    found = tries[0].union(tries[1]).union(tries[2]).groupBy("line_id").agg(F.min("level").alias("first"))
    marked = whole.join(found, "line_id", "left")
    level = F.coalesce(F.min("first").over(Window.partitionBy(group)), F.lit(3))
    kept = marked.withColumn("level", level).filter((F.col("level") == 3) | (F.col("first") <= F.col("level")))
    return kept.select(group, "line_id", "length", "level")


def bound(value: Column, f: object) -> Column:
    """``f(value)`` with the value worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def half_plane(ring: Column, side: object) -> Column:
    """The part of a closed ring where ``side(point)`` >= 0, a linear function of the point; closed, or empty."""
    none = F.array().cast(POINTS)

    def kept(a: Column, b: Column) -> Column:
        sa, sb = side(a), side(b)
        t = sa / (sa - sb)
        cut = F.array(F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y")))
        here = F.array(F.struct(b["x"].alias("x"), b["y"].alias("y")))
        return F.when((sa >= 0) & (sb >= 0), here).when((sa >= 0) & (sb < 0), cut).when((sa < 0) & (sb >= 0), F.concat(cut, here)).otherwise(none)

    def cut_ring(r: Column) -> Column:
        n = F.greatest(F.size(r) - 1, F.lit(0))
        return F.flatten(F.zip_with(F.slice(r, 1, n), F.slice(r, 2, n), kept))

    close = lambda out: F.when(F.size(out) > 0, F.concat(out, F.slice(out, 1, 1))).otherwise(none)
    return bound(bound(ring, cut_ring), close)


def plain_ring(ring: str | Column) -> Column:
    return F.transform(ring, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))


def _cut_off(length: np.ndarray, points: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Closed rings (length, points), one after another, without what lies where ``side``, linear and one number a point, is below 0."""
    ends = np.cumsum(length)
    first = np.ones(len(points), bool)
    first[ends[length > 0] - 1] = False
    a = np.flatnonzero(first)
    row = np.repeat(np.arange(len(length)), length)[a]
    sa, sb = side[a], side[a + 1]
    cross, kept = ((sa >= 0) & (sb < 0)) | ((sa < 0) & (sb >= 0)), (sa >= 0) & (sb >= 0) | (sa < 0) & (sb >= 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = points[a] + (sa / (sa - sb))[:, None] * (points[a + 1] - points[a])
    both = np.stack([at, points[a + 1]], 1)[np.stack([cross, kept], 1)]
    of = np.repeat(row, cross.astype(np.int64) + kept)
    n = np.bincount(of, minlength=len(length))
    some = n > 0
    begins = np.cumsum(n) - n
    return n + some, np.insert(both, (begins + n)[some], both[begins[some]], axis=0)


def clipped(polygons_: DataFrame, ring: str = "ring") -> DataFrame:
    """``polygons_`` (ring, west, south, east, north) with the ring cut to the box; a ring outside is left out.

    The rings of a batch are cut together, a side of their boxes at a time.
    """
    edges = [F.col(c).cast("double").alias(f"_{c}") for c in ("west", "south", "east", "north")]
    rows = dealt(polygons_.withColumn(ring, plain_ring(ring)).select("*", *edges))
    names = polygons_.columns
    own, n = names.index(ring), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, points = overlay.points_of(batch.column(own))
            for k, axis, sign in ((0, 0, 1), (2, 0, -1), (1, 1, 1), (3, 1, -1)):
                edge = np.repeat(batch.column(n + k).to_numpy(zero_copy_only=False).astype(float), length)
                length, points = _cut_off(length, points, sign * (points[:, axis] - edge))
            left = np.repeat(length > 3, length)
            some = pa.array(np.flatnonzero(length > 3))
            columns = [column.take(some) for column in batch.columns[:n]]
            columns[own] = overlay.lists(length[length > 3], points[left])
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, polygons_.withColumn(ring, plain_ring(ring)).schema)


def split(polygons_: DataFrame, ax: Column, ay: Column, bx: Column, by: Column, ring: str = "ring") -> DataFrame:
    """``polygons_`` twice, with the part of the ring to the left and to the right of the line a-b; column ``hand``."""
    plain = polygons_.withColumn(ring, plain_ring(ring))
    cross = lambda p: (bx - ax) * (p["y"] - ay) - (by - ay) * (p["x"] - ax)
    halves = [plain.withColumn(ring, half_plane(F.col(ring), f)).withColumn("hand", F.lit(hand)) for hand, f in (("left", cross), ("right", lambda p: -cross(p)))]
    return halves[0].union(halves[1]).filter(F.size(ring) > 3)


def boundary_lines(polygons_: DataFrame, key: str = "geom_id", rings: str = "rings") -> DataFrame:
    """(key, ring_no, pts): the rings of polygons as lines."""
    return polygons_.select(key, F.posexplode(rings).alias("ring_no", "pts"))


def vertices_and_edges(lines: DataFrame) -> DataFrame:
    """(line_id, n_vertices, n_edges) of lines, after which the two relations themselves are ``segments`` and ``endpoints``."""
    return lines.select("line_id", F.size("pts").alias("n_vertices"), (F.size("pts") - 1).alias("n_edges"))


def is_simple_ring(ring: Column) -> Column:
    """Whether a ring is closed, has area, and no two sides of it cross or touch but for neighbours in their common point."""
    n = F.size(ring) - 1
    side = lambda i: (F.get(ring, i), F.get(ring, i + 1))

    def turn(a: Column, b: Column, c: Column) -> Column:
        return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))

    def between(a: Column, b: Column, c: Column) -> Column:
        return (turn(a, b, c) == 0) & c["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & c["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    def meet(i: Column, j: Column) -> Column:
        (a, b), (c, d) = side(i), side(j)
        proper = (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)
        touch = between(a, b, c) | between(a, b, d) | between(c, d, a) | between(c, d, b)
        neighbour = (j == i + 1) | ((i == 0) & (j == n - 1))
        fold = F.when(j == i + 1, between(a, b, d) | between(c, d, a)).otherwise(between(a, b, c) | between(c, d, b))
        return F.when(neighbour, fold).otherwise(proper | touch)

    pairs = F.exists(F.sequence(F.lit(0), n - 2), lambda i: F.exists(F.sequence(i + 1, n - 1), lambda j: meet(i, j)))
    closed = (n >= 3) & (F.element_at(ring, 1)["x"] == F.element_at(ring, -1)["x"]) & (F.element_at(ring, 1)["y"] == F.element_at(ring, -1)["y"])
    return F.when(closed, ~pairs).otherwise(F.lit(False))
