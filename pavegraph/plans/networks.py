"""Queries on lines: ends, degrees, dangles, chains, extensions, crossings and connectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shape
from ..functions.storage import table
from ..operators import lines, spatial, topology
from .fixtures import Views
from .registry import query
from .shapes import with_ctes

LINES = """seg as (select line_id, vtx_no, x, y, lead(x) over w as x2, lead(y) over w as y2 from polyline_vertex window w as (partition by line_id order by vtx_no)),
    ln as (select line_id, count(*) as n_pts, coalesce(sum(sqrt(pow(x2 - x, 2) + pow(y2 - y, 2))), 0e0) as length, min_by(x, vtx_no) as sx, min_by(y, vtx_no) as sy, max_by(x, vtx_no) as ex, max_by(y, vtx_no) as ey from seg group by line_id),
    ends as (select line_id, 'start' as which, sx as x, sy as y from ln union all select line_id, 'end', ex, ey from ln),
    deg as (select x, y, count(*) as degree from ends group by x, y)"""
FREE = LINES + ", fr as (select line_id, bool_or(which = 'start' and degree = 1) as s, bool_or(which = 'end' and degree = 1) as e from ends join deg using (x, y) group by line_id)"


@query(with_ctes(LINES, "select line_id, which, x, y from ends"), "polyline_vertex")
def line_endpoints(v: Views) -> DataFrame:
    return topology.endpoints(v.line())


@query(with_ctes(LINES, "select line_id, n_pts, round(length, 6) as length, round(sqrt(pow(ex - sx, 2) + pow(ey - sy, 2)) / nullif(length, 0e0), 6) as linearity, n_pts > 8 as zigzag from ln"), "polyline_vertex")
def linearity(v: Views) -> DataFrame:
    pts = F.col("pts")
    return v.line().select("line_id", F.size(pts).cast("long").alias("n_pts"), F.round(shape.line_length(pts), 6).alias("length"), F.round(shape.linearity(pts), 6).alias("linearity"), lines.is_zigzag(pts).alias("zigzag"))


@query(with_ctes(LINES, "select x, y, degree from deg"), "polyline_vertex")
def node_degree(v: Views) -> DataFrame:
    return topology.node_degree(topology.endpoints(v.line()))


@query(with_ctes(FREE, "select line_id, s as start_free, e as end_free from fr"), "polyline_vertex")
def free_ends(v: Views) -> DataFrame:
    return topology.free_ends(v.line())


@query(with_ctes(FREE, "select line_id, round(length, 6) as length from ln join fr using (line_id) where not (s and e and length < 25e0) and not (s <> e and length < 180e0)"), "polyline_vertex")
def dangles_dropped(v: Views) -> DataFrame:
    return topology.drop_dangles(v.line(), 25.0, 180.0).select("line_id", F.round("length", 6).alias("length"))


@query(
    ", " + LINES + """, lk as (select min(line_id) as a, max(line_id) as b from ends join deg using (x, y) where degree = 2 group by x, y having min(line_id) < max(line_id)),
    bi as (select a, b from lk union select b, a from lk),
    reach(node, root) as (select a, a from bi union select bi.b, reach.root from reach join bi on bi.a = reach.node where reach.root < bi.b)
    select ln.line_id, coalesce(r.root, ln.line_id) as chain from ln left join (select node, min(root) as root from reach group by node) r on r.node = ln.line_id""",
    "polyline_vertex",
)
def false_node_chains(v: Views) -> DataFrame:
    return topology.chains(v.line())


@query(with_ctes(LINES, "select line_id, round(ex + case when ex >= px then 8e0 * cos(atan(abs(ey - py + 1e-6) / abs(ex - px + 1e-6))) else -8e0 * cos(atan(abs(ey - py + 1e-6) / abs(ex - px + 1e-6))) end, 6) as x, round(ey + case when ey >= py then 8e0 * sin(atan(abs(ey - py + 1e-6) / abs(ex - px + 1e-6))) else -8e0 * sin(atan(abs(ey - py + 1e-6) / abs(ex - px + 1e-6))) end, 6) as y from (select ln.line_id, ex, ey, s.x as px, s.y as py from ln join seg s on s.line_id = ln.line_id and s.vtx_no = ln.n_pts - 1) t"), "polyline_vertex")
def extrapolate_end(v: Views) -> DataFrame:
    p = lambda i, c: F.try_element_at("pts", F.lit(i))[c]
    x, y = topology.extrapolated(p(-2, "x"), p(-2, "y"), p(-1, "x"), p(-1, "y"), F.lit(8.0))
    return v.line().filter(F.size("pts") > 1).select("line_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


CROSSINGS = """sg as (select line_id, vtx_no, x, y, lead(x) over w as x2, lead(y) over w as y2 from street window w as (partition by line_id order by vtx_no)),
    sc as (select line_id, ax, ay, bx, by_, cx, unnest(range(cast(floor(least(ay, by_) / 8e0) as bigint), cast(floor(greatest(ay, by_) / 8e0) as bigint) + 1)) as cy from
        (select line_id, x as ax, y as ay, x2 as bx, y2 as by_, unnest(range(cast(floor(least(x, x2) / 8e0) as bigint), cast(floor(greatest(x, x2) / 8e0) as bigint) + 1)) as cx from sg where x2 is not null) q),
    pq as (select a.line_id as l, b.line_id as r, a.ax as x1, a.ay as y1, a.bx as x2, a.by_ as y2, b.ax as x3, b.ay as y3, b.bx as x4, b.by_ as y4, (a.bx - a.ax) * (b.by_ - b.ay) - (a.by_ - a.ay) * (b.bx - b.ax) as det from sc a join sc b on a.cx = b.cx and a.cy = b.cy and a.line_id <> b.line_id),
    cr as (select l, r, ((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3)) / det as t, ((x3 - x1) * (y2 - y1) - (y3 - y1) * (x2 - x1)) / det as u from pq where det <> 0)"""


@query(with_ctes(CROSSINGS, "select l as line_id, count(distinct r) as n_lines from cr where t between 0 and 1 and u between 0 and 1 group by l"), "street")
def line_crossings(v: Views) -> DataFrame:
    """How many other lines cross each line of the street plane."""
    streets = v.street()
    return topology.crossings(streets, streets, 8.0).groupBy(F.col("left_id").alias("line_id")).agg(F.countDistinct("right_id").alias("n_lines"))


@query()
def line_crossings_whole(v: Views) -> DataFrame:
    """``line_crossings`` without SQL and with wider cells, which must not change it."""
    streets = v.street().filter(F.size("pts") > 1)
    return topology.crossings(streets, streets, 10.0).groupBy(F.col("left_id").alias("line_id")).agg(F.countDistinct("right_id").alias("n_lines"))


EXTENSIONS = (FREE + """, two as (select ln.*, a.x as fx, a.y as fy, b.x as lx, b.y as ly from ln join seg a on a.line_id = ln.line_id and a.vtx_no = 2 join seg b on b.line_id = ln.line_id and b.vtx_no = ln.n_pts - 1 where ln.n_pts > 1),
        ray as (select line_id, 'start' as which, sx as x1, sy as y1, fx as px, fy as py from two join fr using (line_id) where s union all select line_id, 'end', ex, ey, lx, ly from two join fr using (line_id) where e),
        ext as (select *, x1 + case when x1 >= px then 6e0 else -6e0 end * cos(atan(abs(y1 - py + 1e-6) / abs(x1 - px + 1e-6))) as x2, y1 + case when y1 >= py then 6e0 else -6e0 end * sin(atan(abs(y1 - py + 1e-6) / abs(x1 - px + 1e-6))) as y2 from ray),
        cand as (select e.line_id, which, e.x1, e.y1, e.x2 as xe, e.y2 as ye, s.x as x3, s.y as y3, s.x2 as x4, s.y2 as y4, (e.x2 - e.x1) * (s.y2 - s.y) - (e.y2 - e.y1) * (s.x2 - s.x) as det from ext e join seg s on s.line_id <> e.line_id and s.x2 is not null and least(s.x, s.x2) <= greatest(e.x1, e.x2) and greatest(s.x, s.x2) >= least(e.x1, e.x2) and least(s.y, s.y2) <= greatest(e.y1, e.y2) and greatest(s.y, s.y2) >= least(e.y1, e.y2)),
        hit as (select *, ((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3)) / det as t, ((x3 - x1) * (ye - y1) - (y3 - y1) * (xe - x1)) / det as u from cand where det <> 0),
        pt as (select line_id, which, x1, y1, round(x1 + t * (xe - x1), 6) as x, round(y1 + t * (ye - y1), 6) as y from hit where t between 0 and 1 and u between 0 and 1),
        ds as (select line_id, which, x, y, round(sqrt(pow(x - x1, 2) + pow(y - y1, 2)), 6) as dist from pt)"""
)


@query(with_ctes(EXTENSIONS, "select line_id, which, min(dist) as dist from ds where dist > 0 group by line_id, which"), "polyline_vertex")
def extension_hits(v: Views) -> DataFrame:
    return topology.extension_hits(table(v.line()), 6.0, 4.0).select("line_id", "which", "dist")


@query(
    with_ctes(LINES, """select line_id, round(length, 6) as length from (select l.*, (select count(distinct o.line_id) from ends o join ln q on q.line_id = o.line_id where o.x = l.sx and o.y = l.sy and q.line_id % 50 = l.line_id % 50) as ns,
        (select count(distinct o.line_id) from ends o join ln q on q.line_id = o.line_id where o.x = l.ex and o.y = l.ey and q.line_id % 50 = l.line_id % 50) as ne from ln l) t where not ((ns = 1 or ne = 1) and length <= 120e0)"""),
    "polyline_vertex",
)
def trim_parts(v: Views) -> DataFrame:
    parts = v.line().withColumn("multi_id", F.col("line_id") % 50)
    return topology.trim_parts(parts, 120.0, "multi_id").select("line_id", F.round("length", 6).alias("length"))


NEAR = """p as (select id, lon as x, lat as y from geo_point where id % 3 = 0), q as (select id, lon as x, lat as y from geo_point where id % 3 > 0),
    d as (select p.id as left_id, q.id as right_id, round(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)), 9) as dist from p, q where sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) <= 5e0)"""


@query(with_ctes(NEAR, "select left_id, right_id, round(dist, 6) as dist from d qualify rank() over (partition by left_id order by dist) = 1"), "geo_point")
def nearest_within(v: Views) -> DataFrame:
    p = v.geo_point().select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return spatial.nearest_within(p.filter("id % 3 = 0"), p.filter("id % 3 > 0"), 5.0).select("left_id", "right_id", F.round("dist", 6).alias("dist"))


@query(with_ctes(NEAR, "select left_id, count(*) as n from d group by left_id"), "geo_point")
def within_distance(v: Views) -> DataFrame:
    p = v.geo_point().select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return spatial.count_within(p.filter("id % 3 = 0"), p.filter("id % 3 > 0"), 5.0)


@query(
    with_ctes(
        FREE + """, free as (select line_id * 2 as k, sx as x, sy as y from ln join fr using (line_id) where n_pts <= 3 and s union all select line_id * 2 + 1, ex, ey from ln join fr using (line_id) where n_pts <= 3 and e),
        target as (select line_id * 2 as o, sx as x, sy as y from ln where n_pts > 3 union all select line_id * 2 + 1, ex, ey from ln where n_pts > 3),
        d as (select k, o, round(sqrt(pow(f.x - t.x, 2) + pow(f.y - t.y, 2)), 9) as dist from free f join target t on abs(f.x - t.x) <= 12e0 and abs(f.y - t.y) <= 12e0 where sqrt(pow(f.x - t.x, 2) + pow(f.y - t.y, 2)) <= 12e0),
        m as (select k, min(dist) as dist from d group by k)""",
        "select 'sidewalk' as f_type, count(*) as n from ln where n_pts > 3 union all select 'crosswalk', count(*) from ln where n_pts <= 3 union all select 'sidewalk_connection', count(*) from d join m using (k, dist)",
    ),
    "polyline_vertex",
)
def connected_network(v: Views) -> DataFrame:
    """Long lines, short lines and connectors from free ends of short lines to the nearest ends of long ones."""
    lines = table(v.line())
    short, long = lines.filter(F.size("pts") <= 3), lines.filter(F.size("pts") > 3)
    free = topology.free_ends(lines)
    ends = topology.endpoints(short).join(free, "line_id").filter("(which = 'start' and start_free) or (which = 'end' and end_free)").select(F.struct("line_id", "which").alias("id"), "x", "y")
    to = topology.endpoints(long).select(F.struct("line_id", "which").alias("id"), "x", "y")
    connectors = spatial.nearest_within(ends, to, 12.0)
    layers = [long.select(F.lit("sidewalk").alias("f_type")), short.select(F.lit("crosswalk").alias("f_type")), connectors.select(F.lit("sidewalk_connection").alias("f_type"))]
    return layers[0].union(layers[1]).union(layers[2]).groupBy("f_type").agg(F.count(F.lit(1)).alias("n"))


@query(with_ctes(LINES, "select count(*) as n, count(distinct (pts)) as n_distinct from (select line_id, array_agg((x, y) order by vtx_no) as pts from polyline_vertex group by line_id) t"), "polyline_vertex")
def dedupe_geometry(v: Views) -> DataFrame:
    every = v.line().select(F.lit("line").alias("f_type"), "pts")
    whole = every.agg(F.count(F.lit(1)).alias("n"))
    return whole.crossJoin(lines.distinct_lines(every).agg(F.count(F.lit(1)).alias("n_distinct")))  # two single rows
