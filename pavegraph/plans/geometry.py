"""Queries on polygons from masks, and on the geometry of networks: merging, extending, noding, connecting, clipping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shape
from ..functions.storage import dealt, table
from ..operators import lines, medial, polygonize, polygons, spatial, topology
from .fixtures import Views
from .networks import EXTENSIONS, LINES
from .registry import query
from .shapes import CIRCLES, METRICS, with_ctes

CORNERS = """q as (select tile, v, c + dx as x, r + dy as y, count(*) as n, max(dx + dy) as hi, min(dx + dy) as lo, max(dx - dy) as dhi from mask_px, (select unnest([0, 1, 0, 1]) as dx, unnest([0, 0, 1, 1]) as dy) o group by 1, 2, 3, 4),
    k as (select tile, v, cast(sum(case when n in (1, 3) then 1 when n = 2 and (hi = 1 and lo = 1 or hi = 2 and lo = 0) then 2 else 0 end) as bigint) as corners from q group by tile, v),
    a as (select tile, v, cast(count(*) as double) as area, min(c) as x1, max(c) + 1 as x2, min(r) as y1, max(r) + 1 as y2 from mask_px group by tile, v)"""


@query(with_ctes(CORNERS, "select tile, v, corners, area from k join a using (tile, v)"), "mask_px")
def mask_rings(v: Views) -> DataFrame:
    """Rings of all masks: their corners and area, holes taken off, by tile and class."""
    found = polygonize.mask_rings(v.mask_px()).withColumn("area", polygonize.rings_area(F.col("rings")))
    corners = F.aggregate(F.transform("rings", lambda r: F.size(r) - 1), F.lit(0), lambda s, x: s + x)
    return found.groupBy("tile", "v").agg(F.sum(corners).alias("corners"), F.sum("area").alias("area"))


@query(with_ctes(CORNERS, "select tile, v, round(west + x1 * 0.125e0, 9) as west, round(west + x2 * 0.125e0, 9) as east, round(north - y1 * 0.25e0, 9) as north, round(north - y2 * 0.25e0, 9) as south, round(area * 0.03125e0, 9) as area from (select *, cast(tile % 64 as double) as west, 2e0 * floor(tile / 64e0) as north from a) t"), "mask_px")
def mask_polygons(v: Views) -> DataFrame:
    """The polygons of all masks on the ground, each tile one unit wide and two high: their box and area by tile and class."""
    west, north = (F.col("tile") % 64).cast("double"), F.floor(F.col("tile") / 64).cast("double") * 2.0
    on_ground = polygonize.mask_rings(v.mask_px()).withColumn("rings", polygonize.placed(F.col("rings"), west, north, west + 1.0, north - 2.0, 8))
    box = shape.bounding_box(F.element_at("rings", 1))
    boxed = on_ground.select("tile", "v", box.alias("b"), polygonize.rings_area(F.col("rings")).alias("area"))
    return boxed.groupBy("tile", "v").agg(F.round(F.min("b.west"), 9).alias("west"), F.round(F.max("b.east"), 9).alias("east"), F.round(F.max("b.north"), 9).alias("north"), F.round(F.min("b.south"), 9).alias("south"), F.round(F.sum("area"), 9).alias("area"))


@query()
def feature_layers(v: Views) -> DataFrame:
    """Polygons of sidewalks, crosswalks and roads of all masks, holes filled by class, as (tile, f_type, component, n_rings, area)."""
    found = polygonize.feature_layers(v.mask_px(), 3.0)
    return found.select("tile", "f_type", "component", F.size("rings").alias("n_rings"), F.round(polygonize.rings_area(F.col("rings")), 6).alias("area"))


@query("select tile, bool_or(v = 2) as present from mask_px group by tile", "mask_px")
def class_present(v: Views) -> DataFrame:
    return polygonize.has_class(v.mask_px(), 2)


@query("select geom_id, case when kind = 0 then w * h else w * h * 0.875e0 end as area from rect", "rect")
def convex_replaced(v: Views) -> DataFrame:
    """Polygons that fill most of their hull become it."""
    layer = polygonize.hull_if_convex(v.polygon().select("geom_id", F.array("ring").alias("rings")))
    return layer.select("geom_id", F.round(polygonize.rings_area(F.col("rings")), 6).alias("area"))


@query(with_ctes(CIRCLES, "select geom_id, round(case when area / (pi() * radius * radius) < 0.2e0 then w * h else area end, 6) as area from (select geom_id, w, h, radius, case when kind = 0 then w * h else w * h * 0.75e0 end as area from rect join circ using (geom_id)) t"), "rect", "vertex")
def straight_replaced(v: Views) -> DataFrame:
    """Long convex polygons become their least rotated box."""
    layer = polygonize.box_if_straight(v.polygon().select("geom_id", F.array("ring").alias("rings")))
    return layer.select("geom_id", F.round(polygonize.rings_area(F.col("rings")), 6).alias("area"))


@query("select geom_id, geom_id % 5 <> 0 as valid from rect", "rect")
def valid_rings(v: Views) -> DataFrame:
    """Rings of which every fifth has two corners exchanged, so that its sides cross."""
    r = F.col("ring")
    crossed = F.concat(F.slice(r, 1, 1), F.slice(r, 3, 1), F.slice(r, 2, 1), F.slice(r, 4, 10))
    return v.polygon().withColumn("ring", F.when(F.col("geom_id") % 5 == 0, crossed).otherwise(r)).select("geom_id", lines.is_simple_ring(F.col("ring")).alias("valid"))


@query("select geom_id, ring_no, round(case ring_no when 0 then 2e0 * (w + h) else w + h / 2e0 end, 6) as length from rect, (select unnest([0, 1]) as ring_no) o", "rect")
def boundary_lines(v: Views) -> DataFrame:
    p = lambda x, y: F.struct((F.col("x0") + x).alias("x"), (F.col("y0") + y).alias("y"))
    w, h, z = F.col("w") / 2.0, F.col("h") / 4.0, F.lit(0.0)
    box = lambda a, b: F.array(p(z, z), p(a, z), p(a, b), p(z, b), p(z, z))
    rings = v.rect().select("geom_id", F.array(box(F.col("w"), F.col("h")), box(w, h)).alias("rings"))
    return lines.boundary_lines(rings).select("geom_id", "ring_no", F.round(shape.line_length(F.col("pts")), 6).alias("length"))


PIECES = """pc as (select geom_id, x0, y0, x0 + w as x1, y0 + case when kind = 0 then h else h / 2e0 end as y1 from rect union all select geom_id, x0, y0 + h / 2e0, x0 + w / 2e0, y0 + h from rect where kind <> 0)"""


@query(
    with_ctes(PIECES + """, bx as (select geom_id, x0, y0, x1, y1, bc, unnest(range(cast(floor(y0 / 100e0) as bigint), cast(floor(y1 / 100e0) as bigint) + 1)) as br from (select *, unnest(range(cast(floor(x0 / 100e0) as bigint), cast(floor(x1 / 100e0) as bigint) + 1)) as bc from pc) q)""",
    "select geom_id, bc, br, round(sum(a), 4) as area from (select geom_id, bc, br, (least(x1, bc * 100e0 + 100e0) - greatest(x0, bc * 100e0)) * (least(y1, br * 100e0 + 100e0) - greatest(y0, br * 100e0)) as a from bx) t where a > 0 group by geom_id, bc, br"),
    "rect",
)
def boundary_clip(v: Views) -> DataFrame:
    """All polygons cut to the squares of a grid of boundaries."""
    shapes = dealt(v.polygon()).select("geom_id", "ring", shape.bounding_box(F.col("ring")).alias("b"))
    span = lambda a, b: F.sequence(F.floor(F.col(a) / 100.0), F.floor(F.col(b) / 100.0))
    boxes = shapes.withColumn("bc", F.explode(span("b.west", "b.east"))).withColumn("br", F.explode(span("b.south", "b.north")))
    edges = {"west": F.col("bc") * 100.0, "south": F.col("br") * 100.0, "east": F.col("bc") * 100.0 + 100.0, "north": F.col("br") * 100.0 + 100.0}
    cut = lines.clipped(boxes.withColumns(edges)).withColumn("area", F.round(shape.ring_area(F.col("ring")), 4))
    return cut.filter("area > 0").select("geom_id", "bc", "br", "area")


@query("select geom_id, hand, round(case hand when 'left' then w * h / 4e0 else case when kind = 0 then w * h else w * h * 0.75e0 end - w * h / 4e0 end, 6) as area from rect, (select unnest(['left', 'right']) as hand) o", "rect")
def polygon_split(v: Views) -> DataFrame:
    """All polygons split by an upright line at a quarter of their width."""
    shapes = v.polygon().join(v.rect().select("geom_id", "w", "x0", "y0"), "geom_id")
    x = F.col("x0") + F.col("w") / 4.0
    halves = lines.split(shapes, x, F.col("y0"), x, F.col("y0") + 1.0)
    return halves.select("geom_id", "hand", F.round(shape.ring_area(F.col("ring")), 6).alias("area"))


CHAINS = LINES + """, lk as (select min(line_id) as a, max(line_id) as b from ends join deg using (x, y) where degree = 2 group by x, y having min(line_id) < max(line_id)),
    bi as (select a, b from lk union select b, a from lk),
    reach(node, root) as (select a, a from bi union select bi.b, reach.root from reach join bi on bi.a = reach.node where reach.root < bi.b),
    ch as (select ln.line_id, n_pts, length, coalesce(r.root, ln.line_id) as chain from ln left join (select node, min(root) as root from reach group by node) r on r.node = ln.line_id)"""


@query(", " + CHAINS + " select chain, count(*) as n_lines, cast(sum(n_pts) - count(*) + 1 as bigint) as n_pts, round(sum(length), 6) as length from ch group by chain", "polyline_vertex")
def merged_lines(v: Views) -> DataFrame:
    """Lines joined over nodes of degree two, as geometry."""
    return lines.merged_lines(table(v.line())).select("chain", "n_lines", F.size("pts").cast("long").alias("n_pts"), F.round(shape.line_length(F.col("pts")), 6).alias("length"))


@query(", " + CHAINS + " select chain, count(*) as n_lines, round(sum(length), 6) as length from ch group by chain", "polyline_vertex")
def chain_lengths(v: Views) -> DataFrame:
    return topology.merge_chains(v.line()).select("chain", "n_lines", F.round("length", 6).alias("length"))


@query(with_ctes(EXTENSIONS + ", hs as (select line_id, count(*) as n, sum(dist) as more from (select line_id, which, min(dist) as dist from ds where dist > 0 group by line_id, which) q group by line_id)", "select line_id, n_pts + coalesce(n, 0) as n_pts, round(length + coalesce(more, 0e0), 3) as length from ln left join hs using (line_id)"), "polyline_vertex")
def extended_lines(v: Views) -> DataFrame:
    """Lines with their free ends drawn out to what they hit first."""
    grown = lines.extended_lines(table(v.line()), 6.0, 4.0)
    return grown.select("line_id", F.size("pts").cast("long").alias("n_pts"), F.round(shape.line_length(F.col("pts")), 3).alias("length"))


@query()
def extended_lines_with_barrier(v: Views) -> DataFrame:
    """Short lines extended to each other, but not across the longer lines."""
    streets = table(v.street())
    grown = lines.extended_lines(streets.filter(F.size("pts") <= 3), 8.0, 8.0, streets.filter(F.size("pts") > 3))
    return grown.select("line_id", F.size("pts").cast("long").alias("n_pts"), F.round(shape.line_length(F.col("pts")), 3).alias("length"))


STREETS = """sg as (select line_id, vtx_no, x, y, lead(x) over w as x2, lead(y) over w as y2 from street window w as (partition by line_id order by vtx_no)),
    sl as (select line_id, count(*) as n_pts, sum(sqrt(pow(x2 - x, 2) + pow(y2 - y, 2))) as length, min_by(x, vtx_no) as sx, min_by(y, vtx_no) as sy, max_by(x, vtx_no) as ex, max_by(y, vtx_no) as ey from sg group by line_id),
    se as (select line_id, 'start' as which, sx as x, sy as y from sl union all select line_id, 'end', ex, ey from sl),
    sc as (select line_id, seg, ax, ay, bx, by_, cx, unnest(range(cast(floor(least(ay, by_) / 8e0) as bigint), cast(floor(greatest(ay, by_) / 8e0) as bigint) + 1)) as cy from
        (select line_id, vtx_no - 1 as seg, x as ax, y as ay, x2 as bx, y2 as by_, unnest(range(cast(floor(least(x, x2) / 8e0) as bigint), cast(floor(greatest(x, x2) / 8e0) as bigint) + 1)) as cx from sg where x2 is not null) q),
    tc as (select distinct e.line_id, e.which, s.line_id as other from se e join sc s on s.cx = cast(floor(e.x / 8e0) as bigint) and s.cy = cast(floor(e.y / 8e0) as bigint) where s.line_id <> e.line_id and (s.bx - s.ax) * (e.y - s.ay) = (s.by_ - s.ay) * (e.x - s.ax) and e.x between least(s.ax, s.bx) and greatest(s.ax, s.bx) and e.y between least(s.ay, s.by_) and greatest(s.ay, s.by_)),
    tn as (select e.line_id, e.which, count(tc.other) as n from se e left join tc on tc.line_id = e.line_id and tc.which = e.which group by 1, 2)"""


@query(with_ctes(STREETS, "select line_id, which, n from tn"), "street")
def ends_on_lines(v: Views) -> DataFrame:
    """How many other lines go through each end of a line."""
    return lines.touching(v.street(), 8.0)


@query(with_ctes(STREETS, "select s.line_id, case when s.n = 0 and e.n = 0 then 'both' when s.n = 0 then 'start' when e.n = 0 then 'end' else 'none' end as open_end from tn s join tn e on s.line_id = e.line_id and s.which = 'start' and e.which = 'end'"), "street")
def loose_ends(v: Views) -> DataFrame:
    return lines.end_cases(v.street(), 8.0)


@query(
    with_ctes(
        STREETS + """, pq as (select a.line_id, a.seg, a.ax, a.ay, a.bx, a.by_, b.ax as px, b.ay as py, b.bx as qx, b.by_ as qy, (a.bx - a.ax) * (b.by_ - b.ay) - (a.by_ - a.ay) * (b.bx - b.ax) as det from sc a join sc b on a.cx = b.cx and a.cy = b.cy and a.line_id <> b.line_id),
        tu as (select line_id, seg, ((px - ax) * (qy - py) - (py - ay) * (qx - px)) / det as t, ((px - ax) * (by_ - ay) - (py - ay) * (bx - ax)) / det as u from pq where det <> 0),
        ct as (select distinct line_id, round(seg + t, 9) as spot from tu where t between 0 and 1 and u between 0 and 1)""",
        "select sl.line_id, 1 + count(spot) as pieces, round(any_value(length), 6) as length from sl left join ct on ct.line_id = sl.line_id and spot > 0 and spot < n_pts - 1 group by sl.line_id",
    ),
    "street",
)
def noded_network(v: Views) -> DataFrame:
    """The pieces into which lines are cut where others meet them."""
    pieces = lines.noded(v.street(), 8.0)
    return pieces.groupBy("line_id").agg(F.count(F.lit(1)).alias("pieces"), F.round(F.sum(shape.line_length(F.col("pts"))), 6).alias("length"))


@query(
    with_ctes(
        """box as (select geom_id, w, h, floor(x0 / 4e0) as x0, floor(y0 / 4e0) as y0 from rect),
        he as (select distinct 2 * x0 + a as x, y from (select x0, unnest(range(cast(2 * w as bigint))) as a, y0, h from box) b, lateral (select unnest([2 * y0, 2 * y0 + 2 * h]) as y) s),
        ve as (select distinct x, 2 * y0 + a as y from (select y0, unnest(range(cast(2 * h as bigint))) as a, x0, w from box) b, lateral (select unnest([2 * x0, 2 * x0 + 2 * w]) as x) s),
        corner as (select distinct x, y from box, lateral (select unnest([2 * x0, 2 * x0 + 2 * w]) as x) s, lateral (select unnest([2 * y0, 2 * y0 + 2 * h]) as y) t),
        hs as (select x, y, count(*) as n from (select x, y from he union all select x + 1, y from he) t group by 1, 2),
        vs as (select x, y, count(*) as n from (select x, y from ve union all select x, y + 1 from ve) t group by 1, 2)""",
        """select (select count(*) from he) + (select count(*) from ve)
            - (select count(*) from hs where n = 2 and not exists (select 1 from vs where vs.x = hs.x and vs.y = hs.y) and not exists (select 1 from corner c where c.x = hs.x and c.y = hs.y))
            - (select count(*) from vs where n = 2 and not exists (select 1 from hs where vs.x = hs.x and vs.y = hs.y) and not exists (select 1 from corner c where c.x = vs.x and c.y = vs.y)) as pieces,
            round(((select count(*) from he) + (select count(*) from ve)) * 0.5e0, 3) as length""",
    ),
    "rect",
)
def noded_outlines(v: Views) -> DataFrame:
    """Outlines of boxes that cross, touch and lie on each other, as a planar network: every bit of the plane is in one piece."""
    x, y = F.floor(F.col("x0") / 4).cast("double"), F.floor(F.col("y0") / 4).cast("double")
    p = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    w, h, z = F.col("w"), F.col("h"), F.lit(0.0)
    outlines = v.rect().select(F.col("geom_id").alias("line_id"), F.array(p(z, z), p(w, z), p(w, h), p(z, h), p(z, z)).alias("pts"))
    return lines.planar(outlines, 8.0).agg(F.count(F.lit(1)).alias("pieces"), F.round(F.sum(shape.line_length(F.col("pts"))), 3).alias("length"))


@query(with_ctes(STREETS, "select line_id, n_pts as n_vertices, n_pts - 1 as n_edges from sl"), "street")
def line_parts(v: Views) -> DataFrame:
    return lines.vertices_and_edges(v.street()).select("line_id", F.col("n_vertices").cast("long"), F.col("n_edges").cast("long"))


NETWORK = STREETS + """, cw as (select line_id, sx, sy, ex, ey from sl where n_pts <= 3),
    ce as (select line_id, which, x, y from se join cw using (line_id)),
    cn as (select c.line_id, c.which, c.x, c.y from ce c where not exists (select 1 from tc join cw o on o.line_id = tc.other where tc.line_id = c.line_id and tc.which = c.which)),
    ws as (select line_id, ax, ay, bx, by_, cx, unnest(range(cast(floor((least(ay, by_) - 12e0) / 16e0) as bigint), cast(floor((greatest(ay, by_) + 12e0) / 16e0) as bigint) + 1)) as cy from
        (select line_id, vtx_no, x as ax, y as ay, x2 as bx, y2 as by_, unnest(range(cast(floor((least(x, x2) - 12e0) / 16e0) as bigint), cast(floor((greatest(x, x2) + 12e0) / 16e0) as bigint) + 1)) as cx from sg join sl using (line_id) where x2 is not null and n_pts > 3) q),
    wt as (select c.line_id as id, c.which, c.x, c.y, s.line_id, ax, ay, bx, by_, coalesce(greatest(least(((c.x - ax) * (bx - ax) + (c.y - ay) * (by_ - ay)) / nullif((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay), 0e0), 1e0), 0e0), 0e0) as t from cn c join ws s on s.cx = cast(floor(c.x / 16e0) as bigint) and s.cy = cast(floor(c.y / 16e0) as bigint)),
    wd as (select id, which, x, y, line_id, ax + t * (bx - ax) as nx, ay + t * (by_ - ay) as ny, round(sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (by_ - ay), 2)), 9) as dist from wt),
    wm as (select id, which, min(dist) as dist from wd where dist <= 12e0 group by 1, 2)"""


@query(with_ctes(NETWORK, "select id as line_id, which, round(any_value(wd.dist), 6) as dist, count(distinct wd.line_id) as lines from wd join wm using (id, which, dist) group by 1, 2"), "street")
def connectors_to_lines(v: Views) -> DataFrame:
    """From open ends of short lines to the nearest points of the nearest longer lines, ties kept."""
    streets = table(v.street())
    short, long = streets.filter(F.size("pts") <= 3), streets.filter(F.size("pts") > 3)
    ends = topology.endpoints(short).join(lines.end_cases(short, 8.0), "line_id").filter("open_end = 'both' or open_end = which").select(F.struct("line_id", "which").alias("id"), "x", "y")
    found = lines.connectors(ends, long, 12.0, "sidewalk_connection", 16.0)
    return found.groupBy("id").agg(F.round(F.min("dist"), 6).alias("dist"), F.count_distinct("line_id").alias("lines")).select("id.line_id", "id.which", "dist", "lines")


@query(
    with_ctes(
        NETWORK + ", gp as (select line_id, max(n_pts) as n_pts, list(x order by vtx_no) as xs, list(y order by vtx_no) as ys from sg join sl using (line_id) group by line_id)",
        "select 'crosswalk' as f_type, count(distinct (xs, ys)) as n from gp where n_pts <= 3 union all select 'sidewalk', count(distinct (xs, ys)) from gp where n_pts > 3 union all select 'sidewalk_connection', count(*) from (select distinct p.nx, p.ny, x, y from (select wd.id, wd.which, wd.line_id, any_value(x) as x, any_value(y) as y, min({'nx': nx, 'ny': ny}) as p from wd join wm using (id, which, dist) group by 1, 2, 3) g) d left join (select distinct xs[1] as a1, ys[1] as b1, xs[2] as a2, ys[2] as b2 from gp where n_pts = 2) o on a1 = d.nx and b1 = d.ny and a2 = d.x and b2 = d.y where a1 is null",
    ),
    "street",
)
def walk_network(v: Views) -> DataFrame:
    """The whole network: sidewalks, crosswalks and the connectors between them, equal geometries once."""
    streets = table(v.street())
    out = lines.walk_network(streets.filter(F.size("pts") > 3), streets.filter(F.size("pts") <= 3), 16.0)
    return out.groupBy("f_type").agg(F.count(F.lit(1)).alias("n"))


@query()
def walk_network_with_islands(v: Views) -> DataFrame:
    """The network with medians: open crosswalks are also connected to island points nearby."""
    streets = table(v.street())
    islands = v.rect().filter("kind = 1 and w * h < 230").select(F.col("geom_id").alias("id"), (F.col("x0") + F.col("w") / 2).alias("x"), (F.col("y0") + F.col("h") / 4).alias("y"))
    out = lines.walk_network(streets.filter(F.size("pts") > 3), streets.filter(F.size("pts") <= 3), 16.0, islands=islands)
    return out.groupBy("f_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(shape.line_length(F.col("pts"))), 3).alias("length"))


@query(with_ctes(LINES, "select multi_id, line_id, length from (select line_id % 50 as multi_id, line_id, round(length, 6) as length, row_number() over (partition by line_id % 50 order by round(length, 6) desc, line_id) as k from ln) t where k = 1"), "polyline_vertex")
def longest_part(v: Views) -> DataFrame:
    return lines.longest_part(v.line().withColumn("multi_id", F.col("line_id") % 50), "multi_id")


@query(
    with_ctes(
        LINES + """, ge as (select line_id // 3 as g, line_id, x, y from ends), gd as (select g, x, y, count(distinct line_id) as n from ge group by 1, 2, 3),
        lo as (select line_id, bool_or(n = 1) as loose from ge join gd using (g, x, y) group by line_id),
        fi as (select line_id, line_id // 3 as g, length, case when not loose or length > 300e0 then 0 when length > 150e0 then 1 when length > 75e0 then 2 end as first from ln join lo using (line_id)),
        lv as (select *, coalesce(min(first) over (partition by g), 3) as level from fi)""",
        "select g, line_id, round(length, 6) as length, level from lv where level = 3 or first <= level",
    ),
    "polyline_vertex",
)
def trimmed_or_all(v: Views) -> DataFrame:
    """Parts of lines left by the first of three limits that leaves any."""
    parts = v.line().withColumn("g", F.floor(F.col("line_id") / 3))
    return lines.trimmed(parts, "g", 300.0).select("g", "line_id", F.round("length", 6).alias("length"), "level")


@query(with_ctes(METRICS, """select geom_id, case when area < 5e0 then 'skip' when convexity < 0.87e0 then 'erode' when long < 8e0 then 'extend' else 'middle' end as branch, round(case when area >= 5e0 and convexity < 0.87e0 then 4e0 * area / perimeter / 4e0 end, 6) as erosion, case when area >= 5e0 and convexity >= 0.87e0 then long end as length
    from (select geom_id, area, perimeter, case when kind = 0 then 1e0 else 0.75e0 / 0.875e0 end as convexity, greatest(w, h) as long from m join rect using (geom_id)) t"""), "vertex")
def crosswalk_branches(v: Views) -> DataFrame:
    """How each crosswalk polygon becomes a line, and its middle line where that is it."""
    from ..operators import centerlines

    found = centerlines.crosswalk_branches(v.polygon().select("geom_id", "ring"), convexity=0.87)
    return found.select("geom_id", "branch", F.round("erosion", 6).alias("erosion"), F.round("length", 6).alias("length"))


@query(with_ctes(METRICS, "select geom_id, case when area <= 20e0 then 'skip' when 2e0 * sqrt(pi() * area) / perimeter > 0.8e0 then 'round' else 'long' end as branch, round(case when area > 20e0 then case when 2e0 * sqrt(pi() * area) / perimeter > 0.8e0 then sqrt(area / pi()) / 4e0 else 0.2e0 end end, 6) as spacing from m"), "vertex")
def sidewalk_branches(v: Views) -> DataFrame:
    """Which sidewalk polygons get a centreline, and the spacing of its points."""
    from ..operators import centerlines

    return centerlines.sidewalk_branches(v.polygon().select("geom_id", "ring")).select("geom_id", "branch", F.round("spacing", 6).alias("spacing"))


@query()
def centerlines_of_polygons(v: Views) -> DataFrame:
    """Centrelines of all polygons from cells half a unit wide, as (geom_id, n_parts, length)."""
    from ..operators import centerlines

    found = centerlines.centerlines(v.polygon().select("geom_id", "ring"), 0.5)
    return found.groupBy("geom_id").agg(F.count(F.lit(1)).alias("n_parts"), F.round(F.sum(shape.line_length(F.col("pts"))), 6).alias("length"))


@query("select geom_id, true as has_line, case when kind = 0 and w <> h then true end as as_long_as_known from rect where w * h * case when kind = 0 then 1 else 0.75e0 end > 5", "rect")
def medial_axes(v: Views) -> DataFrame:
    """Centrelines of all polygons that are not tiny; a rectangle's is as long as its sides differ, within a tenth of the shorter one."""
    layer = v.polygon().select("geom_id", "ring").filter(shape.ring_area(F.col("ring")) > 5)
    found = medial.medial_lines(layer.withColumn("gap", shape.ring_area(F.col("ring")) / shape.line_length(F.col("ring")) * 0.6), "geom_id", "gap")
    length = found.groupBy("geom_id").agg(F.sum(shape.line_length(F.col("pts"))).alias("length"))
    near = F.abs(F.col("length") - F.abs(F.col("w") - F.col("h"))) <= F.least("w", "h") / 10
    both = layer.select("geom_id").join(length, "geom_id", "left").join(v.rect(), "geom_id")
    return both.select("geom_id", (F.coalesce("length", F.lit(0.0)) > 0).alias("has_line"), F.when((F.col("kind") == 0) & (F.col("w") != F.col("h")), near).alias("as_long_as_known"))


BRANCHES = "select geom_id, kind, w, h, case when area < 5e0 then 'skip' when kind <> 0 then 'erode' when greatest(w, h) < 8e0 then 'extend' else 'middle' end as branch from m join rect using (geom_id)"


@query(with_ctes(METRICS, f"select geom_id, branch, case when kind = 0 then greatest(w, h) end as length, true as enough from ({BRANCHES}) t where branch <> 'skip' and (kind = 0 or least(w, h) >= 8)"), "vertex")
def crosswalk_lines(v: Views) -> DataFrame:
    """Lines of crosswalk polygons by their branch: rectangles get their longer side, L-shapes at least most of what erosion leaves of their upright part, if it is a unit wide."""
    found = medial.crosswalk_lines(v.polygon().select("geom_id", "ring"), convexity=0.87).groupBy("geom_id", "branch").agg(F.sum(shape.line_length(F.col("pts"))).alias("length"))
    both = found.join(v.rect(), "geom_id").filter("kind = 0 or least(w, h) >= 8")
    erosion = 0.75 * F.col("w") * F.col("h") / (2 * (F.col("w") + F.col("h")))
    left = 0.75 * F.greatest(F.col("w") / 2 - 2 * erosion, F.col("h") - 2 * erosion)
    return both.select("geom_id", "branch", F.when(F.col("kind") == 0, F.round("length", 6)).alias("length"), ((F.col("kind") == 0) | (F.col("length") >= left) | (F.col("w") / 2 - 2 * erosion < 1)).alias("enough"))


@query()
def network_of_polygons(v: Views) -> DataFrame:
    """From polygons to a walkable network: lines of sidewalks and crosswalks, noded, connected; pieces and length by type.

    Without SQL, as centrelines have none; tests hold its parts.
    """
    layer = v.polygon()
    side = medial.sidewalk_lines(layer.filter("kind = 0").select("geom_id", "ring"))
    cross = medial.crosswalk_lines(layer.filter("kind <> 0").select("geom_id", "ring"))
    out = lines.network(side, cross, 32.0)
    return out.groupBy("f_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(shape.line_length(F.col("pts"))), 3).alias("length"))


@query(with_ctes(STREETS, "select line_id, round(length + 2e0 * floor(length * 0.8e0), 2) as length from sl"), "street")
def lengthened_lines(v: Views) -> DataFrame:
    """Lines made longer at both ends by the whole part of four fifths of their length."""
    return topology.lengthened(v.street(), 0.8).select("line_id", F.round(shape.line_length(F.col("pts")), 2).alias("length"))


@query("select geom_id, case when kind = 0 then 5 else 7 end as points from rect", "rect")
def straightened_rings(v: Views) -> DataFrame:
    """Rings with a point in the middle of their first side, which straightening takes out again."""
    r = F.col("ring")
    middle = F.array(F.struct(((r[0]["x"] + r[1]["x"]) / 2.0).alias("x"), ((r[0]["y"] + r[1]["y"]) / 2.0).alias("y")))
    bent = v.polygon().withColumn("ring", F.concat(lines.plain_ring(F.slice(r, 1, 1)), middle, lines.plain_ring(F.slice(r, 2, 10))))
    return polygons.straightened(bent.select("geom_id", "ring"), 10.0).select("geom_id", F.size("simple").alias("points"))


@query("select geom_id, round((w + 2e0) * (h + 2e0), 6) as wider, case when least(w, h) > 1e0 then round((w - 1e0) * (h - 1e0), 6) end as narrower from rect", "rect")
def mitred_buffers(v: Views) -> DataFrame:
    """The boxes of all polygons moved out by one and in by a half, with mitred corners."""
    r = v.rect()
    p = lambda a, b: F.struct((F.col("x0") + a).alias("x"), (F.col("y0") + b).alias("y"))
    w, h, z = F.col("w"), F.col("h"), F.lit(0.0)
    boxes = r.select("geom_id", F.array(p(z, z), p(w, z), p(w, h), p(z, h), p(z, z)).alias("ring"))
    wide = polygons.buffered(boxes, 1.0).withColumnRenamed("moved", "wide")
    both = polygons.buffered(wide, -0.5)
    return both.select("geom_id", F.round(shape.ring_area(F.col("wide")), 6).alias("wider"), F.round(shape.ring_area(F.col("moved")), 6).alias("narrower"))
