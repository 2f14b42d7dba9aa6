"""Queries on polygons: ring metrics, angles, hulls, boxes and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shape
from ..functions import tilemath as tm
from ..operators import spatial
from .fixtures import Views
from .registry import query

EDGES = "e as (select *, lead(x) over (partition by geom_id order by vtx_no) as x2, lead(y) over (partition by geom_id order by vtx_no) as y2 from vertex)"
METRICS = f"{EDGES}, m as (select geom_id, abs(sum(x * y2 - x2 * y)) / 2e0 as area, sum(sqrt(pow(x2 - x, 2) + pow(y2 - y, 2))) as perimeter, sum((x + x2) * (x * y2 - x2 * y)) / (3e0 * sum(x * y2 - x2 * y)) as cx, sum((y + y2) * (x * y2 - x2 * y)) / (3e0 * sum(x * y2 - x2 * y)) as cy, count(*) as n_edges from e where x2 is not null group by geom_id)"
OPEN = "o as (select *, first_value(x) over w as fx, first_value(y) over w as fy, last_value(x) over w as lx, last_value(y) over w as ly from (select * from vertex where vtx_no < 6) q window w as (partition by geom_id order by vtx_no rows between unbounded preceding and unbounded following)), n as (select geom_id, vtx_no, x, y, coalesce(lag(x) over v, lx) - x as ux, coalesce(lag(y) over v, ly) - y as uy, coalesce(lead(x) over v, fx) - x as vx, coalesce(lead(y) over v, fy) - y as vy from o window v as (partition by geom_id order by vtx_no)), a as (select *, degrees(acos(least(greatest((ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy)), -1e0), 1e0))) as angle from n)"

CIRCLES = """hp as (select geom_id, vtx_no as i, x - x0 as x, y - y0 as y from vertex join rect using (geom_id) where vtx_no < 6),
    pr as (select a.geom_id, (a.x + b.x) / 2e0 as cx, (a.y + b.y) / 2e0 as cy, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 2e0 as r from hp a join hp b on a.geom_id = b.geom_id and a.i < b.i),
    tr as (select a.geom_id, a.x as ax, a.y as ay, b.x as bx, b.y as by_, c.x as cx, c.y as cy, 2e0 * (a.x * (b.y - c.y) + b.x * (c.y - a.y) + c.x * (a.y - b.y)) as d from hp a join hp b on a.geom_id = b.geom_id and a.i < b.i join hp c on c.geom_id = b.geom_id and b.i < c.i),
    ce as (select geom_id, ax, ay, ((ax * ax + ay * ay) * (by_ - cy) + (bx * bx + by_ * by_) * (cy - ay) + (cx * cx + cy * cy) * (ay - by_)) / d as ux, ((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by_ * by_) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / d as uy from tr where d <> 0),
    cd as (select geom_id, cx, cy, r from pr union all select geom_id, ux, uy, sqrt(pow(ax - ux, 2) + pow(ay - uy, 2)) from ce),
    ok as (select cd.geom_id, cd.r from cd join hp using (geom_id) group by cd.geom_id, cd.cx, cd.cy, cd.r having max(sqrt(pow(hp.x - cd.cx, 2) + pow(hp.y - cd.cy, 2))) <= cd.r + 1e-6),
    circ as (select geom_id, min(r) as radius from ok group by geom_id)"""


def with_ctes(ctes: str, sql: str) -> str:
    """A query over further common table expressions; the registry puts the views in front."""
    return f", {ctes} {sql}"


@query(with_ctes(METRICS, "select geom_id, round(area, 4) as area, round(perimeter, 6) as perimeter, n_edges from m"), "vertex")
def ring_area_perimeter(v: Views) -> DataFrame:
    return shape.vertex_metrics(v.vertex()).select("geom_id", F.round("area", 4).alias("area"), F.round("perimeter", 6).alias("perimeter"), "n_edges")


@query(with_ctes(METRICS, "select geom_id, round(area, 4) as area, round(perimeter, 6) as perimeter from m"), "vertex")
def ring_area_nested(v: Views) -> DataFrame:
    return v.polygon().select("geom_id", F.round(shape.ring_area(F.col("ring")), 4).alias("area"), F.round(shape.line_length(F.col("ring")), 6).alias("perimeter"))


@query(with_ctes(METRICS, "select geom_id, round(cx, 6) as cx, round(cy, 6) as cy from m"), "vertex")
def ring_centroid(v: Views) -> DataFrame:
    return shape.vertex_metrics(v.vertex()).select("geom_id", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query(
    with_ctes(METRICS + ", " + CIRCLES, """select geom_id, round((perimeter * h + area) / pow(area * h, 2e0 / 3e0), 6) as form_factor, round(2e0 * ln(perimeter / 4e0) / ln(area), 6) as fractal,
        round(area * h / (perimeter * h), 6) as volume_facade, round(pow(4e0 * sqrt(area) / perimeter, 2e0), 6) as square_compactness, round((w * h - area) / area, 6) as courtyard,
        round(sqrt(area / pi()) / radius, 6) as shape_index, round(4e0 * area / perimeter, 6) as width, round(2e0 * sqrt(pi() * area) / perimeter, 6) as roundness
        from m join rect using (geom_id) join circ using (geom_id) where area > 1.5e0"""),
    "vertex",
)
def shape_simple(v: Views) -> DataFrame:
    """Closed-form descriptors; the courtyard is what a polygon leaves of its box, the longest axis its enclosing circle's."""
    from ..operators import polygons

    circles = polygons.enclosing_circles(v.polygon().select("geom_id", "ring")).select("geom_id", "radius")
    m = shape.vertex_metrics(v.vertex()).join(v.rect(), "geom_id").join(circles, "geom_id").filter("area > 1.5")
    found = shape.simple_metrics(F.col("area"), F.col("perimeter"), F.col("h"), F.lit(2.0) * F.col("radius"), F.col("w") * F.col("h") - F.col("area"))
    return m.select("geom_id", *(F.round(c, 6).alias(n) for n, c in found.items()))


@query(with_ctes(OPEN, "select geom_id, count(*) filter (where angle <= 170e0) as corners, round(avg(case when angle <= 175e0 then abs(90e0 - angle) end), 6) as squareness, count(*) filter (where angle between 80e0 and 100e0 or angle between 260e0 and 280e0) as right_angles from a group by geom_id"), "vertex")
def corners(v: Views) -> DataFrame:
    a = shape.corner_angles(v.vertex())
    angle = F.col("angle")
    return a.groupBy("geom_id").agg(
        F.count_if((angle <= 170) | (angle >= 190)).alias("corners"),
        F.round(F.avg(F.when(angle <= 175, F.abs(F.lit(90.0) - angle))), 6).alias("squareness"),
        F.count_if(shape.is_right_angle(angle)).alias("right_angles"),
    )


@query(with_ctes(METRICS + ", " + OPEN, "select geom_id, round(avg(sqrt(pow(x - cx, 2) + pow(y - cy, 2))), 5) as mean_distance, round(stddev_pop(sqrt(pow(x - cx, 2) + pow(y - cy, 2))), 5) as deviation from a join m using (geom_id) where angle <= 170e0 group by geom_id"), "vertex")
def centroid_corners(v: Views) -> DataFrame:
    vertices = v.vertex()
    found = shape.corner_distances(vertices)
    return found.select("geom_id", F.round("mean_distance", 5).alias("mean_distance"), F.round("deviation", 5).alias("deviation"))


@query(with_ctes(METRICS, """select geom_id, round(least(w, h) / greatest(w, h), 6) as elongation, round(area / (w * h), 6) as rectangularity, round(sqrt(area / (w * h)) * (2e0 * (w + h) / perimeter), 6) as eri,
    round(area / (case when kind = 0 then w * h else w * h * 0.875e0 end), 6) as convexity from m join rect using (geom_id)"""), "vertex")
def rectangle_metrics(v: Views) -> DataFrame:
    """Elongation, rectangularity and convexity from general hull and box kernels; the oracle knows the shapes' closed form."""
    from ..operators import polygons

    found = polygons.hulls_and_boxes(v.polygon().select("geom_id", "ring"))
    area, perimeter = shape.ring_area(F.col("ring")), shape.line_length(F.col("ring"))
    return found.select(
        "geom_id",
        F.round(shape.elongation(F.col("box_area"), F.col("box_perimeter")), 6).alias("elongation"),
        F.round(area / F.col("box_area"), 6).alias("rectangularity"),
        F.round(F.sqrt(area / F.col("box_area")) * (F.col("box_perimeter") / perimeter), 6).alias("eri"),
        F.round(area / F.col("hull_area"), 6).alias("convexity"),
    )


@query(with_ctes(CIRCLES, "select geom_id, round(area / (pi() * radius * radius), 6) as circular_compactness from (select geom_id, radius, case when kind = 0 then w * h else w * h * 0.75e0 end as area from rect join circ using (geom_id)) t"), "rect", "vertex")
def circular_compactness(v: Views) -> DataFrame:
    """Area over that of the least enclosing circle; the oracle tries every circle through two or three corners."""
    from ..operators import polygons

    circles = polygons.enclosing_circles(v.polygon().select("geom_id", "ring"))
    return circles.select("geom_id", F.round(shape.ring_area(F.col("ring")) / (F.lit(shape.PI) * F.pow("radius", F.lit(2.0))), 6).alias("circular_compactness"))


@query("select geom_id, round(case when w >= h then x0 else x0 + w / 2e0 end, 6) as ax, round(case when w >= h then y0 + h / 2e0 else y0 end, 6) as ay, round(case when w >= h then x0 + w else x0 + w / 2e0 end, 6) as bx, round(case when w >= h then y0 + h / 2e0 else y0 + h end, 6) as by_ from rect where w <> h", "rect")
def crosswalk_centerline(v: Views) -> DataFrame:
    """The middle line of each polygon's least box; a square has two and is left out."""
    from ..operators import polygons

    return polygons.mid_axes(v.polygon().join(v.rect().select("geom_id", "w", "h"), "geom_id").filter("w <> h").select("geom_id", "ring")).select("geom_id", *(F.round(c, 6).alias(c) for c in ("ax", "ay", "bx", "by_")))


@query("select geom_id, 1 + cast(w * h / 8e0 >= 25e0 as int) as rings from rect", "rect")
def fill_holes(v: Views) -> DataFrame:
    r = v.rect()
    p = lambda x, y: F.struct((F.col("x0") + x).alias("x"), (F.col("y0") + y).alias("y"))
    w, h, z = F.col("w") / 2.0, F.col("h") / 4.0, F.lit(0.0)
    outer, inner = F.array(p(z, z), p(F.col("w"), z), p(F.col("w"), F.col("h")), p(z, F.col("h")), p(z, z)), F.array(p(z, z), p(w, z), p(w, h), p(z, h), p(z, z))
    return r.select("geom_id", F.size(shape.fill_holes(F.array(outer, inner), F.lit(25.0))).alias("rings"))


@query("select geom_id, f_type from (select geom_id, case kind when 0 then 'sidewalk' when 1 then 'crosswalk' else 'road' end as f_type, w * h as area from rect) t where f_type = 'sidewalk' and area >= 20e0", "rect")
def class_and_area_filter(v: Views) -> DataFrame:
    from ..sources import vectors

    kinds = v.polygon().select("geom_id", F.element_at(F.array(*map(F.lit, ("sidewalk", "crosswalk", "road"))), (F.col("kind") + 1).cast("int")).alias("f_type"), "ring")
    return vectors.class_layer(kinds, "sidewalk", 20.0).select("geom_id", "f_type")


@query(with_ctes(METRICS, "select round(quantile_cont(area, 0.25), 6) as a1, round(quantile_cont(area, 0.5), 6) as a2, round(quantile_cont(area, 0.75), 6) as a3, round(quantile_cont(perimeter, 0.5), 6) as p2, round(quantile_cont(area / perimeter, 0.5), 6) as r2 from m"), "vertex")
def quartile_stats(v: Views) -> DataFrame:
    q = shape.vertex_metrics(v.vertex()).agg(F.percentile("area", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("a"), F.percentile("perimeter", F.lit(0.5)).alias("p2"), F.percentile(F.col("area") / F.col("perimeter"), F.lit(0.5)).alias("r2"))
    return q.select(*(F.round(F.col("a")[i], 6).alias(f"a{i + 1}") for i in range(3)), F.round("p2", 6).alias("p2"), F.round("r2", 6).alias("r2"))


@query(with_ctes(METRICS, "select geom_id, roundness > 0.8e0 as near_circle, case when roundness > 0.8e0 then round(sqrt(area / pi()) / 4e0, 6) else 0.2e0 end as spacing from (select geom_id, area, 2e0 * sqrt(pi() * area) / perimeter as roundness from m) t"), "vertex")
def centerline_spacing(v: Views) -> DataFrame:
    m = shape.vertex_metrics(v.vertex())
    roundness = F.lit(2.0) * F.sqrt(F.lit(shape.PI) * F.col("area")) / F.col("perimeter")
    return m.select("geom_id", (roundness > 0.8).alias("near_circle"), F.when(roundness > 0.8, F.round(F.sqrt(F.col("area") / F.lit(shape.PI)) / 4.0, 6)).otherwise(0.2).alias("spacing"))


@query("select a.geom_id as left_id, b.geom_id as right_id, (least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0)) * (least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0)) as overlap from rect a, rect b where a.geom_id < b.geom_id and greatest(a.x0, b.x0) < least(a.x0 + a.w, b.x0 + b.w) and greatest(a.y0, b.y0) < least(a.y0 + a.h, b.y0 + b.h)", "rect")
def box_overlap_join(v: Views) -> DataFrame:
    b = v.rect().select(F.col("geom_id").alias("id"), F.col("x0").alias("west"), F.col("y0").alias("south"), (F.col("x0") + F.col("w")).alias("east"), (F.col("y0") + F.col("h")).alias("north"))
    return spatial.boxes_overlapping(b, b, 64.0).filter("left_id < right_id")


@query("select c.geom_id as median from (select a.geom_id, count(*) as n, min(a.w * a.h) as area from dense_rect a, dense_rect b where a.kind = 1 and b.kind = 0 and greatest(a.x0, b.x0) < least(a.x0 + a.w, b.x0 + b.w) and greatest(a.y0, b.y0) < least(a.y0 + a.h, b.y0 + b.h) group by a.geom_id) c where n >= 2 and area < 230e0", "dense_rect")
def median_islands(v: Views) -> DataFrame:
    """Boxes of one class that meet at least two of another and are small."""
    r = v.dense_rect()
    box = lambda k: r.filter(F.col("kind") == k).select(F.col("geom_id").alias("id"), F.col("x0").alias("west"), F.col("y0").alias("south"), (F.col("x0") + F.col("w")).alias("east"), (F.col("y0") + F.col("h")).alias("north"))
    met = spatial.boxes_overlapping(box(1), box(0), 64.0).groupBy(F.col("left_id").alias("geom_id")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return met.join(r, "geom_id").filter(F.col("w") * F.col("h") < 230.0).select(F.col("geom_id").alias("median"))


@query("select a.id, round(b, 6) as bearing from (select id, case when d < 0e0 then d + 360e0 else d end as b from (select p.id, degrees(atan2(sin(radians(q.lon - p.lon)) * cos(radians(q.lat)), cos(radians(p.lat)) * sin(radians(q.lat)) - sin(radians(p.lat)) * cos(radians(q.lat)) * cos(radians(q.lon - p.lon)))) as d from geo_point p join geo_point q on q.id = p.id + 1) t) a", "geo_point")
def bearing(v: Views) -> DataFrame:
    p = v.geo_point()
    q = p.select((F.col("id") - 1).alias("id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return p.join(q, "id").select("id", F.round(tm.bearing(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 6).alias("bearing"))
