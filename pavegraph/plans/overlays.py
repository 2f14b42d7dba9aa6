"""Queries on exact overlay of polygons: dissolving, closing by class, buffers, mending, layers over each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import table
from ..operators import overlay
from .fixtures import Views
from .registry import query
from .shapes import with_ctes
from .small import CELLS as ANY_CELLS

KIND = "case kind when 0 then 'sidewalk' when 1 then 'crosswalk' else 'road' end"
#: Half units of the plane that each class covers; the rectangles are moved together, so that they overlap.
DENSE = "(select * replace (floor(x0 / 4e0) as x0, floor(y0 / 4e0) as y0) from rect)"
CELLS = f"""c as (select distinct f_type, 2 * x0 + a as cx, 2 * y0 + b as cy from (select {KIND} as f_type, kind, w, x0, y0, h, unnest(range(cast(2 * w as bigint))) as a from {DENSE}) q, (select unnest(range(36)) as b) r
        where b < 2 * h and (kind = 0 or b < h or a < w)),
    o as (select x.i - 1 as dx, y.i - 1 as dy from (select unnest(range(3)) as i) x, (select unnest(range(3)) as i) y)"""


def classes(v: Views) -> DataFrame:
    """All polygons with their class, moved together."""
    name = F.element_at(F.array(*map(F.lit, ("sidewalk", "crosswalk", "road"))), (F.col("kind") + 1).cast("int"))
    r = v.rect().select("geom_id", (F.floor(F.col("x0") / 4) - F.col("x0")).alias("dx"), (F.floor(F.col("y0") / 4) - F.col("y0")).alias("dy"))
    moved = F.transform("ring", lambda p: F.struct((p["x"] + F.col("dx")).alias("x"), (p["y"] + F.col("dy")).alias("y")))
    return v.polygon().join(r, "geom_id").select("geom_id", name.alias("f_type"), F.array(moved).alias("rings"))


def totals(rings: DataFrame, *by: str) -> DataFrame:
    count = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).alias(name)
    return rings.groupBy(*by).agg(F.round(F.sum("area"), 3).alias("area"), count(F.col("area") > 0, "n_shells"), count(F.col("area") < 0, "n_holes"))


@query(
    with_ctes(
        CELLS
        + f""", b as (select geom_id * 2 as id, {KIND} as f_type, x0, y0, x0 + w as x1, y0 + case when kind = 0 then h else h / 2e0 end as y1 from {DENSE}
            union all select geom_id * 2 + 1, {KIND}, x0, y0 + h / 2e0, x0 + w / 2e0, y0 + h from {DENSE} where kind <> 0),
        lk as (select a.id as a, b.id as b from b a, b where a.f_type = b.f_type and a.id <> b.id and ((a.x0 < b.x1 and b.x0 < a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1) or (a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 < b.y1 and b.y0 < a.y1)))""",
        """, reach(node, root) as (select id, id from b union select lk.b, reach.root from reach join lk on lk.a = reach.node where reach.root < lk.b),
        top as (select node, min(root) as root from reach group by node),
        own as (select f_type, cx, cy, min(root) as root from (select b.f_type, top.root, 2 * b.x0 + a as cx, unnest(range(cast(2 * b.y0 as bigint), cast(2 * b.y1 as bigint))) as cy
            from (select id, f_type, x0, y0, y1, unnest(range(cast(2 * (x1 - x0) as bigint))) as a from b) b join top on top.node = b.id) t group by all),
        quad as (select f_type, cx + i as qx, cy + j as qy, count(*) as n, min(root) as lo, max(root) as hi, sum((i + j) % 2) as odd
            from own, (select unnest([0, 1]) as i) x, (select unnest([0, 1]) as j) y group by 1, 2, 3),
        turns as (select f_type, sum(case when n = 1 then 1 when n = 3 then -1 when n = 2 and odd <> 1 then 2 else 0 end) / 4 as euler, sum(case when n = 2 and odd <> 1 and lo = hi then 1 else 0 end) as pinched from quad group by f_type),
        shells as (select f_type, count(distinct root) as n from own group by f_type)
        select f_type, round(count(*) * 0.25e0, 3) as area, any_value(n) as n_shells, any_value(n - euler + pinched) as n_holes from c join turns using (f_type) join shells using (f_type) group by f_type""",
    ),
    "rect",
)
def exact_dissolve(v: Views) -> DataFrame:
    """The union of all polygons of each class; the oracle counts half units, their parts, and corners for Euler's formula."""
    return totals(overlay.dissolved(classes(v)), "f_type")


@query(
    with_ctes(
        CELLS,
        """, q as (select f_type, cx + dx as cx, cy + dy as cy, -dx as dx, -dy as dy from c, o where (dx, dy) <> (0, 0) and not exists (select 1 from c d where d.f_type = c.f_type and d.cx = c.cx + o.dx and d.cy = c.cy + o.dy)),
        f as (select f_type, cx, cy from c union all select f_type, cx, cy from q group by 1, 2, 3
            having bool_or(dx >= 0 and dy >= 0) and bool_or(dx >= 0 and dy <= 0) and bool_or(dx <= 0 and dy >= 0) and bool_or(dx <= 0 and dy <= 0)),
        u as (select f.cx + dx as cx, f.cy + dy as cy, -dx as dx, -dy as dy from f, o where f_type = 'crosswalk' and (dx, dy) <> (0, 0) and not exists (select 1 from f d where d.f_type = 'crosswalk' and d.cx = f.cx + o.dx and d.cy = f.cy + o.dy)),
        m as (select sum(case when dx = 0 or dy = 0 then 0.02e0 else 0 end) + 0.0025e0 * (select count(*) from (select distinct cx, cy, x.s, y.s as t from u, (select unnest([-1, 1]) as s) x, (select unnest([-1, 1]) as s) y where dx in (0, x.s) and dy in (0, y.s))) as more from u)
        select f_type, round(count(*) * 0.25e0 + case when f_type = 'crosswalk' then (select more from m) else 0e0 end, 3) as area from f group by f_type""",
    ),
    "rect",
)
def closed_classes(v: Views) -> DataFrame:
    """Buffer, union and erosion with each class's own distances.

    Gaps of half a unit close, wider ones do not. Where the way back is shorter, outlines are 0.05 further out.
    """
    return overlay.closed_by_class(classes(v)).groupBy("f_type").agg(F.round(F.sum("area"), 3).alias("area"))


@query(with_ctes(CELLS, "select f_type, round(count(*) * 0.25e0, 3) as area from c group by f_type"), "rect")
def merged_classes(v: Views) -> DataFrame:
    """Two result sets, of even and odd ids, merged and dissolved by class."""
    layer = classes(v)
    return overlay.merged_by_class(layer.filter("geom_id % 2 = 0"), layer.filter("geom_id % 2 = 1")).groupBy("f_type").agg(F.round(F.sum("area"), 3).alias("area"))


@query(
    with_ctes(
        CELLS,
        """, s as (select cx, cy, max(case when f_type = 'sidewalk' then 1 else 0 end) as a, max(case when f_type <> 'sidewalk' then 1 else 0 end) as b from c group by 1, 2)
        select how, round(sum(case how when 'union' then 1 when 'intersection' then a * b when 'difference' then a * (1 - b) else a + b - 2 * a * b end) * 0.25e0, 3) as area
        from s, (select unnest(['union', 'intersection', 'difference', 'symmetric']) as how) h group by how""",
    ),
    "rect",
)
def layer_overlay(v: Views) -> DataFrame:
    """Rectangles over L-shapes: what is in either, in both, in the first alone, in one alone."""
    layer = table(classes(v).withColumn("all", F.lit(1)))
    a, b = (overlay.directed(layer.filter(f"f_type {op} 'sidewalk'"), "all") for op in ("=", "<>"))
    hows = ("union", "intersection", "difference", "symmetric")
    found = overlay.overlays(a, b, hows, "all").groupBy("how").agg(F.sum("area").alias("area"))
    named = v.spark.createDataFrame([(how,) for how in hows], "how string")
    return named.join(found, "how", "left").select("how", F.round(F.coalesce("area", F.lit(0.0)), 3).alias("area"))


#: One polygon each: a cell wide enough for most.
EACH = {"cell": 256.0}


@query(
    """select geom_id, round(case when kind = 0 then (w + 0.8e0) * (h + 0.8e0) else (w + 0.8e0) * (h / 2e0 + 0.8e0) + (w / 2e0 + 0.8e0) * h / 2e0 end, 3) as wider,
    round(case when kind = 0 then greatest(w - 0.8e0, 0) * greatest(h - 0.8e0, 0)
        else greatest(w - 0.8e0, 0) * greatest(h / 2e0 - 0.8e0, 0) + greatest(w / 2e0 - 0.8e0, 0) * (greatest(h - 0.8e0, 0) - greatest(h / 2e0 - 0.8e0, 0)) end, 3) as narrower from rect""",
    "rect",
)
def concave_buffers(v: Views) -> DataFrame:
    """Mitred buffers of every polygon, rectangle or L-shape, 0.4 outwards and inwards."""
    rings = table(overlay.directed(classes(v), "geom_id"))
    total = lambda f, name: f(rings, 0.4, "geom_id", **EACH).groupBy("geom_id").agg(F.sum("area").alias(name))
    both = total(overlay.grown, "wider").join(total(overlay.shrunk, "narrower"), "geom_id", "left")
    return both.select("geom_id", F.round("wider", 3).alias("wider"), F.round(F.coalesce("narrower", F.lit(0.0)), 3).alias("narrower"))


@query("select geom_id as line_id, round((w + 1e0) * 1e0 + h * 1e0, 3) as area from rect", "rect")
def buffered_lines(v: Views) -> DataFrame:
    """Lines along two sides of every rectangle, half a unit wide to either side, with square ends."""
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    pts = F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + w).alias("x"), y.alias("y")), F.struct((x + w).alias("x"), (y + h).alias("y")))
    return overlay.line_buffers(v.rect().select(F.col("geom_id").alias("line_id"), pts.alias("pts")), 0.5, **EACH).groupBy("line_id").agg(F.round(F.sum("area"), 3).alias("area"))


@query("select geom_id, round(w * h / 2e0, 3) as area, 2 as n_shells, 0 as n_holes from rect", "rect")
def mended_rings(v: Views) -> DataFrame:
    """Bow-ties, two of whose sides cross in the middle, as two triangles each."""
    corner = lambda a, b: F.struct((F.col("x0") + a).alias("x"), (F.col("y0") + b).alias("y"))
    zero, w, h = F.lit(0.0), F.col("w"), F.col("h")
    ties = v.rect().select("geom_id", F.array(F.array(corner(zero, zero), corner(w, h), corner(w, zero), corner(zero, h), corner(zero, zero))).alias("rings"))
    return totals(overlay.mended(ties, "geom_id", **EACH), "geom_id")


@query(with_ctes(ANY_CELLS.replace("from rect)", f"from {DENSE})"), "select round(count(*) * 0.25e0, 3) as area from c"), "rect")
def nested_polygons(v: Views) -> DataFrame:
    """The union of everything as polygons, holes within their outer rings; none gets lost."""
    layer = classes(v).withColumn("all", F.lit(1))
    return overlay.nested(overlay.dissolved(layer, "all"), "all").agg(F.round(F.sum("area"), 3).alias("area"))
