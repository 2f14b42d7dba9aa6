"""Queries on point operations, layers, lists and dissolved polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels
from ..functions.storage import table
from ..operators import dissolve
from ..sources import catalog, paths, vectors
from .fixtures import Views
from .registry import query
from .shapes import with_ctes


@query("select tile, r, c, array_to_string(list_transform(range(5), lambda k: cast(k = v as int)), '') as flags from mask_px", "mask_px")
def one_hot(v: Views) -> DataFrame:
    return v.mask_px().select("tile", "r", "c", F.array_join(pixels.one_hot(F.col("v"), 4).cast("array<string>"), "").alias("flags"))


@query("select tile, r, c, case v when 0 then '0000ff' when 1 then '008000' when 2 then 'ff0000' else '000000' end as colour, v as cls from mask_px", "mask_px")
def palette(v: Views) -> DataFrame:
    painted = v.mask_px().withColumn("colour", pixels.colour(F.col("v")))
    return painted.select("tile", "r", "c", "colour", pixels.class_of_colour(F.col("colour")).cast("int").alias("cls"))


@query("select event_id, round(0.01e0 * pow(1e0 - (event_id % 175) / 175e0, 2e0), 12) as rate from events")
def learning_rate(v: Views) -> DataFrame:
    return v.table("events").select("event_id", F.round(pixels.polynomial_rate(0.01, F.col("event_id") % 175, 175, 2.0), 12).alias("rate"))


@query("select vec_id, round(a1 * p1 + (1e0 - a1) * (a2 * p2 + (1e0 - a2) * p3), 9) as fused from (select vec_id, cast(embedding[1] as double) as p1, cast(embedding[2] as double) as p2, cast(embedding[3] as double) as p3, abs(cast(embedding[4] as double)) as a1, abs(cast(embedding[5] as double)) as a2 from embeddings) t")
def scale_fusion(v: Views) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    return v.table("embeddings").select("vec_id", F.round(pixels.fused(F.slice(e, 1, 3), F.transform(F.slice(e, 4, 3), F.abs)), 9).alias("fused"))


@query("select source, side from (select source, 'missing' as side from (" + catalog.values_sql() + ") a where source > 'm' union all select 'old', 'stale') t")
def catalog_diff(v: Views) -> DataFrame:
    wanted = catalog.sources(v.spark)
    cached = wanted.filter("source <= 'm'").select("source").union(v.spark.createDataFrame([("old",)], "source string"))
    return catalog.difference(wanted, cached)


@query("select f_type, count(*) as n, count(w) as with_width from (select 'sidewalk' as f_type, w from rect where kind = 0 union all select 'road', null from rect where kind = 2) t group by f_type", "rect")
def union_layers(v: Views) -> DataFrame:
    r = v.rect()
    layers = vectors.union_layers({"sidewalk": r.filter("kind = 0").select("w"), "road": r.filter("kind = 2").select("geom_id")})
    return layers.groupBy("f_type").agg(F.count(F.lit(1)).alias("n"), F.count("w").alias("with_width"))


@query("select count(*) as n from (select lead(x) over (partition by geom_id order by vtx_no) as nx from vertex) t where nx is not null", "vertex")
def drop_nulls(v: Views) -> DataFrame:
    """Sides of rings: vertices of which the next one is there."""
    from pyspark.sql import Window

    w = Window.partitionBy("geom_id").orderBy("vtx_no")
    return vectors.complete(v.vertex().withColumn("nx", F.lead("x").over(w))).agg(F.count(F.lit(1)).alias("n"))


@query("select p_partkey as stem, 'img/' || p_partkey || '.png' as image, 'ann/' || p_partkey || '.png' as mask from part where p_partkey % 3 = 0")
def image_mask_pairs(v: Views) -> DataFrame:
    named = lambda folder: v.table("part").select(F.concat(F.lit(folder), F.col("p_partkey").cast("string"), F.lit(".png")).alias("path"), "p_partkey")
    pairs = paths.images_with_masks(named("img/").select("path"), named("ann/").filter("p_partkey % 3 = 0").select("path"))
    return pairs.select(F.col("stem").cast("long").alias("stem"), "image", "mask")


@query("select n_name, case n_nationkey % 4 when 0 then 'png' when 1 then 'jpeg' when 2 then 'tiff' end as ext from nation")
def content_types(v: Views) -> DataFrame:
    kinds = F.array(*map(F.lit, ("image/png", "image/jpeg; charset=x", "IMAGE/TIFF", "text/html")))
    return v.table("nation").select("n_name", catalog.extension_of(F.element_at(kinds, (F.col("n_nationkey") % 4 + 1).cast("int"))).alias("ext"))


@query("select p_partkey, sha256(p_name) as digest from part")
def content_digest(v: Views) -> DataFrame:
    return v.table("part").select("p_partkey", paths.digest(F.col("p_name")).alias("digest"))


@query("select cls, '<tr><td>' || cls || '</td><td>' || n || '</td></tr>' as html from (select v as cls, count(*) as n from mask_px group by v) t", "mask_px")
def results_rows(v: Views) -> DataFrame:
    counted = v.mask_px().groupBy(F.col("v").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("cls", vectors.html_row("cls", "n").alias("html"))


CELLS = """c as (select distinct 2 * x0 + a as cx, 2 * y0 + b as cy from (select kind, w, x0, y0, h, unnest(range(cast(2 * w as bigint))) as a from rect) q, (select unnest(range(36)) as b) r where b < 2 * h and (kind = 0 or b < h or a < w)),
    o as (select x.i - 1 as dx, y.i - 1 as dy from (select unnest(range(3)) as i) x, (select unnest(range(3)) as i) y),
    d as (select distinct cx + dx as cx, cy + dy as cy from c, o), e as (select cx + dx as cx, cy + dy as cy, count(*) as n from d, o group by 1, 2 having count(*) = 9)"""


@query(with_ctes(CELLS, "select (select count(*) from c) as covered, (select count(*) from d) as buffered, (select count(*) from e) as closed"), "rect")
def buffer_union_erode(v: Views) -> DataFrame:
    """Cells of half a unit that all polygons cover, with a cell around them, and without it again."""
    layer = v.polygon().select(F.lit("any").alias("f_type"), "ring")
    count = lambda runs, name: runs.agg(dissolve.n_cells().alias(name))
    runs = table(dissolve.runs(layer, 0.5))
    wide = table(dissolve.wider(runs, 1))
    return count(runs, "covered").crossJoin(count(wide, "buffered")).crossJoin(count(dissolve.narrower(wide, 1), "closed"))  # three single rows


@query(
    with_ctes(
        "b as (select geom_id * 2 as id, x0, y0, x0 + w as x1, y0 + case when kind = 0 then h else h / 2e0 end as y1 from rect union all select geom_id * 2 + 1, x0, y0 + h / 2e0, x0 + w / 2e0, y0 + h from rect where kind <> 0), lk as (select a.id as a, b.id as b from b a, b where a.id <> b.id and ((a.x0 < b.x1 and b.x0 < a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1) or (a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 < b.y1 and b.y0 < a.y1)))",
        ", reach(node, root) as (select id, id from b union select lk.b, reach.root from reach join lk on lk.a = reach.node where reach.root < lk.b) select count(distinct root) as parts from (select node, min(root) as root from reach group by node) t",
    ),
    "rect",
)
def dissolved_parts(v: Views) -> DataFrame:
    """Connected parts of a union of polygons, counted on cells; the oracle links their rectangles that share area or a side."""
    layer = v.polygon().select(F.lit("any").alias("f_type"), "ring")
    return dissolve.run_parts(table(dissolve.runs(layer, 0.5))).agg(F.count(F.lit(1)).alias("parts"))
