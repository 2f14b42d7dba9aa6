"""Queries on masks, segmentation metrics and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels
from ..functions import tilemath as tm
from ..operators import masks, sampling
from .fixtures import Views
from .registry import query
from .shapes import with_ctes


@query(with_ctes("k as (select unnest(range(2)) as c)", "select t.c as truth, p.c as pred, count(l.id) as n from k t cross join k p left join labelled l on l.truth = t.c and l.pred = p.c group by 1, 2"), "labelled")
def confusion_matrix(v: Views) -> DataFrame:
    return masks.confusion(v.labelled(), 2)


SHIFTED = "sh as (select tile, v as truth, coalesce(lead(v) over (partition by tile, r order by c), 0) as pred from mask_px), k as (select unnest(range(4)) as c), h as (select t.c as truth, p.c as pred, count(s.tile) as n from k t cross join k p left join sh s on s.truth = t.c and s.pred = p.c group by 1, 2), rp as (select c as cls, (select n from h where truth = c and pred = c) as tp, (select sum(n) from h where pred = c) as p, (select sum(n) from h where truth = c) as a from k)"


def _shifted(v: Views) -> DataFrame:
    w = Window.partitionBy("tile", "r").orderBy("c")
    return v.mask_px().select("tile", F.col("v").alias("truth"), F.coalesce(F.lead("v").over(w), F.lit(0)).alias("pred"))


@query(with_ctes(SHIFTED, "select cls, tp, cast(p - tp as bigint) as fp, cast(a - tp as bigint) as fn, round(tp / (a + p - tp), 9) as iou, round(tp / p, 9) as precision_, round(tp / a, 9) as recall from rp"), "mask_px")
def class_report(v: Views) -> DataFrame:
    r = masks.class_report(masks.confusion(_shifted(v), 4))
    return r.select("cls", "tp", "fp", "fn", F.round("iou", 9).alias("iou"), F.round("precision", 9).alias("precision_"), F.round("recall", 9).alias("recall"))


@query(with_ctes(SHIFTED, "select round(avg(tp / (a + p - tp)), 9) as mean_iou, round(sum(tp) / sum(a), 9) as accuracy, round(avg(tp / a), 9) as mean_recall, round(sum(a / (select sum(a) from rp) * tp / (a + p - tp)), 9) as weighted_iou from rp"), "mask_px")
def iou(v: Views) -> DataFrame:
    s = masks.summary(masks.class_report(masks.confusion(_shifted(v), 4)))
    return s.select(*(F.round(c, 9).alias(c) for c in s.columns))


@query(with_ctes(SHIFTED, "select cls, tile, fail from (select cls, tile, fail, row_number() over (partition by cls order by fail desc, tile) as k from (select c as cls, tile, count(*) filter (where (truth = c) <> (pred = c)) as fail from sh, k group by c, tile) q where fail > 0) t where k <= 5"), "mask_px")
def worst_topn(v: Views) -> DataFrame:
    return sampling.worst(_shifted(v), 5)


@query(with_ctes(SHIFTED, "select tile, count(*) filter (where truth <> pred) as wrong, count(*) filter (where truth = pred) as correct from sh group by tile"), "mask_px")
def per_image_errors(v: Views) -> DataFrame:
    return masks.image_errors(_shifted(v))


@query(
    with_ctes(
        """s as (select *, (tile * 4096 + r) * 4096 + c as k from mask_px),
        nb as (select a.k as a, b.k as b from s a join s b on a.tile = b.tile and a.v = b.v and abs(a.r - b.r) + abs(a.c - b.c) = 1)""",
        """, reach(node, root) as (select k, k from s union select nb.b, reach.root from reach join nb on nb.a = reach.node where reach.root < nb.b), cp as (select node, min(root) as component from reach group by node)
        select component, min(tile) as tile, min(v) as v, count(*) as area, min(r) as top, max(r) as bottom, min(c) as "left", max(c) as "right" from s join cp on cp.node = s.k group by component""",
    ),
    "mask_px",
)
def mask_components(v: Views) -> DataFrame:
    return masks.component_areas(v.mask_px())


@query()
def mask_components_whole(v: Views) -> DataFrame:
    """``mask_components`` without SQL, which walks every link of all tiles."""
    return masks.component_areas(v.mask_px())


@query(with_ctes("n as (select tile, r, c, v, lead(v) over (partition by tile, r order by c) as e, lag(v) over (partition by tile, r order by c) as w, lead(v) over (partition by tile, c order by r) as s, lag(v) over (partition by tile, c order by r) as n from mask_px)", "select tile, v, cast(sum(cast(coalesce(e <> v, true) as int) + cast(coalesce(w <> v, true) as int) + cast(coalesce(s <> v, true) as int) + cast(coalesce(n <> v, true) as int)) as bigint) as edges from n group by tile, v having edges > 0"), "mask_px")
def polygon_outline(v: Views) -> DataFrame:
    return masks.boundary_edges(v.mask_px()).groupBy("tile", "v").agg(F.count(F.lit(1)).alias("edges"))


BMAP = "b1 as (select tile, r, c, v = 1 as b from mask_px), bm as (select x.tile, x.r, x.c from b1 x left join b1 e on e.tile = x.tile and e.r = x.r and e.c = x.c + 1 left join b1 s on s.tile = x.tile and s.r = x.r + 1 and s.c = x.c left join b1 q on q.tile = x.tile and q.r = x.r + 1 and q.c = x.c + 1 where coalesce(e.b <> x.b, false) or coalesce(s.b <> x.b, false) or coalesce(q.b <> x.b, false))"


@query(with_ctes(BMAP, "select tile, r, c from bm"), "mask_px")
def boundary_map(v: Views) -> DataFrame:
    return masks.boundary_map(v.mask_px(), 1)


DISK = "o as (select a.i - 2 as dr, b.i - 2 as dc from (select unnest(range(5)) as i) a, (select unnest(range(5)) as i) b where (a.i - 2) * (a.i - 2) + (b.i - 2) * (b.i - 2) <= 4)"


@query(with_ctes(DISK, "select distinct tile, r + dr as r, c + dc as c from mask_px, o where v = 3 and r + dr between 0 and 7 and c + dc between 0 and 7"), "mask_px")
def dilate(v: Views) -> DataFrame:
    return masks.dilate(v.mask_px().filter("v = 3"), 2, 8, 8)


@query(
    with_ctes(
        "p as (select tile, r, c from mask_px where v = 2), g as (select tile, r, c from mask_px where v = 3), "
        + DISK.replace("o as", "o as").replace("- 2", "- 1").replace("range(5)", "range(3)").replace("<= 4", "<= 1")
        + ", ph as (select p.*, exists (select 1 from g, o where g.tile = p.tile and g.r = p.r + dr and g.c = p.c + dc) as hit from p), gh as (select g.*, exists (select 1 from p, o where p.tile = g.tile and p.r = g.r + dr and p.c = g.c + dc) as hit from g), a as (select tile, avg(cast(hit as double)) as pr from ph group by tile), b as (select tile, avg(cast(hit as double)) as re from gh group by tile)",
        "select tile, round(case when pr is null or re is null then 0e0 when pr + re = 0 then 0e0 else 2e0 * pr * re / (pr + re) end, 9) as f from a full join b using (tile)",
    ),
    "mask_px",
)
def boundary_f(v: Views) -> DataFrame:
    px = v.mask_px()
    found = masks.boundary_f(px.filter("v = 2").select("tile", "r", "c"), px.filter("v = 3").select("tile", "r", "c"), 1, 8, 8)
    return found.select("tile", F.round("f", 9).alias("f"))


@query("select vec_id, list_position(l, list_max(l)) - 1 as cls, round(1e0 / list_sum(list_transform(l, lambda e: exp(e - list_max(l)))), 6) as prob from (select vec_id, list_transform(embedding[1:4], lambda e: cast(e as double)) as l from embeddings) t")
def argmax_softmax(v: Views) -> DataFrame:
    logits = F.transform(F.slice("embedding", 1, 4), lambda e: e.cast("double"))
    t = v.table("embeddings").select("vec_id", masks.softmax(logits).alias("p"))
    return t.select("vec_id", masks.argmax(F.col("p")).alias("cls"), F.round(F.array_max("p"), 6).alias("prob"))


@query("select tile, cast(floor(r / 4e0) as bigint) as tr, cast(floor(c / 4e0) as bigint) as tc, v, cast(floor(avg(r)) as bigint) as cr, cast(floor(avg(c)) as bigint) as cc from mask_px group by 1, 2, 3, 4", "mask_px")
def class_centroids(v: Views) -> DataFrame:
    return masks.class_centroids(v.mask_px(), 4)


@query("select v, count(*) as n, round(1e0 * (1e0 - count(*) / sum(count(*)) over ()) + 1e0, 9) as weight from mask_px group by v", "mask_px")
def class_weights(v: Views) -> DataFrame:
    return masks.class_weights(v.mask_px()).select("v", "n", F.round("weight", 9).alias("weight"))


@query("select tile, round(avg(case when v = 0 then 1e0 else 0e0 end), 9) as black from mask_px group by tile having avg(case when v = 0 then 1e0 else 0e0 end) > 0.25e0", "mask_px")
def black_ratio_filter(v: Views) -> DataFrame:
    return masks.mostly_black(v.mask_px()).select("tile", F.round("black", 9).alias("black"))


@query("select tile, r, c, round((v * 80e0 / 255e0 - 0.485e0) / 0.229e0, 9) as normal, floor(0.3e0 * (v * 80e0) + 0.7e0 * 50e0 + 0.5e0) as blended, 255 - v * 80 as inverted, 7 - c as flipped, v + 1 as raw_id from mask_px", "mask_px")
def pixel_point_ops(v: Views) -> DataFrame:
    value = F.col("v") * 80.0
    return v.mask_px().select("tile", "r", "c", F.round(pixels.normalised(value, 0), 9).alias("normal"), pixels.blended(value, F.lit(pixels.GRAY), 0.7).cast("double").alias("blended"), pixels.inverted(F.col("v") * 80).alias("inverted"), pixels.flipped(F.col("c"), 8).alias("flipped"), pixels.raw_id(F.col("v")).alias("raw_id"))


@query("select id, r0, c0, least(16, h - r0) as height, least(16, w - c0) as width from (select id, h, w, r0, unnest(range(0, greatest(cast(ceil((w - 16) / 8e0) as int), 0) * 8 + 1, 8)) as c0 from (select p_partkey as id, p_size as h, p_size + 5 as w, unnest(range(0, greatest(cast(ceil((p_size - 16) / 8e0) as int), 0) * 8 + 1, 8)) as r0 from part) a) b")
def sliding_windows(v: Views) -> DataFrame:
    sizes = v.table("part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("h"), (F.col("p_size") + 5).alias("w"))
    return masks.sliding_windows(sizes, 16, 8)


@query("select seq, round(sum(val * n) over w / sum(n) over w, 6) as mean from metric_stream window w as (order by seq rows between unbounded preceding and current row)", "metric_stream")
def weighted_running_mean(v: Views) -> DataFrame:
    return sampling.running_mean(v.metric_stream()).select("seq", F.round("mean", 6).alias("mean"))


@query("select seq from (select seq, row_number() over (order by seq) as i from metric_stream) t where i = 1 or (i * 20) // 100 > ((i - 1) * 20) // 100", "metric_stream")
def systematic_sample(v: Views) -> DataFrame:
    return sampling.systematic(v.metric_stream(), "seq", 20).select("seq")


@query("select seq, (row_number() over (order by seq) - 1) % 4 as shard from metric_stream", "metric_stream")
def rank_shard(v: Views) -> DataFrame:
    return sampling.sharded(v.metric_stream(), "seq", 4).select("seq", "shard")


@query("select cast(floor(col / greatest(floor(700 / 64e0), 1)) as bigint) as batch, count(*) as n from tile group by 1", "tile")
def column_batches(v: Views) -> DataFrame:
    return sampling.column_batches(v.tile(), 64, 700).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, case when k <= floor(n * 0.8e0) then 'train' else 'val' end as part from (select doc_id, row_number() over (order by (doc_id * 2654435761) % 4294967296, doc_id) as k, count(*) over () as n from documents) t")
def seeded_split(v: Views) -> DataFrame:
    return sampling.split(v.table("documents").select("doc_id"), "doc_id", 0.8)


@query("select o_orderkey, case when n < 1 then 0 else floor(log2(n) / 10e0 + 1e-12) end as power from (select o_orderkey, cast(floor(o_totalprice) as bigint) * 1000 as n from orders) t")
def human_bytes_power(v: Views) -> DataFrame:
    n = F.floor("o_totalprice") * 1000
    unit = F.element_at(F.split(tm.human_bytes(n), " "), -1)
    power = F.array_position(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), unit) - 1
    return v.table("orders").select("o_orderkey", power.cast("double").alias("power"))
