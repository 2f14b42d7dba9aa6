"""Queries on training relations: losses, weights, schedules, sampling and augmentation parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels, training as tr
from ..operators import masks, training
from .fixtures import Views
from .registry import query
from .shapes import with_ctes

LOGITS = "lg as (select vec_id, list_transform(embedding[1:4], lambda e: cast(e as double)) as l, abs(vec_id) % 4 as t from embeddings)"


def _logits(v: Views) -> DataFrame:
    return v.table("embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda e: e.cast("double")).alias("l"), (F.abs("vec_id") % 4).cast("int").alias("t"))


@query("with " + LOGITS + " select vec_id, round(case when t <> 3 then ln(list_sum(list_transform(l, lambda e: exp(e - list_max(l))))) - (l[t + 1] - list_max(l)) end, 6) as loss from lg")
def cross_entropy(v: Views) -> DataFrame:
    """The loss of each pixel, null where its label is ignored."""
    return _logits(v).select("vec_id", F.round(tr.cross_entropy(F.col("l"), F.col("t"), 3), 6).alias("loss"))


@query("with " + LOGITS + ", s as (select vec_id, t, list_transform(l, lambda e: exp(e) / list_sum(list_transform(l, lambda x: exp(x)))) as p from lg) select vec_id, round(ln(greatest(p[1], p[1] + p[t + 1] * (t > 0)::int)), 6) as first, round(ln(p[4] * (t < 3)::int + (p[1] + p[4]) * (t = 3)::int), 6) as last from s")
def border_softmax(v: Views) -> DataFrame:
    """Log probabilities at borders of class 0 with each pixel's own class, which share their sum."""
    flags = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: ((k == 0) | (k == F.col("t"))).cast("double"))
    out = tr.border_softmax(masks.softmax(F.col("l")), flags)
    return _logits(v).select("vec_id", F.round(F.element_at(out, 1), 6).alias("first"), F.round(F.element_at(out, 4), 6).alias("last"))


BINARY = "bp as (select tile, r, c, v, case v when 0 then 0 when 3 then 1 else 255 end as t, (v * 3 + r - c) / 4e0 as logit from mask_px), bb as (select tile, count(*) filter (where t = 0) / (count(*) filter (where t in (0, 1)) + 1e-8) as beta from bp group by tile)"


def _binary(v: Views) -> DataFrame:
    return v.mask_px().withColumn("t", F.when(F.col("v") == 0, 0).when(F.col("v") == 3, 1).otherwise(255)).withColumn("logit", (F.col("v") * 3 + F.col("r") - F.col("c")) / F.lit(4.0))


@query(with_ctes(BINARY, "select tile, round(beta, 9) as beta from bb"), "mask_px")
def class_balance(v: Views) -> DataFrame:
    return training.class_balance(_binary(v)).select("tile", F.round("beta", 9).alias("beta"))


@query(with_ctes(BINARY, "select tile, round(sum((greatest(logit, 0e0) - logit * t + ln(1e0 + exp(-abs(logit)))) * (1e0 - beta + (2e0 * beta - 1e0) * t)), 5) as loss from bp join bb using (tile) where t < 255 group by tile"), "mask_px")
def balanced_loss(v: Views) -> DataFrame:
    return training.balanced_loss(_binary(v).filter("t < 255")).select("tile", F.round("loss", 5).alias("loss"))


WEIGHTS = "iw as (select tile, k as v, case when n is null then 1e0 else 1e0 * (1e0 - n / 64e0) + 1e0 end as weight, case when n is null then 1e0 else 64e0 / n + 1e0 end as inverse from (select distinct tile from mask_px) t cross join (select unnest(range(4)) as k) q left join (select tile, v, count(*) as n from mask_px group by 1, 2) c on c.tile = t.tile and c.v = q.k)"


@query(with_ctes(WEIGHTS.replace("select tile, k as v", "select t.tile, k as v"), "select tile, v, round(weight, 9) as weight, round(inverse, 9) as inverse from iw"), "mask_px")
def image_class_weights(v: Views) -> DataFrame:
    """Class weights of each image by both formulas; classes without pixels weigh 1."""
    px = v.mask_px()
    other = training.image_weights(px, 4, inverse=True).withColumnRenamed("weight", "inverse")
    return training.image_weights(px, 4).join(other, ["tile", "v"]).select("tile", F.col("v").cast("long").alias("v"), F.round("weight", 9).alias("weight"), F.round("inverse", 9).alias("inverse"))


@query(with_ctes(WEIGHTS.replace("select tile, k as v", "select t.tile, k as v"), "select tile, round(sum(weight * (r + c) / 10e0) / sum(weight), 6) as loss from mask_px join iw using (tile, v) group by tile"), "mask_px")
def image_weighted_loss(v: Views) -> DataFrame:
    px = v.mask_px()
    return training.weighted_loss(px.withColumn("loss", (F.col("r") + F.col("c")) / F.lit(10.0)), training.image_weights(px, 4)).select("tile", F.round("loss", 6).alias("loss"))


@query(with_ctes("bm as (select x.tile, x.r, x.c from mask_px x left join mask_px e on e.tile = x.tile and e.r = x.r and e.c = x.c + 1 left join mask_px s on s.tile = x.tile and s.r = x.r + 1 and s.c = x.c left join mask_px q on q.tile = x.tile and q.r = x.r + 1 and q.c = x.c + 1 where coalesce((e.v = 1) <> (x.v = 1), false) or coalesce((s.v = 1) <> (x.v = 1), false) or coalesce((q.v = 1) <> (x.v = 1), false))", "select p.tile, round(sum(case when bm.r is null then 0e0 else (p.r + p.c) / 8e0 end) / count(*), 6) as loss from mask_px p left join bm using (tile, r, c) group by p.tile"), "mask_px")
def edge_weighted_loss(v: Views) -> DataFrame:
    """Mean loss of each image in which only the boundary of class 1 counts."""
    px = v.mask_px()
    return training.edge_weighted_loss(px.withColumn("loss", (F.col("r") + F.col("c")) / F.lit(8.0)), masks.boundary_map(px, 1)).select("tile", F.round("loss", 6).alias("loss"))


SHIFTS = "o as (select unnest([-1, -1, -1, 0, 0, 0, 1, 1, 1]) as dr, unnest([-1, 0, 1, -1, 0, 1, -1, 0, 1]) as dc)"


@query(with_ctes(SHIFTS + ", nb as (select p.tile, p.r, p.c, q.v from mask_px p cross join o join mask_px q on q.tile = p.tile and q.r = p.r + dr and q.c = p.c + dc where q.v <> 3)", "select p.tile, p.r, p.c, coalesce(classes, '') as classes from mask_px p left join (select tile, r, c, string_agg(distinct cast(v as varchar), '' order by cast(v as varchar)) as classes from nb group by 1, 2, 3) n using (tile, r, c)"), "mask_px")
def relaxed_borders(v: Views) -> DataFrame:
    """The classes around each pixel, which a relaxed loss accepts."""
    return training.relaxed_borders(v.mask_px(), 1, 3).select("tile", "r", "c", F.array_join(F.col("classes").cast("array<string>"), "").alias("classes"))


@query(with_ctes(SHIFTS + ", nb as (select p.tile, p.r, p.c, any_value(p.v) as own, max(q.v) as most, bool_or(q.v <> 0) as lit from mask_px p cross join o join mask_px q on q.tile = p.tile and q.r = p.r + dr and q.c = p.c + dc group by 1, 2, 3)", "select tile, r, c from nb where (most = own) <> (own = 0 and not lit)"), "mask_px")
def peaks(v: Views) -> DataFrame:
    return training.peaks(v.mask_px())


@query(with_ctes("vx as (select a.tile, a.v as v0, b.v as v1, c.v as v2, d.v as v3 from mask_px a join mask_px b on b.tile = a.tile and b.r = a.r and b.c = a.c + 1 join mask_px c on c.tile = a.tile and c.r = a.r + 1 and c.c = a.c join mask_px d on d.tile = a.tile and d.r = a.r + 1 and d.c = a.c + 1), ln_ as (select tile, row_number() over () as k, unnest([v0, v1, v2, v3]) as x, unnest([0, 1, 2, 3]) as i from vx)", "select p.tile, p.i, q.i as j, round(sum(p.x * q.x) - cast(sum(p.x) as double) * sum(q.x) / count(*), 6) as cov from (select tile, i, x, row_number() over (partition by tile, i order by k) as n from ln_) p join (select tile, i, x, row_number() over (partition by tile, i order by k) as n from ln_) q on q.tile = p.tile and q.n = p.n group by p.tile, p.i, q.i"), "mask_px")
def region_covariance(v: Views) -> DataFrame:
    """Covariances of the 2 x 2 regions of each mask."""
    found = training.region_covariance(v.mask_px().withColumn("value", F.col("v").cast("double")), 2)
    return found.select("tile", "i", "j", F.round("cov", 6).alias("cov"))


@query(
    with_ctes(
        """e as (select tile, r, c, (v * 2e0 + (r * c + tile) % 5) / 12e0 as prob, case when v >= 2 then 1e0 else 0e0 end as label from mask_px),
        w as (select a.tile, unnest(range(8)) as i, unnest([a.prob, b.prob, c.prob, d.prob, a.label, b.label, c.label, d.label]) as x, a.r * 8 + a.c as n from e a join e b on b.tile = a.tile and b.r = a.r and b.c = a.c + 1
            join e c on c.tile = a.tile and c.r = a.r + 1 and c.c = a.c join e d on d.tile = a.tile and d.r = a.r + 1 and d.c = a.c + 1),
        m as (select *, x - avg(x) over (partition by tile, i) as y from w),
        j as (select p.tile, p.i, q.i as j, sum(p.y * q.y) + case when p.i = q.i then 0.0005e0 else 0e0 end as v from m p join m q on q.tile = p.tile and q.n = p.n group by 1, 2, 3)""",
        """, reach(k, tile, i, j, v) as (select 0, tile, i, j, v from j union all
            select k + 1, tile, i, j, v - col * rw / pv from (select *, max(case when i = k and j = k then v end) over (partition by tile) as pv, max(case when j = k then v end) over (partition by tile, i) as col, max(case when i = k then v end) over (partition by tile, j) as rw from reach) s where i > k and j > k)
        select tile, round(sum(ln(v)) / 2e0, 6) as loss from reach where i = k and j = k and k >= 4 group by tile""",
    ),
    "mask_px",
)
def region_loss(v: Views) -> DataFrame:
    """The loss of 2 x 2 regions of each mask; the oracle eliminates the joint matrix row by row."""
    prob = (F.col("v") * 2.0 + (F.col("r") * F.col("c") + F.col("tile")) % 5) / 12.0
    px = v.mask_px().select("tile", "r", "c", (F.col("v") >= 2).cast("double").alias("label"), prob.alias("prob"))
    return training.region_loss(px, 2).select("tile", F.round("loss", 6).alias("loss"))


@query("select tile, cast(floor(r / 4e0) as bigint) as pr, cast(floor(c / 4e0) as bigint) as pc, round(avg(v), 9) as value from mask_px group by 1, 2, 3", "mask_px")
def pooled_masks(v: Views) -> DataFrame:
    return training.pooled(v.mask_px().withColumn("value", F.col("v").cast("double")), 4).select("tile", "pr", "pc", F.round("value", 9).alias("value"))


@query("select tile, r, c, case when (r * 8 + c) / 64e0 < 0.4e0 then 255 else v end as label from mask_px", "mask_px")
def refined_labels(v: Views) -> DataFrame:
    """Labels of which unsure ones become the label to ignore."""
    sure = (F.col("r") * 8 + F.col("c")) / F.lit(64.0)
    return v.mask_px().select("tile", "r", "c", tr.refined(F.col("v"), sure, 0.4, 255).alias("label"))


@query("select event_id, round(pow(1e0 - e / 175e0, 2e0), 12) as poly, round(case when e < 100 then pow(1e0 - e / 175e0, 1e0) else pow(1e0 - 100e0 / 175e0, 1e0) / pow(1e0 - 100e0 / 175e0, 3e0) * pow(1e0 - e / 175e0, 3e0) end, 12) as two_step from (select event_id, cast(event_id % 175 as double) as e from events) t")
def schedules(v: Views) -> DataFrame:
    e = (F.col("event_id") % 175).cast("double")
    return v.table("events").select("event_id", F.round(tr.poly_rate(e, 175, 2.0), 12).alias("poly"), F.round(tr.two_step_rate(e, 175, 100, 1.0, 3.0), 12).alias("two_step"))


OPS = ", ".join(f"('{n}', {a!r}::double, {b!r}::double)" for n, a, b in tr.AUGMENTATIONS)


@query(f"select p_partkey, name, round(10e0 / 30e0 * (high - low) + low, 9) as strength from (select p_partkey, cast(floor({tr.seeded_sql(7, 'p_partkey')} * {len(tr.AUGMENTATIONS)}) as bigint) as k from part) p join (select *, row_number() over () - 1 as k from (values {OPS}) as o(name, low, high)) o using (k)")
def random_augmentation(v: Views) -> DataFrame:
    """The operation that is drawn for each image, and its strength at level 10."""
    drawn = F.floor(tr.seeded(7, "p_partkey") * len(tr.AUGMENTATIONS)).cast("int")
    name, strength = tr.augmentation(drawn, 10.0)
    return v.table("part").select("p_partkey", name.alias("name"), F.round(strength, 9).alias("strength"))


@query(f"select p_partkey, round(0.6e0 + {tr.seeded_sql(3, 'p_partkey')} * 0.8e0, 9) as factor, round({tr.seeded_sql(3, 'p_partkey')} * 2.5e0, 9) as strong from part")
def colour_jitter(v: Views) -> DataFrame:
    """Factors drawn for a strength under and over 1."""
    number = tr.seeded(3, "p_partkey")
    return v.table("part").select("p_partkey", F.round(tr.jitter(number, 0.4), 9).alias("factor"), F.round(tr.jitter(number, 1.5), 9).alias("strong"))


@query(f"""select p_partkey, least(size - 32, greatest(0, centre - 32 + cast(floor({tr.seeded_sql(5, 'p_partkey')} * 33) as bigint))) as start, cast(floor({tr.seeded_sql(6, 'p_partkey')} * (100 - p_size + 1)) as bigint) as before,
    100 - p_size - cast(floor({tr.seeded_sql(6, 'p_partkey')} * (100 - p_size + 1)) as bigint) as after, cast(round((size - 31) / 2e0) as bigint) as middle from (select p_partkey, p_size, p_size + 40 as size, (p_partkey * 7) % (p_size + 40) as centre from part) t""")
def crop_placement(v: Views) -> DataFrame:
    """Crops that cover a centre, margins of small images, and crops in the middle."""
    size = F.col("p_size") + 40
    before, after = tr.slide_margin(tr.seeded(6, "p_partkey"), F.col("p_size"), F.lit(100))
    start = tr.crop_start(tr.seeded(5, "p_partkey"), (F.col("p_partkey") * 7) % size, F.lit(32), size)
    return v.table("part").select("p_partkey", start.cast("long").alias("start"), before.cast("long").alias("before"), after.cast("long").alias("after"), tr.centre_crop(size, F.lit(31)).alias("middle"))


@query("select p_partkey, case when w <= h then 64 else cast(floor(64e0 * w / h) as bigint) end as width, case when w <= h then cast(floor(64e0 * h / w) as bigint) else 64 end as height, 'pred_' || s || 'x' as key from (select p_partkey, cast(p_size as double) as w, cast(p_partkey % 17 + 1 as double) as h, case p_partkey % 3 when 0 then '0.5' when 1 then '1.0' else '2.0' end as s from part) t")
def scaled_sizes(v: Views) -> DataFrame:
    """Sizes after the shorter side is scaled to 64, and the names of outputs at scales."""
    w, h = tr.scaled_size(F.col("p_size").cast("double"), (F.col("p_partkey") % 17 + 1).cast("double"), 64)
    scale = F.element_at(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0)), (F.col("p_partkey") % 3 + 1).cast("int"))
    return v.table("part").select("p_partkey", w.alias("width"), h.alias("height"), tr.scale_key("pred", scale).alias("key"))


@query("select tile, r, c, case when x < 110 then x else 255 - x end as solarized, x & 240 as posterized, least(255, greatest(0, cast(floor(x * 1.5e0) as bigint))) as brightened, round(((x / 255e0 - 0.456e0) / 0.224e0 * 0.224e0 + 0.456e0) * 255e0, 6) as restored from (select tile, r, c, v * 80 + r as x from mask_px) t", "mask_px")
def pixel_augmentation(v: Views) -> DataFrame:
    x = F.col("v") * 80 + F.col("r")
    return v.mask_px().select("tile", "r", "c", tr.solarized(x, 110).alias("solarized"), tr.posterized(x, 4).alias("posterized"), tr.brightened(x, 1.5).cast("long").alias("brightened"), F.round(pixels.restored(pixels.normalised(x, 1), 1), 6).alias("restored"))


@query(f"select p_partkey, i from (select p_partkey, row_number() over (order by h, p_partkey) - 1 as place, n from (select p_partkey, {tr.seeded_sql(11, 'p_partkey')} as h, count(*) over () as n from part) q) t, lateral (select unnest(range(place, n * 2 + 100, n)) as i) u")
def wrapped_sample(v: Views) -> DataFrame:
    """A shuffled sample of a hundred rows more than twice the table, which starts again when it ends."""
    part = v.table("part").select("p_partkey")
    n = part.count()
    return training.wrapped_sample(part, "p_partkey", 2 * n + 100, 11).select("p_partkey", "i")


@query("select cls, cast(count(*) as bigint) as n from (select unnest(range(-1, 4)) as cls) k, (select count(*) as m from customer) c, lateral (select unnest(range(case when cls < 0 then m - 4 * cast(floor(m * 0.5e0 / 4) as bigint) else cast(floor(cast(floor(m * 0.5e0 / 4) as bigint) * (cls + 1) / 2e0) as bigint) end))) u where cls < 0 or cls in (select distinct v from mask_px) group by cls", "mask_px")
def uniform_epoch(v: Views) -> DataFrame:
    """An epoch of which half is drawn by class, with a bias."""
    images = v.table("customer").select(F.col("c_custkey").alias("key"))
    centroids = masks.class_centroids(v.mask_px(), 4).select(F.col("v").alias("cls"), (F.col("tile") * 4 + F.col("tr") * 2 + F.col("tc")).alias("key"))
    return training.uniform_epoch(images, centroids, 4, 0.5, 2, [0.5, 1.0, 1.5, 2.0]).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


@query("select v as cls, count(*) as n, count(distinct tile) as images from (select distinct tile, floor(r / 4e0) as tr, floor(c / 4e0) as tc, v from mask_px) t group by v", "mask_px")
def centroid_counts(v: Views) -> DataFrame:
    return training.centroid_counts(masks.class_centroids(v.mask_px(), 4)).select("cls", "n", "images")


SHARDS = "n as (select count(*) as n from metric_stream), i as (select seq, row_number() over (order by seq) as i from metric_stream)"


@query(with_ctes(SHARDS, "select seq, (i - 1) % 7 as shard, 'drop' as how from i, n where i <= n // 7 * 7 union all select seq, (i - 1) % 7, 'pad' from i union all select seq, (i + n - 1) % 7, 'pad' from i, n where i <= (7 - n % 7) % 7"), "metric_stream")
def even_shards(v: Views) -> DataFrame:
    """Rows dealt to seven shards of one size, by leaving rows out and by repeating some."""
    s = v.metric_stream()
    return training.dealt(s, "seq", 7, False).withColumn("how", F.lit("drop")).union(training.dealt(s, "seq", 7, True).withColumn("how", F.lit("pad")))


@query("select seq from (select seq, row_number() over (order by seq) - 1 as i from metric_stream) t where i % 20 = 0 and i <= 5000", "metric_stream")
def logged_steps(v: Views) -> DataFrame:
    """Every twentieth step is logged, up to a last one where a run stops."""
    return training.every_nth(v.metric_stream(), "seq", 20, 5000).select("seq")


@query("select metric, round(min(x) / nullif(max(x), 0), 9) as ratio, min(x) / nullif(max(x), 0) < 0.75e0 as warn from (select p_size % 5 as metric, p_retailprice as x from part) t group by metric")
def load_balance(v: Views) -> DataFrame:
    loads = v.table("part").select((F.col("p_size") % 5).alias("metric"), F.col("p_retailprice").alias("value"))
    return training.out_of_balance(loads).select("metric", F.round("ratio", 9).alias("ratio"), "warn")


@query(with_ctes("sh as (select tile, r, c, v as truth, coalesce(lead(v) over (partition by tile, r order by c), 0) as pred from mask_px)", "select cls, tile, fp, fn, cast(fp + fn as bigint) as fail from (select cls, tile, count(*) filter (where pred = cls and truth <> cls) as fp, count(*) filter (where truth = cls and pred <> cls) as fn from sh, (select unnest(range(4)) as cls) k group by cls, tile) t where fp + fn > 0"), "mask_px")
def image_failures(v: Views) -> DataFrame:
    """False positives and negatives of each class in each image."""
    w = Window.partitionBy("tile", "r").orderBy("c")
    px = v.mask_px().select("tile", F.col("v").alias("truth"), F.coalesce(F.lead("v").over(w), F.lit(0)).alias("pred"))
    return masks.image_failures(px)
