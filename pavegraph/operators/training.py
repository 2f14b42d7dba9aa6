"""Relations of segmentation training: class-uniform epochs, relaxed borders, peaks, balanced losses, region statistics."""

from __future__ import annotations

from collections.abc import Iterator

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import training
from .sampling import numbered


def centroid_counts(centroids: DataFrame) -> DataFrame:
    """(cls, n, images): how many centroids (tile, v, cr, cc) each class has, and in how many images."""
    return centroids.groupBy(F.col("v").alias("cls")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tile").alias("images"))


def wrapped_sample(items: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in a fixed shuffle of ``items``, from its start again when it ends; column ``i`` is the place.

    Each row comes as often as it is due, by itself, so the sample may be larger than the table.
    """
    mixed = F.struct(training.seeded(seed, key).alias("h"), F.col(key).alias("k"))
    placed = numbered(items, mixed, "_place")
    size = items.count()
    if not size:
        return items.withColumn("i", F.lit(0).cast("long")).limit(0)
    first = F.col("_place") - 1
    times = F.when(first < n % size, n // size + 1).otherwise(n // size)
    due = placed.withColumn("_times", times.cast("int")).filter("_times > 0")
    return due.withColumn("i", F.explode(F.transform(F.sequence(F.lit(0), F.col("_times") - 1), lambda k: first + k * size))).drop("_place", "_times")


def epoch_plan(n_images: int, classes: int, share: float, bias: list[float] | None = None) -> list[int]:
    """How many rows an epoch takes at random, then of each class."""
    each = int(n_images * share / classes)
    return [n_images - each * classes, *(int(each * b) for b in bias or [1.0] * classes)]


def uniform_epoch(images: DataFrame, centroids: DataFrame, classes: int, share: float, seed: int, bias: list[float] | None = None) -> DataFrame:
    """(cls, key, i): an epoch of random images (cls -1) and, for each class, of its centroids; classes without any are left out.

    ``images``: (key); ``centroids``: (cls, key).
    """
    n_images = images.count()
    at_random, *by_class = epoch_plan(n_images, classes, share, bias)
    out = wrapped_sample(images.select(F.lit(-1).alias("cls"), "key"), "key", at_random, seed)
    for cls, n in enumerate(by_class):
        out = out.unionByName(wrapped_sample(centroids.filter(F.col("cls") == cls).select(F.lit(cls).alias("cls"), "key"), "key", n, seed))
    return out.select("cls", "key", "i")


def dealt(df: DataFrame, order: str, replicas: int, pad: bool) -> DataFrame:
    """(order, shard): rows in turn to ``replicas`` shards of one size, the first rows again for the last (``pad``) or the last left out."""
    placed = numbered(df.select(order), order)
    n = df.count()
    each = math.ceil(n / replicas) if pad else n // replicas
    total = each * replicas
    rows = placed.filter(F.col("i") <= total)
    if total > n:
        rows = rows.unionByName(placed.filter(F.col("i") <= total - n).withColumn("i", F.col("i") + n))
    return rows.select(order, ((F.col("i") - 1) % replicas).alias("shard"))


def every_nth(df: DataFrame, order: str, n: int, most: int | None = None) -> DataFrame:
    """Rows of which the number from 0 is a multiple of ``n``, up to the row of number ``most``."""
    placed = numbered(df, order)
    kept = placed.filter((F.col("i") - 1) % n == 0)
    return kept if most is None else kept.filter(F.col("i") - 1 <= most)


def _shifts(radius: int) -> Column:
    steps = range(-radius, radius + 1)
    return F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in steps for b in steps))


def _around(px: DataFrame, radius: int) -> DataFrame:
    moved = px.withColumn("_s", F.explode(_shifts(radius)))
    return moved.withColumns({"r": F.col("r") + F.col("_s.dr"), "c": F.col("c") + F.col("_s.dc")}).drop("_s")


def relaxed_borders(px: DataFrame, radius: int, ignore: int | None = None) -> DataFrame:
    """(tile, r, c, classes): the classes within ``radius`` rows and columns of each pixel, sorted; those of ``ignore`` do not count."""
    own = px.select("tile", "r", "c")
    source = px if ignore is None else px.filter(F.col("v") != ignore)
    near = _around(source, radius).groupBy("tile", "r", "c").agg(F.sort_array(F.collect_set("v")).alias("classes"))
    return own.join(near, ["tile", "r", "c"], "left").withColumn("classes", F.coalesce("classes", F.array().cast("array<int>")))


def peaks(px: DataFrame) -> DataFrame:
    """(tile, r, c): pixels that are the largest of their neighbourhood, less background (0) with only background around."""
    own = px.select("tile", "r", "c", F.col("v").alias("own"))
    near = _around(px, 1).groupBy("tile", "r", "c").agg(F.max("v").alias("most"), F.max(F.col("v") != 0).alias("lit"))
    met = own.join(near, ["tile", "r", "c"])
    is_peak, is_ground = F.col("most") == F.col("own"), (F.col("own") == 0) & ~F.col("lit")
    return met.filter(is_peak != is_ground).select("tile", "r", "c")


def class_balance(px: DataFrame, by: str = "tile", target: str = "t") -> DataFrame:
    """(by, beta): the share of negatives among the pixels of 0 or 1 of each image."""
    pos, neg = F.count_if(F.col(target) == 1), F.count_if(F.col(target) == 0)
    return px.groupBy(by).agg((neg / (pos + neg + F.lit(1e-8))).alias("beta"))


def image_weights(px: DataFrame, classes: int, upper: float = 1.0, inverse: bool = False) -> DataFrame:
    """(tile, v, weight): the weight of each class in each image; by one less its share, or by one over it."""
    counted = px.groupBy("tile", "v").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("tile"))
    weighed = counted.select("tile", "v", ((F.lit(upper) / share if inverse else F.lit(upper) * (F.lit(1.0) - share)) + 1.0).alias("weight"))
    tiles = counted.select("tile").distinct().select("tile", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("v"))
    return tiles.join(weighed, ["tile", "v"], "left").select("tile", "v", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def weighted_loss(px: DataFrame, weights: DataFrame) -> DataFrame:
    """(tile, loss): the mean loss of each image with the weights of its classes; ``px``: (tile, v, loss)."""
    w = F.col("weight")
    return px.filter("loss is not null").join(weights, ["tile", "v"]).groupBy("tile").agg((F.sum(F.col("loss") * w) / F.sum(w)).alias("loss"))


def balanced_loss(px: DataFrame) -> DataFrame:
    """(tile, loss): binary losses summed with the weights of the image's balance; ``px``: (tile, logit, t)."""
    beta = class_balance(px)
    cost = training.binary_cross_entropy(F.col("logit"), F.col("t").cast("double")) * training.balanced_weight(F.col("beta"), F.col("t").cast("double"))
    return px.join(beta, "tile").groupBy("tile").agg(F.sum(cost).alias("loss"))


def edge_weighted_loss(px: DataFrame, edges: DataFrame) -> DataFrame:
    """(tile, loss): mean loss over all pixels in which only those on an edge (tile, r, c) count."""
    marked = px.join(edges.select("tile", "r", "c").distinct().withColumn("on_edge", F.lit(1.0)), ["tile", "r", "c"], "left")
    return marked.groupBy("tile").agg((F.sum(F.coalesce("on_edge", F.lit(0.0)) * F.col("loss")) / F.count(F.lit(1))).alias("loss"))


def pooled(px: DataFrame, size: int) -> DataFrame:
    """(tile, pr, pc, value): the mean of each square of ``size`` pixels."""
    return px.groupBy("tile", F.floor(F.col("r") / size).alias("pr"), F.floor(F.col("c") / size).alias("pc")).agg(F.avg("value").alias("value"))


def region_covariance(px: DataFrame, radius: int) -> DataFrame:
    """(tile, i, j, cov): covariances of the pixels of a region, as vectors of their neighbours at offsets i and j.

    ``px``: (tile, r, c, value); the regions are the (radius x radius) squares that lie in the tile.
    """
    steps = F.array(*(F.struct(F.lit(a * radius + b).alias("i"), F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in range(radius) for b in range(radius)))
    placed = px.withColumn("_s", F.explode(steps)).select("tile", (F.col("r") - F.col("_s.dr")).alias("r"), (F.col("c") - F.col("_s.dc")).alias("c"), F.col("_s.i").alias("i"), "value")
    vectors = placed.groupBy("tile", "r", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("x")).filter(F.size("x") == radius * radius)
    pairs = vectors.select("tile", F.posexplode("x").alias("i", "a"), "x").select("tile", "i", "a", F.posexplode("x").alias("j", "b"))
    return pairs.groupBy("tile", "i", "j").agg((F.sum(F.col("a") * F.col("b")) - F.sum("a") * F.sum("b") / F.count(F.lit(1))).alias("cov"))


#: Added to the diagonals of covariances, so that they can be inverted. Fixed value.
REGION_ALPHA = 5e-4


def region_loss(px: DataFrame, radius: int = 3, alpha: float = REGION_ALPHA) -> DataFrame:
    """(tile, loss): half the log determinant of what the probabilities leave open of the labels' regions.

    ``px``: (tile, r, c, label, prob), all pixels of each tile; a pixel's region is the radius x radius square that begins
    at it. With P, L and Q the covariances of probabilities, of labels, and between them, that is
    log det(L + a - Q (P + a)^-1 Q') / 2, which is the joint matrix's log determinant less that of P + a; both come from
    batched Cholesky factors. A tile is a value; its pixels are listed in one row.
    """
    pixels = px.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("r", "c", F.col("label").cast("double").alias("label"), F.col("prob").cast("double").alias("prob")))).alias("px"))
    kind = px.schema["tile"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            loss = []
            for pts in batch.column(1).to_pylist():
                h, w = max(p["r"] for p in pts) + 1, max(p["c"] for p in pts) + 1
                if len(pts) != h * w or h < radius or w < radius:
                    loss.append(None)
                    continue
                both = np.array([[p["prob"] for p in pts], [p["label"] for p in pts]]).reshape(2, h, w)
                x = np.lib.stride_tricks.sliding_window_view(both, (radius, radius), axis=(1, 2)).reshape(2, -1, radius * radius)
                x = np.concatenate(x - x.mean(1, keepdims=True), 1)
                joint = x.T @ x + alpha * np.eye(2 * radius * radius)
                loss.append(float(np.log(np.diagonal(np.linalg.cholesky(joint)))[radius * radius :].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(loss, pa.float64())], names=["tile", "loss"])

    return pixels.mapInArrow(run, f"tile {kind}, loss double")


def out_of_balance(loads: DataFrame, least: float = 0.75) -> DataFrame:
    """(metric, ratio, warn): whether the least of each metric is under ``least`` of its most; ``loads``: (metric, value)."""
    ratio = F.min("value") / F.nullif(F.max("value"), F.lit(0.0))
    return loads.groupBy("metric").agg(ratio.alias("ratio"), (ratio < least).alias("warn"))
