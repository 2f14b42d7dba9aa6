"""Order-dependent sampling and running metrics, without putting all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import cut
from .masks import image_failures

#: Rows of a range partition, about, and ranges at most: what is said of each range is broadcast.
RANGE_ROWS = 100_000
RANGES = 10_000


def ranges_for(n: int) -> int:
    return min(RANGES, max(2, -(-n // RANGE_ROWS)))


def numbered(df: DataFrame, order: str | Column, name: str = "i") -> DataFrame:
    """Rows with their place, from 1, in a total order.

    Rows are dealt by range and numbered in each range; the ranges' sizes, one row each, are summed up and joined back.
    """
    n = ranges_for(df.count())
    key = F.col(order) if isinstance(order, str) else order
    parts = cut(df.withColumn("_key", key).repartitionByRange(n, "_key").withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
    here = F.row_number().over(Window.partitionBy("_part").orderBy("_key"))
    return parts.withColumn("_here", here).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_here")).drop("_key", "_part", "_here", "_before")


def systematic(df: DataFrame, order: str, percent: int) -> DataFrame:
    """The first row, and each at which the percentage taken would fall behind."""
    i = F.col("i")
    return numbered(df, order).filter((i == 1) | (F.floor(i * percent / 100) > F.floor((i - 1) * percent / 100)) if percent else F.lit(False))


def sharded(df: DataFrame, order: str, replicas: int) -> DataFrame:
    """Rows dealt in turn to ``replicas`` shards."""
    return numbered(df, order).withColumn("shard", (F.col("i") - 1) % replicas)


def split(df: DataFrame, key: str, ratio: float) -> DataFrame:
    """(key, part): a fixed shuffle by a multiplicative hash, then the first ``ratio`` of the rows are for training."""
    mixed = (F.col(key) * F.lit(2654435761)) % F.lit(4294967296)
    placed = numbered(df.select(key), F.struct(mixed.alias("h"), F.col(key).alias("k")))
    n = placed.agg(F.count(F.lit(1)).alias("n"))
    return placed.crossJoin(F.broadcast(n)).select(key, F.when(F.col("i") <= F.floor(F.col("n") * ratio), "train").otherwise("val").alias("part"))  # one row on the right


def column_batches(tiles: DataFrame, height: int, target: int) -> DataFrame:
    """Tiles with the number of their batch of whole columns of about ``target`` tiles."""
    return tiles.withColumn("batch", F.floor(F.col("col") / max(target // height, 1)))


def running_mean(df: DataFrame) -> DataFrame:
    """(seq, mean): the mean of ``val`` weighted by ``n`` over all rows up to each.

    Sums within ranges come from a window, sums of the ranges before from one row per range.
    """
    n = ranges_for(df.count())
    parts = cut(df.repartitionByRange(n, "seq").withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.sum(F.col("val") * F.col("n")).alias("_v"), F.sum("n").alias("_w"))
    past = Window.orderBy("_part")
    before = sums.select("_part", (F.sum("_v").over(past) - F.col("_v")).alias("_v"), (F.sum("_w").over(past) - F.col("_w")).alias("_w"))  # a row for each range
    w = Window.partitionBy("_part").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = parts.withColumn("a", F.sum(F.col("val") * F.col("n")).over(w)).withColumn("b", F.sum("n").over(w))
    return here.join(F.broadcast(before), "_part").select("seq", ((F.col("a") + F.col("_v")) / (F.col("b") + F.col("_w"))).alias("mean"))


def worst(pairs: DataFrame, n: int) -> DataFrame:
    """(cls, tile, fail): for each class the ``n`` tiles with most false positives and negatives; counted before they are ranked."""
    order = Window.partitionBy("cls").orderBy(F.desc("fail"), "tile")
    return image_failures(pairs).select("cls", "tile", "fail").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= n).drop("k")


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in ascending order; each task keeps its own first ones before they meet."""
    return df.orderBy(*order).limit(n)


def descending(values: Column) -> Column:
    """An array from its largest value down."""
    return F.sort_array(values, asc=False)
