"""Segmentation metrics over streams of (truth, pred) pairs: the batch definitions, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_stream(pairs: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """(window, truth, pred, n) of a stream, in windows of event time; rows later than ``late`` are left out."""
    return pairs.withWatermark(time, late).groupBy(F.window(time, window), "truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def weighted_mean_stream(values: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """(window, mean, n): the mean of ``val`` weighted by ``n`` in windows of event time."""
    return values.withWatermark(time, late).groupBy(F.window(time, window)).agg((F.sum(F.col("val") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
