"""Resampling of images and masks as relations: two small tables of weights, one for rows and one for columns.

A pixel of the result is a weighted sum of pixels of the source, and for all methods here the weights are products of one
for the row and one for the column. So a resize is two joins with tables that depend on the sizes alone, and a sum.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pixels along a side of an image at most, which bounds the tables of weights.
LARGEST = 65_536


def weights(n_in: int, n_out: int, method: str) -> list[tuple[int, int, float]]:
    """(to, from, weight) along one side. ``nearest`` for classes, ``bilinear`` and ``area`` for values; pixel centres are at halves."""
    if not (0 < n_in <= LARGEST and 0 < n_out <= LARGEST):
        raise ValueError(f"a side has 1 to {LARGEST} pixels")
    step, out = n_in / n_out, []
    for to in range(n_out):
        if method == "nearest":
            out.append((to, min(n_in - 1, int((to + 0.5) * step)), 1.0))
        elif method == "bilinear":
            at = (to + 0.5) * step - 0.5
            low = math.floor(at)
            for k, w in ((low, 1 - (at - low)), (low + 1, at - low)):
                if w:
                    out.append((to, min(max(k, 0), n_in - 1), w))
        elif method == "area":
            a, b = to * step, (to + 1) * step
            out += [(to, k, (min(b, k + 1) - max(a, k)) / step) for k in range(int(a), min(n_in, math.ceil(b))) if min(b, k + 1) - max(a, k) > 1e-12]
        else:
            raise ValueError(method)
    return out


def resized(px: DataFrame, size: tuple[int, int], into: tuple[int, int], method: str, key: str = "tile", value: str = "value") -> DataFrame:
    """(key, r, c, value): images of ``size`` (rows, columns) resampled ``into`` another one. Pixels that are not there count as nothing."""
    spark = px.sparkSession
    side = lambda n, m, names: F.broadcast(spark.createDataFrame(weights(n, m, method), names))  # noqa: E731  at most three rows a pixel of a side, or the source's side
    rows, columns = side(size[0], into[0], "_r int, r int, _wr double"), side(size[1], into[1], "_c int, c int, _wc double")
    near = px.select(key, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col(value).alias("_v")).join(rows, "r").join(columns, "c")
    if method == "nearest":
        return near.select(key, F.col("_r").alias("r"), F.col("_c").alias("c"), F.col("_v").alias(value))
    return near.groupBy(key, F.col("_r").alias("r"), F.col("_c").alias("c")).agg(F.sum(F.col("_v") * F.col("_wr") * F.col("_wc")).alias(value))


def resized_pair(px: DataFrame, size: tuple[int, int], into: tuple[int, int], image: str = "value", mask: str = "v", method: str = "bilinear", key: str = "tile") -> DataFrame:
    """(key, r, c, image, mask): an image and its mask resized together, the mask by its nearest pixels, as classes have no mean."""
    return resized(px, size, into, method, key, image).join(resized(px, size, into, "nearest", key, mask), [key, "r", "c"])


def cropped(px: DataFrame, top: int, left: int, height: int, width: int) -> DataFrame:
    inside = F.col("r").between(top, top + height - 1) & F.col("c").between(left, left + width - 1)
    return px.filter(inside).withColumns({"r": F.col("r") - top, "c": F.col("c") - left})


def mirrored(px: DataFrame, width: int) -> DataFrame:
    return px.withColumn("c", width - 1 - F.col("c"))


def normalised(px: DataFrame, mean: float, deviation: float, value: str = "value") -> DataFrame:
    return px.withColumn(value, (F.col(value) - mean) / deviation)


def side_by_side(width: int, *layers: DataFrame) -> DataFrame:
    """Images of one width beside each other, by the same keys: a composite of image, mask and prediction."""
    out = layers[0]
    for k, layer in enumerate(layers[1:], 1):
        out = out.unionByName(layer.withColumn("c", F.col("c") + k * width))
    return out


def chain(px: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``px`` after all steps, one after another; the optimizer sees them as one plan."""
    for step in steps:
        px = step(px)
    return px
