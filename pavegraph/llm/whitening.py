"""Whitening of embeddings with components from a randomised range finder.

The covariance is never formed from uncentred values. A random block of vectors, somewhat wider than the components
asked for, is multiplied by it again and again (power passes): every pass reads all rows, multiplies the centred rows
of each partition by the block, and adds up d x r numbers. Rayleigh-Ritz on the block gives components, and their
residuals say whether they are exact to double precision. If the residuals fall too slowly to get there within the
passes allowed, as on a flat spectrum, the block is expanded to the full dimension: one more pass, and the residuals
are those of rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, table

#: Components, further columns of the block, and power passes before the block is expanded.
COMPONENTS, OVERSAMPLING, PASSES = 32, 10, 12
#: Entries are 64ths, as whole numbers; those of more than 2^52 count as that.
SCALE, LARGEST = 64, 2**52
#: Numbers that a task holds of a product at once; a wider block is multiplied in slices.
SLICE = 1 << 21
LOW = 26


@dataclass(frozen=True)
class Whitening:
    """A fit. ``n`` vectors of ``dim`` entries with the exact ``sums``; ``vectors`` (dim, k) with falling ``values``."""

    n: int
    dim: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int
    full: bool
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def usable(self) -> np.ndarray:
        """Components with any variance beyond rounding; the others cannot be scaled."""
        return self.values > (self.values[0] if len(self.values) else 0) * self.dim * np.finfo(float).eps * 4

    @property
    def projection(self) -> np.ndarray:
        return np.divide(self.vectors, np.sqrt(np.maximum(self.values, 0)), where=self.usable, out=np.full_like(self.vectors, np.nan))


def whole_entries(vector_col: str = "embedding"):
    """Column: entries as whole 64ths, null where the vector or an entry is null or not finite."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    bound = float(LARGEST // SCALE)
    return F.when(~bad, F.transform(v, lambda c: F.floor(F.lit(float(SCALE)) * F.greatest(F.least(c, F.lit(bound)), F.lit(-bound))).cast("long")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _added(rows: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], dim: int) -> np.ndarray:
    """Sum of ``kernel`` over the batches of all rows; one partial sum a partition, added up in two steps."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = kernel(_matrix(batch.column(0), dim))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    kind = kernel(np.zeros((1, dim), np.int64))

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                part = np.frombuffer(raw, kind.dtype)
                total = part.copy() if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = rows.mapInArrow(partial, "part binary")
    n_parts = rows.rdd.getNumPartitions()
    if n_parts > 16:  # the driver gets the root of their number
        parts = parts.repartition(int(np.ceil(np.sqrt(n_parts)))).mapInArrow(further, "part binary")
    found = [np.frombuffer(r.part, kind.dtype) for r in parts.collect()]
    return sum(found[1:], found[0].copy()).reshape(kind.shape) if found else np.zeros_like(kind)


def _times_covariance(rows: DataFrame, mean: np.ndarray, n: int, block: np.ndarray) -> tuple[np.ndarray, float]:
    """V @ block and the trace of V, in one pass over the rows for each slice of the block."""
    dim, step = len(mean), max(1, SLICE // len(mean))
    out = []
    for at in range(0, block.shape[1], step):
        part = block[:, at : at + step]

        def kernel(y: np.ndarray, part: np.ndarray = part) -> np.ndarray:
            c = y - mean
            return np.vstack([c.T @ (c @ part), np.full(part.shape[1], np.square(c).sum())])

        out.append(_added(rows, kernel, dim) / n)
    both = np.hstack(out)
    return both[:-1], float(both[-1, 0])


def components(multiply: Callable[[np.ndarray], np.ndarray], dim: int, k: int, oversampling: int = OVERSAMPLING, passes: int = PASSES, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """(values, vectors, passes made, expanded) of the ``k`` largest eigenpairs of the symmetric matrix behind ``multiply``."""
    rng = np.random.default_rng(seed)
    width = min(dim, k + oversampling)
    block, made, before = np.linalg.qr(rng.standard_normal((dim, width)))[0], 0, None
    while True:
        image = multiply(block)
        made += 1
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
        vectors = block @ turn
        full = block.shape[1] == dim
        residual = np.linalg.norm(image @ turn - vectors * values, axis=0).max(initial=0)
        bound = 4 * dim * np.finfo(float).eps * max(values[0], 0) if len(values) else 0
        if full or residual <= bound:
            break
        left = passes - made
        rate = residual / before if before else 0.1
        if left > 0 and rate < 1 and residual * rate**left <= bound:
            block, before = np.linalg.qr(image)[0], residual
        elif before is None and left > 0:
            block, before = np.linalg.qr(image)[0], residual
        else:
            block = np.linalg.qr(np.hstack([block, rng.standard_normal((dim, dim - block.shape[1]))]))[0]
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    return np.maximum(values, 0), vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1, 1), made, full and width < dim


def fit_whitening(embeddings: DataFrame, vector_col: str = "embedding", k: int = COMPONENTS, **options) -> Whitening | None:
    """Fit over all rows that hold a vector of finite entries; None if there is none.

    Vectors count if they have the most frequent length above nothing (of two as frequent, the greater). Passes over the
    rows read whole numbers that the first of them wrote; only sums of d x r numbers reach the driver.
    """
    rows = table(embeddings.select(whole_entries(vector_col).alias("y")).select("y", F.size("y").alias("dim")).filter("dim > 0"))
    common = rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        discard(rows)
        return None
    n, dim = common["count"], common["dim"]
    same = rows.filter(F.col("dim") == dim).select("y")
    high, low = _added(same, lambda y: np.stack([(y >> LOW).sum(0), (y & ((1 << LOW) - 1)).sum(0)]), dim)
    sums = [(int(h) << LOW) + int(s) for h, s in zip(high, low)]
    mean = np.array([s / n for s in sums])
    trace = 0.0

    def multiply(block: np.ndarray) -> np.ndarray:
        nonlocal trace
        image, trace = _times_covariance(same, mean, n, block)
        return image

    values, vectors, made, full = components(multiply, dim, min(k, dim), **options)
    fit = Whitening(n, dim, sums, values, vectors, trace, made, full)
    use = fit.usable
    if use.any():
        into = fit.projection[:, use]

        def moments(y: np.ndarray) -> np.ndarray:
            w = (y - mean) @ into
            return np.vstack([w.T @ w, w.sum(0)])

        found = _added(same, moments, dim) / n
        error = float(np.abs(found[:-1] - np.outer(found[-1], found[-1]) - np.eye(use.sum())).max())
        fit = Whitening(n, dim, sums, values, vectors, trace, made, full, error)
    discard(rows)
    return fit


def deviations(y: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums over the entries of (n y - S)^2."""
    if len(y) and y.shape[1] * (float(n) * float(np.abs(y).max()) + max(map(abs, sums))) ** 2 < 2**62:
        return np.square(n * y - np.array(sums, np.int64)).sum(1).tolist()
    return [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in y.tolist()]


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS, fit: Whitening | None = None) -> DataFrame:
    """One row per usable row: id, n, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error.

    Rows whose vector is null, empty, of another length than most, or holds a null or an entry that is not finite are
    left out; all rows with a vector count in the fit, also repeated ones and those without id. Components without
    variance have a null in ``whitened`` and 0 in ``explained``, and take no part in ``identity_error`` (null if none
    does). A deviation of over 38 digits is null. Other columns are ignored. An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    fit = fit or fit_whitening(embeddings, vector_col, k)
    kind = embeddings.select(F.col(id_col).alias("id")).schema[0].dataType.simpleString()
    schema = f"id {kind}, deviation decimal(38,0), whitened array<double>"
    if fit is None:
        empty = spark.createDataFrame([], f"{schema}, n long, explained array<double>, identity_error double")
        return empty.select(F.col("id").alias(id_col), "n", "deviation", "whitened", "explained", "identity_error")
    mean, into, n, dim, sums, use = fit.mean, fit.projection, fit.n, fit.dim, fit.sums, fit.usable
    explained = [float(v / fit.trace) if u else 0.0 for v, u in zip(fit.values, use)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch.column(1), dim)
            w = ((y - mean) @ into).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * len(use), pa.int32()), pa.array(w, pa.float64(), from_pandas=True))
            exact = pa.array([Decimal(d) if d < 10**38 else None for d in deviations(y, n, sums)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), exact, lists], names=["id", "deviation", "whitened"])

    rows = embeddings.select(F.col(id_col).alias("id"), whole_entries(vector_col).alias("y")).filter(F.size("y") == dim)
    constants = [F.array(*map(F.lit, explained)).alias("explained"), F.lit(fit.identity_error).cast("double").alias("identity_error")]
    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), F.lit(n).cast("long").alias("n"), "deviation", "whitened", *constants)


def component_rows(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row per row and component of ``whiten``'s result; a deviation beyond a long is null."""
    return whitened.select(
        id_col,
        F.posexplode("whitened").alias("at", "whitened"),
        "n",
        F.expr("try_cast(deviation as long)").alias("deviation"),
        "explained",
        "identity_error",
    ).select(id_col, (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.element_at("explained", F.col("at") + 1).alias("explained"), "identity_error")
