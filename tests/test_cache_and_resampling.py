"""Cached relations are built once for each state of their inputs; resampling against plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest

from pavegraph.operators import resample
from pavegraph.sources import cache


def test_cached_relation_follows_its_inputs(spark, tmp_path):
    source, folder, built = str(tmp_path / "in.parquet"), str(tmp_path / "cache"), []
    spark.range(5).write.parquet(source)

    def ask(**parameters):
        rows = spark.read.parquet(source)

        def build():
            built.append(1)
            return rows.selectExpr("sum(id) as total")

        found = cache.cached(spark, folder, cache.fingerprint(rows, **parameters), build)
        return found.rows.first().total, found.reused

    assert ask(a=1, b=2) == (10, False) and ask(b=2, a=1) == (10, True) and len(built) == 1
    assert ask(a=1, b=3) == (10, False)
    spark.range(100, 101).write.mode("append").parquet(source)
    assert ask(a=1, b=3) == (110, False) and ask(a=1, b=3) == (110, True) and len(built) == 3
    assert sum(p.name.startswith("rows-") for p in (tmp_path / "cache").iterdir()) == 1  # older ones are gone
    with pytest.raises(ZeroDivisionError):
        cache.cached(spark, folder, "other", lambda: 1 // 0)
    assert ask(a=1, b=3) == (110, True)  # a build that fails changes nothing


def plain(image: np.ndarray, into: tuple[int, int], method: str) -> np.ndarray:
    (h, w), (m, n) = image.shape, into
    out = np.zeros(into)
    for i in range(m):
        for j in range(n):
            y, x = (i + 0.5) * h / m, (j + 0.5) * w / n
            if method == "nearest":
                out[i, j] = image[int(y), int(x)]
            elif method == "bilinear":
                y, x = y - 0.5, x - 0.5
                for a in (math.floor(y), math.floor(y) + 1):
                    for b in (math.floor(x), math.floor(x) + 1):
                        out[i, j] += image[min(max(a, 0), h - 1), min(max(b, 0), w - 1)] * (1 - abs(y - a)) * (1 - abs(x - b))
            else:
                fine = np.kron(image, np.ones((m, n)))
                out[i, j] = fine[i * h : (i + 1) * h, j * w : (j + 1) * w].mean()
    return out


@pytest.mark.parametrize("method", ["nearest", "bilinear", "area"])
@pytest.mark.parametrize("into", [(3, 9), (5, 4), (10, 2), (1, 1)])
def test_resampling(spark, method, into):
    image = np.random.default_rng(4).uniform(0, 9, (5, 4))
    px = spark.createDataFrame([(7, r, c, float(image[r, c])) for r in range(5) for c in range(4)], "tile long, r int, c int, value double")
    got = np.full(into, np.nan)
    for r in resample.resized(px, (5, 4), into, method).collect():
        got[r.r, r.c] = r.value
    assert np.allclose(got, plain(image, into, method))


def test_weights_add_up():
    for n, m in ((8, 3), (3, 8), (7, 7), (1, 5)):
        for method in ("nearest", "bilinear", "area"):
            total = np.zeros(m)
            for to, at, w in resample.weights(n, m, method):
                assert 0 <= at < n
                total[to] += w
            assert np.allclose(total, 1)
    with pytest.raises(ValueError):
        resample.weights(0, 3, "area")
