"""Sums at all lags against plain loops, with blocks shorter than the lags."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from densityflow.operators import blocks, decorrelation


def series(spark, x, dims=1):
    t = np.arange(len(x))
    return spark.createDataFrame(pd.DataFrame({"t": np.tile(t, dims), "dim": np.repeat(np.arange(dims), len(x)).astype("int32"), "d": np.concatenate([x * (k + 1) for k in range(dims)])}))


@pytest.mark.parametrize(("n", "lags", "length"), [(1, 0, 8), (7, 3, 8), (50, 49, 8), (64, 40, 16), (200, 199, 32), (33, 16, 16)])
def test_lag_sums(spark, monkeypatch, n, lags, length):
    monkeypatch.setattr(blocks, "LEAST_BLOCK", length)
    monkeypatch.setattr(blocks, "MOST_BLOCK", length)
    x = np.random.default_rng(n).normal(size=n)
    got = {(r.dim, r.k): r.s for r in blocks.lag_sums(series(spark, x, 2), lags).collect()}
    for dim in (0, 1):
        for k in range(lags + 1):
            assert got.get((dim, k), 0.0) == pytest.approx((x[: n - k] * x[k:]).sum() * (dim + 1) ** 2, abs=1e-9)
    assert max(k for _, k in got) <= lags


def test_gaps_repeats_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 8)
    monkeypatch.setattr(blocks, "MOST_BLOCK", 8)
    rows = [(0, 0, 1.0), (0, 3, 2.0), (0, 3, 4.0), (0, 21, -1.0), (0, 22, None), (0, 40, 0.5)]
    got = {r.k: r.s for r in blocks.lag_sums(spark.createDataFrame(rows, "dim int, t long, d double"), 40).collect()}
    want = {0: 1 + 36 + 1 + 0.25, 3: 6.0, 21: -1.0, 18: -6.0, 40: 0.5, 37: 3.0, 19: -0.5}
    for k in range(41):
        assert got.get(k, 0.0) == pytest.approx(want.get(k, 0.0), abs=1e-9)
    assert blocks.lag_sums(spark.createDataFrame([], "dim int, t long, d double"), 4).count() == 0


def test_autocorrelation_of_a_large_offset_and_of_a_constant(spark):
    r = np.random.default_rng(2)
    x = 1e6 + np.convolve(r.normal(size=700), np.ones(5), "valid")
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(len(x)), "dim": 0, "x": x})).withColumn("dim", F.col("dim").cast("int"))
    got = decorrelation.autocorrelation(df, len(x) - 1).toPandas().sort_values("k")
    d = x - x.mean()
    want = np.array([(d[: len(d) - k] * d[k:]).sum() / (len(d) - k) for k in range(len(d))])
    assert np.allclose(got["rho"], want / want[0], atol=1e-7)
    flat = decorrelation.autocorrelation(df.withColumn("x", F.lit(3.0)), 4).toPandas()
    assert len(flat) == 5 and flat["rho"].isna().all()


def test_a_million_times_with_many_lags(spark):
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("t"), F.lit(0).alias("dim"), F.sin(F.col("id") / 50_000.0).alias("x"))
    began = time.perf_counter()
    rho = decorrelation.autocorrelation(df, 100_000)
    tau = decorrelation.decorrelation_times(rho).collect()
    assert time.perf_counter() - began < 60
    assert len(tau) == 1 and tau[0].tau > 1
