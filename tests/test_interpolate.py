"""Interpolation on irregular places, subsets by counted digests, leading axes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from densityflow.operators import density, interpolate, spectral, transform


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


@pytest.mark.parametrize("parts", [1, 9])
def test_equals_numpy(spark, parts):
    r = np.random.default_rng(parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        for n, m in ((1, 20), (2, 50), (300, 500)):
            x, g = np.sort(r.exponential(3, n)), np.r_[r.exponential(4, m), -1.0, 1e6]
            y = r.normal(size=n)
            g[:5] = x[r.integers(0, n, 5)]
            got = interpolate.interpolated(frame(spark, k="a", x=x, y=y).repartition(3), frame(spark, k="a", i=np.arange(len(g)), g=g), ["k"]).toPandas().sort_values("i")
            assert list(got.columns) == ["k", "i", "g", "y"]
            assert np.allclose(got["y"], np.interp(g, x, y), atol=1e-9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hot_places_are_cut(spark):
    """A third of all rows at one place go to several ranges, and each finds the samples around."""
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        grid = spark.range(3000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, 5.5).otherwise(F.col("id") / 300.0).alias("g"))
        samples = spark.range(11).select(F.col("id").cast("double").alias("x"), (F.col("id") * F.col("id")).cast("double").alias("y"))
        got = interpolate.interpolated(samples, grid, []).toPandas()
        assert len(got) == 3000
        assert np.allclose(got["y"], np.interp(got["g"], np.arange(11), np.arange(11) ** 2))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_row_reads_its_range_to_the_end(spark):
    """A frame that ends with the range is read anew for each row, in the square of the range's rows."""
    x = np.arange(0.0, 3000.0, 3.0)
    grid = spark.range(4000).select(F.col("id").alias("i"), (F.col("id") - 500).cast("double").alias("g"))
    found = interpolate.interpolated(frame(spark, x=x, y=np.sin(x)), grid, [])
    assert "unboundedfollowing" not in found._jdf.queryExecution().executedPlan().toString().lower()
    got = found.toPandas()
    assert len(got) == 4000 and np.allclose(got["y"], np.interp(got["g"], x, np.sin(x)))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    samples = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 4.0), ("a", None, 1.0), ("a", 3.0, nan), ("a", inf, 7.0), (None, 0.0, 5.0)], "k string, x double, y double")
    grid = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("a", None), ("a", nan), ("b", 1.0), (None, 9.0), ("a", 2.0)], "k string, g double")
    got = [(r.k, r.y) for r in interpolate.interpolated(samples, grid, ["k"]).collect()]
    assert sorted(got, key=repr) == sorted([("a", 3.0)] * 3 + [("a", None)] * 2 + [("b", None), (None, 5.0)], key=repr)
    assert interpolate.interpolated(samples.where("false"), grid, ["k"]).where("y IS NOT NULL").count() == 0
    assert interpolate.interpolated(samples, grid.where("false"), ["k"]).count() == 0


def test_relative_entropy_of_densities(spark):
    x = np.sort(np.random.default_rng(0).uniform(-6, 6, 4000))
    p, q = (frame(spark, x=x, density=np.exp(-0.5 * (x - m) ** 2)) for m in (0.0, 0.5))
    assert density.relative_entropy_of(p, q, []).first().kl == pytest.approx(0.125, abs=0.005)
    assert density.relative_entropy_of(p, p, []).first().kl == pytest.approx(0.0, abs=1e-12)


@pytest.mark.parametrize("n", [0, 1, 17, 250, 499, 500, 900])
def test_exact_subset(spark, n):
    import hashlib

    df = spark.range(500).select(F.col("id").alias("row"), (F.col("id") * 2).alias("v"))
    kept = transform.exact_subset(df, n, 5, "row", width=1)
    want = sorted(range(500), key=lambda i: hashlib.md5(f"5:{i}".encode()).hexdigest())[:n]
    assert sorted(r.row for r in kept.collect()) == sorted(want)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Limit" not in plan and "Sort" not in plan and "TakeOrdered" not in plan


def test_exact_subset_of_repeated_keys(spark):
    df = spark.range(90).select(F.lit("same").alias("row"), "id")
    assert transform.exact_subset(df, 40, 1, "row").count() == 40
    assert transform.exact_subset(df.where("false"), 4, 1, "row").count() == 0


def test_leading_axes_equal_those_of_the_covariance(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 30)) * np.linspace(3, 0.5, 30) + r.normal(size=30) * 10
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "t long, x array<double>").repartition(5)
    mean, axes, values = spectral.leading_axes(df, 3, more=6)
    m2, a2, v2 = spectral.principal_axes(df, 3)
    assert np.allclose(mean, m2) and np.allclose(values, v2) and np.allclose(axes, a2, atol=1e-6)
    mean, axes, values = spectral.leading_axes(df, 30)
    assert np.allclose(values.sum(), np.trace(np.cov(x.T)))
    with pytest.raises(ValueError, match="two snapshots"):
        spectral.leading_axes(df.limit(1), 2)


def test_leading_axes_settle_on_a_flat_spectrum(spark):
    x = np.random.default_rng(5).normal(size=(2000, 64))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "t long, x array<double>").repartition(3)
    _, axes, values = spectral.leading_axes(df, 4)
    _, a2, v2 = spectral.principal_axes(df, 4)
    assert np.allclose(values, v2, rtol=1e-12) and np.allclose(axes, a2, rtol=0, atol=1e-9)
    with pytest.raises(ArithmeticError, match="settled"):
        spectral.leading_axes(df, 4, most=1)
