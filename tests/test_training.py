"""Estimates in cells, training, quantiles, ranks and readers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_operators import gaussian

from densityflow.operators import decorrelation, density, kgmm, mlp, transform
from densityflow.sources import store


def fixed_rows(spark, n=400):
    x = F.col("id") / (n / 4) - 2
    return spark.range(n).select(F.col("id").alias("row"), F.array(x).alias("x"), F.array(x * 0.1).alias("z"), F.lit(1.0).alias("w"))


def test_training_lowers_the_loss_and_goes_on(spark):
    rows = fixed_rows(spark)
    begin = mlp.start(mlp.build([1, 16, 1], 0), 1e-2)
    whole = mlp.train(begin, rows, 6, batch=32, seed=2, check=rows)
    assert whole.losses[-1] < 0.3 * whole.losses[0]
    assert len(whole.checks) == 6
    half = mlp.train(begin, rows, 3, batch=32, seed=2)
    assert half.adam.step == 3 * 13
    again = mlp.train(half, rows, 3, batch=32, seed=2)
    assert np.allclose(again.losses, whole.losses)
    assert np.allclose(mlp._flat(again.net), mlp._flat(whole.net))
    other = mlp.train(begin, rows.repartition(7), 6, batch=32, seed=2)
    assert np.allclose(mlp._flat(other.net), mlp._flat(whole.net))
    several = mlp.train(begin, rows, 6, batch=32, shards=3, seed=2)
    assert several.losses[-1] < 0.5 * several.losses[0]


def test_one_whole_batch_is_one_step_of_adam(spark):
    rows = fixed_rows(spark, 50)
    net = mlp.build([1, 4, 1], 3)
    p = rows.toPandas()
    x, z = np.array(p["x"].tolist()), np.array(p["z"].tolist())
    loss, g = mlp.gradient(net, x, z, np.ones(50))
    want = mlp.Adam(net, 1e-2).update(net, [[q / 50 for q in layer] for layer in g])
    got = mlp.train(mlp.start(net, 1e-2), rows, 1, batch=100)
    assert np.allclose(mlp._flat(got.net), mlp._flat(want))
    assert abs(got.losses[0] - loss / 50) < 1e-12
    assert abs(mlp.full_loss(mlp.start(net), rows) - loss / 50) < 1e-12


def test_fit(spark):
    points = gaussian(spark, 400)
    model = mlp.fit(points, 1, 0.3, (8,), epochs=2, batch=64, preprocessing=True, prob=0.1, most=3)
    t = points.select(F.col("row").alias("t"), F.array("y0").alias("x"))
    assert model.score(t).count() == model.divergence(t).count() == 400
    assert model.cells.count() <= 16
    off = mlp.fit(points, 1, 0.3, (8,), epochs=1, batch=64, divergence=False, jacobian=False, state=model.state)
    assert off.divergence(t).agg(F.max(F.abs("divergence"))).first()[0] == 0.0
    assert off.jacobian(t).first().x == [0.0]
    assert len(off.state.losses) == 3
    assert mlp.noise_loss(model.state, points, 0.3, 1, 2, 5) > 0
    with pytest.raises(ValueError, match="no rows"):
        mlp.fit(points.where("false"), 1, 0.3, (8,), epochs=1)


def test_estimate(spark):
    sigma = 0.5
    points = gaussian(spark, 20_000)
    got, rounds = kgmm.estimate(points, sigma, prob=1 / 16, conv=1e-3, most=6, seed=3)
    got = got.toPandas()
    assert 2 <= rounds <= 6
    assert 8 <= len(got) <= 16
    assert np.allclose(got.score0, -got.center0 / (1 + sigma**2), atol=0.12)
    with pytest.raises(ValueError, match="no observations"):
        kgmm.estimate(points.where("false"), sigma)
    grid = lambda sample, prob: lambda n: kgmm.grid_cell(n["x0"], -2.0, 1.0, 4)
    assert kgmm.estimate(points, sigma, partition=grid, most=1)[0].count() == 4


@pytest.mark.parametrize("in_order", [100_000, 0])
def test_quantiles_equal_percentiles(spark, monkeypatch, in_order):
    monkeypatch.setattr(density, "IN_ORDER", in_order)
    r = np.random.default_rng(4)
    values = np.r_[r.lognormal(0, 3, 3000), np.full(500, 1.25), [np.nan, np.inf, -np.inf]]
    k = np.arange(len(values)) % 3
    df = spark.createDataFrame(pd.DataFrame({"k": k, "x": values}))
    shares = {"a": 0.0, "b": 0.001, "c": 0.25, "d": 0.5, "e": 0.999, "f": 1.0}
    ok = np.isfinite(values)
    for keys, sets in (([], {(): ok}), (["k"], {(j,): ok & (k == j) for j in range(3)})):
        got = {tuple(row[c] for c in keys): [row[s] for s in shares] for row in density.quantiles(df, keys, shares, parts=7).collect()}
        assert set(got) == set(sets)
        for key, mine in sets.items():
            assert np.allclose(got[key], np.quantile(values[mine], list(shares.values())), rtol=1e-12)
    assert density.quantiles(df.where("false"), [], shares).collect() == []


def test_bivariate_without_width_or_pairs(spark):
    one = spark.createDataFrame([(1.0, float(k)) for k in range(5)], "x double, y double")
    assert density.bivariate(one).collect() == [(0, 0, 0.0)]
    assert density.bivariate(one.where("false")).collect() == [(0, 0, 0.0)]
    assert density.bivariate(one, 4, (5.0, 6.0), (0.0, 4.0)).collect() == [(0, 0, 0.0)]
    odd = spark.createDataFrame([(float(k), float(k)) for k in range(9)] + [(float("nan"), 1.0), (float("inf"), 2.0), (None, 1.0)], "x double, y double")
    assert abs(density.bivariate(odd, 2).agg(F.sum("density")).first()[0] * 16 - 1) < 1e-12


def test_values_that_are_not_finite_change_no_density(spark):
    good = spark.createDataFrame([(float(k % 17),) for k in range(300)], "x double")
    bad = good.union(spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double"))
    for f in (density.histogram, lambda v: density.kde(v.withColumn("k", F.lit(1)), ["k"], 64)):
        assert np.allclose(sorted(map(tuple, f(good).collect())), sorted(map(tuple, f(bad).collect())))


def test_lag_means_without_variance(spark):
    rows = [(t, [1.0, float(t), float(-t), float(t * t)]) for t in range(6)]
    df = spark.createDataFrame(rows, "t long, x array<double>")
    got = {r.lag: r.r for r in decorrelation.lag_means(df, 4).collect()}
    x = np.array([r[1] for r in rows])
    for lag in range(4):
        pairs = [(i, (i + lag) % 4) for i in range(4) if i != 0 and (i + lag) % 4 != 0]
        assert abs(got[lag] - np.mean([np.corrcoef(x[:, i], x[:, j])[0, 1] for i, j in pairs])) < 1e-9


def test_analysis_of_few_rows(spark):
    one = spark.createDataFrame([(0, 0, 3.0)], "t long, dim int, x double")
    assert decorrelation.analysis(one).collect() == [(0, 1.0, 1.0)]
    assert decorrelation.analysis(one.where("false")).collect() == []
    none = spark.createDataFrame([], "t long, x array<double>")
    assert decorrelation.analysis(one.where("false"), none).first().tau == 0.0


def test_ranks_and_numbers(spark):
    df = spark.createDataFrame([((k * 37) % 101 * 1.0, float(k)) for k in range(101)], "x double, z double").repartition(5)
    got = sorted((r.n, r.x) for r in transform.numbered(df, ["x"], "n").collect())
    assert got == [(k, float(k)) for k in range(101)]
    z = {(k * 37) % 101: k for k in range(101)}
    near = {r.place: r.z for r in transform.nearest_by_rank(df, [-5.0, 50.2, 500.0], 10).collect()}
    for place, span in ((-5.0, range(10)), (50.2, range(46, 56)), (500.0, range(91, 101))):
        assert abs(near[place] - np.mean([z[k] for k in span])) < 1e-9
    with pytest.raises(ValueError, match="no points"):
        transform.nearest_by_rank(df.where("false"), [0.0], 3)


def test_mean_field_of_other_dimensions_is_refused(spark):
    long = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "t long, dim int, x double")
    with pytest.raises(ValueError, match="other dimensions"):
        transform.add_mean_field(long, transform.dim_stats(long.where("dim = 0")))
    with pytest.raises(ValueError, match="other dimensions"):
        transform.add_mean_field(long.where("dim = 0"), transform.dim_stats(long))


def test_vectors_come_back(spark):
    df = spark.createDataFrame([([1.0, 5.0], [0.5, 2.0], [2.0, 4.0])], "x array<double>, m array<double>, s array<double>")
    one = df.select(transform.normalize_vector(F.col("x"), F.col("m"), F.col("s")).alias("n"), "m", "s")
    assert one.first().n == [0.25, 0.75]
    assert one.select(transform.unnormalize_vector(F.col("n"), F.col("m"), F.col("s")).alias("x")).first().x == [1.0, 5.0]


def test_fields_and_orientation(spark, tmp_path):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0], [9.0], "s"), (1, [4.0, 5.0, 6.0], [8.0], "s")], "t long, other array<double>, u array<double>, name string")
    assert store.field_of(df) == "u"
    assert store.field_of(df.drop("u")) == "other"
    for names, key in ((df, "name"), (df.select("t"), None)):
        with pytest.raises(ValueError, match="no array"):
            store.field_of(names, key)
    turned = store.oriented(df.select("t", F.col("other").alias("x"))).orderBy("t").collect()
    assert [(r.t, r.x) for r in turned] == [(0, [1.0, 4.0]), (1, [2.0, 5.0]), (2, [3.0, 6.0])]
    df.write.parquet(str(tmp_path / "series"))
    found = store.load_series(spark, str(tmp_path / "series"), 1, 1)
    assert found.collect() == [(0, [9.0])]
    assert "LessThan(t,1)" in found._jdf.queryExecution().executedPlan().toString()
