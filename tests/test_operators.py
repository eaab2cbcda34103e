import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from densityflow.operators import decorrelation, density, kgmm, langevin, mlp, spectral, transform
from densityflow.plans import catalog
from densityflow.sources import store


def gaussian(spark, n):
    from densityflow.functions.noise import hash_normal, noise_key

    return spark.range(n).select(F.col("id").alias("row"), hash_normal(noise_key(1, 0, F.col("id"), 0)).alias("y0"))


def test_score_of_a_gaussian(spark):
    sigma = 0.5
    noisy = kgmm.draw(gaussian(spark, 20_000), F.lit(sigma), range(1, 5), 3).withColumn("cell", kgmm.grid_cell(F.col("x0"), -2.0, 0.25, 16))
    got = kgmm.scores(kgmm.cell_sums(noisy, ["cell"]), ["cell"], F.lit(sigma)).toPandas()
    want = -got.center0 / (1 + sigma**2)
    weight = got.n / got.n.sum()
    assert math.sqrt((weight * (got.score0 - want) ** 2).sum()) < 0.06
    assert got.n.sum() == 80_000


def test_batches_merge(spark):
    noisy = kgmm.draw(gaussian(spark, 500), F.lit(0.1), range(1, 3), 3).withColumn("cell", kgmm.grid_cell(F.col("x0"), -2.0, 0.5, 8))
    parts = [kgmm.cell_sums(noisy.where(f"row % 2 = {k}"), ["cell"]) for k in (0, 1)]
    whole = kgmm.cell_sums(noisy, ["cell"]).toPandas().sort_values("cell")
    both = kgmm.merge_sums(parts[0].unionByName(parts[1]), ["cell"]).toPandas().sort_values("cell")
    assert np.allclose(whole.to_numpy(float), both[whole.columns].to_numpy(float))


def test_convergence_stops(spark):
    points = gaussian(spark, 300)
    cell = lambda n: kgmm.grid_cell(n["x0"], -2.0, 0.5, 8)
    assert kgmm.converge(points, 0.1, cell, 3, conv=1e9)[1] == 2
    assert kgmm.converge(points, 0.1, cell, 3, conv=0.0, most=3)[1] == 3


def snapshots(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "t long, x array<double>")


def test_shifts(spark):
    s = snapshots(spark, [[1, 2, 3, 4], [5, 6, 7, 8]])
    got = {r.t: r.x for r in transform.stack_circshifts(s, 2, 2).collect()}
    assert got == {0: [1, 2, 3, 4], 1: [5, 6, 7, 8], 2: [4, 1, 2, 3], 3: [8, 5, 6, 7]}
    got = {r.t: r.x for r in transform.augment_circular(s, 2, 4, 2).collect()}
    assert got[2] == [3, 4, 1, 2]
    assert {r.t: r.x for r in transform.augment_circular(s, 1, 4, 2).collect()} == {r.t: r.x for r in s.collect()}
    for factor in (0, 3, 5):
        with pytest.raises(ValueError):
            transform.augment_circular(s, factor, 4, 2)
    with pytest.raises(ValueError):
        transform.stack_circshifts(s, 0, 2)


def test_forms_and_scales(spark):
    s = snapshots(spark, [[1, 5], [3, 5]])
    assert sorted(map(tuple, transform.to_snapshots(transform.to_long(s)).collect())) == sorted(map(tuple, s.collect()))
    by = {r.dim: r for r in transform.scales(transform.to_long(s), zero_std="one").collect()}
    assert by[1].std == 1.0 and by[0].mean == 2.0
    assert {r.std for r in transform.scales(transform.to_long(s)).collect()} == {math.sqrt(2), transform.EPS}


def test_histogram_cases(spark):
    assert density.histogram(spark.createDataFrame([], "x double")).count() == 0
    r = density.histogram(spark.createDataFrame([(5.0,), (5.0,)], "x double")).collect()
    assert len(r) == 1 and r[0].x == 5.0 and r[0].density is None
    h = density.histogram(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (2.0,), (1.5,)], "x double"))
    assert h.count() == 50
    assert math.isclose(h.agg(F.sum(F.col("density") * F.col("width"))).first()[0], 1.0)
    assert math.isclose(density.smooth(h).agg(F.sum(F.col("density") * F.col("width"))).first()[0], 1.0, abs_tol=0.1)


def test_entropy_of_shifted_gaussians(spark):
    g = gaussian(spark, 20_000).select(F.col("y0").alias("x"))
    assert abs(density.relative_entropy(g, g, []).first().kl) < 1e-9
    kl = density.relative_entropy(g, g.select((F.col("x") + 0.5).alias("x")), []).first().kl
    assert abs(kl - 0.125) < 0.02


def test_ranges(spark):
    none = density.robust_range(spark.createDataFrame([], "x double")).first()
    assert (none.low, none.high) == (-1.0, 1.0)
    one = density.robust_range(spark.createDataFrame([(2.0,)], "x double")).first()
    assert one.low < 2.0 < one.high


def test_autoregression_time(spark):
    rng, x, phi = np.random.default_rng(1), [0.0], 0.5
    for _ in range(3999):
        x.append(phi * x[-1] + rng.standard_normal())
    long = spark.createDataFrame(pd.DataFrame({"t": range(4000), "dim": 0, "x": x}))
    tau = decorrelation.long_decorrelation_times(long, 4).first().tau
    assert abs(tau - (1 + phi) / (1 - phi)) < 0.7
    flat = spark.createDataFrame([(t, 0, 1.0) for t in range(5)], "t long, dim int, x double")
    assert decorrelation.decorrelation_times(decorrelation.autocorrelation(flat, 3)).first().tau == 1.0


def test_network_gradient_and_jacobian(spark):
    net = mlp.build([2, 5, 2], 3)
    rng = np.random.default_rng(0)
    x, z, w = rng.standard_normal((7, 2)), rng.standard_normal((7, 2)), rng.random(7)
    loss, grads = mlp.gradient(net, x, z, w)
    h = 1e-6
    moved = [(a.copy(), b.copy()) for a, b in net]
    moved[0][0][1, 1] += h
    assert abs((mlp.gradient(moved, x, z, w)[0] - loss) / h - grads[0][0][1, 1]) < 1e-3
    numeric = (mlp.forward(net, x + [h, 0])[0] - mlp.forward(net, x)[0]) / h
    assert np.allclose(mlp.jacobians(net, x)[:, :, 0], numeric, atol=1e-4)
    assert np.allclose(mlp.divergences(net, x), np.trace(mlp.jacobians(net, x), axis1=1, axis2=2))
    v = rng.standard_normal((7, 2))
    assert np.allclose(mlp.push(net, x, v), np.einsum("roi,ri->ro", mlp.jacobians(net, x), v))
    df = spark.createDataFrame([(k, list(map(float, r))) for k, r in enumerate(x)], "t long, x array<double>").repartition(3)
    got = {r.t: r.x for r in mlp.scores(net, df, 0.5).collect()}
    assert np.allclose([got[k] for k in range(7)], -mlp.forward(net, x)[0] / 0.5)


@pytest.mark.parametrize("name", sorted(mlp.ACTIVATIONS))
def test_activation_slopes(name):
    f, slope = mlp.ACTIVATIONS[name]
    u = np.linspace(-3, 3, 20)
    assert np.allclose((f(u + 1e-6) - f(u - 1e-6)) / 2e-6, slope(u), atol=1e-5)


def test_one_dimensional_probe_is_exact(spark):
    net, x = mlp.build([1, 8, 1], 2), np.linspace(-2, 2, 9)
    df = spark.createDataFrame([(k, [float(v)]) for k, v in enumerate(x)], "t long, x array<double>")
    exact = sorted(map(tuple, mlp.divergence(net, df, 0.3).collect()))
    assert np.allclose(exact, sorted(map(tuple, mlp.probed_divergence(net, df.repartition(4), 0.3, 1, 2).collect())))


def test_wide_network_is_planned(spark):
    net = mlp.build([64, 128, 128, 64], 1)
    df = spark.range(300).select(F.col("id").alias("t"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda j: F.sin(F.col("id") * j)).alias("x"))
    assert mlp.divergence(net, df, 0.1).count() == 300




def test_trajectories(spark):
    starts = spark.createDataFrame([(0, [0.5]), (1, [3.0])], "traj long, x array<double>")
    out = langevin.evolve(starts, lambda x: -x, 0.0, 0.1, 10, 5, (-1.0, 1.0), 1)
    got = {(r.traj, r.k): r.x[0] for r in out.collect()}
    assert len(got) == 6 and math.isclose(got[0, 2], 0.5 * 0.9**10) and got[1, 1] <= 1.0
    assert transform.burned_in(out, 5, 5).count() == 2
    with pytest.raises(ValueError):
        langevin.evolve(starts, lambda x: x, 0.0, 0.1, 1, 1, (1.0, 1.0), 1)


def test_fourier_needs_even(spark):
    with pytest.raises(ValueError):
        spectral.fourier_pack(snapshots(spark, [[1, 2, 3]]), 3)
    s = snapshots(spark, [[1, 2, 3, 5]])
    assert np.allclose(spectral.fourier_pack(s, 4).first().x, [11, -2, 3, -3])
    assert np.allclose(spectral.fourier_unpack(spectral.fourier_pack(s, 4), 4).first().x, [1, 2, 3, 5])


def test_store(spark, tmp_path):
    values = {"flag": True, "n": 3, "x": 0.5, "c": 1 + 2j, "s": "text", "a": np.arange(6.0).reshape(2, 3), "z": np.array([1 + 1j, 2.0])}
    store.save(store.variables(spark, values), str(tmp_path / "v"))
    back = store.as_python(store.load(spark, str(tmp_path / "v")))
    assert back.keys() == values.keys() and back["flag"] is True and back["c"] == 1 + 2j
    assert np.array_equal(back["a"], values["a"]) and np.array_equal(back["z"], values["z"])
    net = mlp.build([2, 3, 1], 1)
    store.save_network(spark, net, str(tmp_path / "m"), "tanh")
    assert store.load_activation(spark, str(tmp_path / "m")) == "tanh"
    again = store.load_network(spark, str(tmp_path / "m"))
    assert all(np.array_equal(p, q) for a, b in zip(net, again, strict=True) for p, q in zip(a, b, strict=True))
    names = spark.createDataFrame([("run_007",), ("run_x",), ("other_9",)], "name string")
    assert store.next_run(names).first().run == "run_008"
    assert store.next_run(names.where("false")).first().run == "run_001"
    spark.range(3).createOrReplaceTempView("kept_view")
    store.save_views(spark, str(tmp_path / "w"))
    spark.catalog.dropTempView("kept_view")
    assert store.load_views(spark, str(tmp_path / "w"), ["kept_view"]) == ["kept_view"]
    assert store.load_views(spark, str(tmp_path / "w"), ["kept_view"]) == []
    spark.catalog.dropTempView("kept_view")


@pytest.mark.parametrize("name", ["decorrelation_times", "decorrelation_metrics"])
def test_decorrelation_goes_on_beyond_the_first_lags(spark, monkeypatch, name):
    x = np.sin(2 * np.pi * np.arange(720) / 360)
    long = spark.createDataFrame([(t, 0, float(v)) for t, v in enumerate(x)], "t long, dim int, x double")
    monkeypatch.setattr(catalog, "_hours", lambda spark, d: long)
    d = x - x.mean()
    rho = [(d[k:] * d[: 720 - k]).sum() / (720 - k) / (d * d).mean() for k in range(720)]
    stop = next(k for k in range(1, 720) if rho[k] <= 0)
    assert stop > catalog.LAGS and abs(catalog.QUERIES[name](spark, "").first().tau - (1 + 2 * sum(rho[1:stop]))) < 1e-4
