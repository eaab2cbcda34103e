"""Training in global batches, settings of optimizers, tails of batches, sweeps."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import gaussian
from test_training import fixed_rows

from densityflow.operators import mlp, sweep


def in_one_process(net, rows, epochs, batch, seed, steps, tail=True):
    p = rows.toPandas()
    losses = []
    for epoch in range(1, epochs + 1):
        order = sorted(range(len(p)), key=lambda i: hashlib.md5(f"{seed}:{epoch}:{p['row'][i]}".encode()).hexdigest())
        loss = weight = 0.0
        for k in range(0, len(order) if tail else len(order) - len(order) % batch, batch):
            part = order[k : k + batch]
            x, z, w = np.array(p["x"][part].tolist()), np.array(p["z"][part].tolist()), p["w"][part].to_numpy()
            here, g = mlp.gradient(net, x, z, w)
            scale = w.sum() * z.shape[1]
            net = steps.update(net, [[q / scale for q in layer] for layer in g])
            loss, weight = loss + here, weight + scale
        losses.append(loss / weight)
    return net, losses


def two_dims(spark, n=300):
    x = F.col("id") / (n / 4) - 2
    return spark.range(n).select(F.col("id").alias("row"), F.array(x, -x * x).alias("x"), F.array(x * 0.1, F.sin(x)).alias("z"), (1.0 + F.col("id") % 3).alias("w"))


@pytest.mark.parametrize("tail", [True, False])
def test_synchronous_equals_one_process(spark, tail):
    rows = two_dims(spark)
    net = mlp.build([2, 8, 2], 1)
    want, losses = in_one_process(net, rows, 2, 64, 9, mlp.Adam(net, 1e-2, (0.8, 0.99), 1e-6), tail)
    begin = mlp.start(net, 1e-2, betas=(0.8, 0.99), eps=1e-6)
    for table in (rows, rows.repartition(7)):
        got = mlp.train(begin, table, 2, batch=64, seed=9, synchronous=True, tail=tail)
        assert np.allclose(mlp._flat(got.net), mlp._flat(want), atol=1e-8)
        assert np.allclose(got.losses, losses, atol=1e-8)
    assert got.adam.step == 2 * (5 if tail else 4)
    assert begin.adam.step == 0


def test_synchronous_goes_on_with_fresh_noise(spark):
    points = gaussian(spark, 200)
    model = mlp.fit(points, 1, 0.5, (8,), epochs=3, batch=50, synchronous=True)
    again = mlp.fit(points, 1, 0.5, (8,), epochs=2, batch=50, synchronous=True, state=mlp.fit(points, 1, 0.5, (8,), epochs=1, batch=50, synchronous=True).state)
    assert np.allclose(mlp._flat(model.state.net), mlp._flat(again.state.net))
    assert model.state.adam.step == 12
    with pytest.raises(ValueError, match="no rows"):
        mlp.train(mlp.start(model.state.net), fixed_rows(spark).where("false"), 1, synchronous=True)


def test_descent_with_momentum(spark):
    rows = two_dims(spark, 120)
    net = mlp.build([2, 4, 2], 2)
    want, _ = in_one_process(net, rows, 2, 50, 3, mlp.Descent(net, 0.05, momentum=0.9))
    got = mlp.train(mlp.start(net, 0.05, optimizer=mlp.Descent, momentum=0.9), rows, 2, batch=50, seed=3, synchronous=True)
    assert np.allclose(mlp._flat(got.net), mlp._flat(want), atol=1e-8)
    averaged = mlp.train(mlp.start(net, 0.05, optimizer=mlp.Descent, momentum=0.9), rows, 2, batch=50, seed=3)
    assert np.allclose(mlp._flat(averaged.net), mlp._flat(want), atol=1e-8)  # one shard is one process


def test_shards_follow_from_the_rows(spark, monkeypatch):
    monkeypatch.setattr(mlp, "SHARD_ROWS", 100)
    rows = fixed_rows(spark, 450)
    net = mlp.build([1, 4, 1], 0)
    default = mlp.train(mlp.start(net), rows, 1, batch=50, seed=1)
    asked = mlp.train(mlp.start(net), rows, 1, batch=50, seed=1, shards=5)
    assert np.allclose(mlp._flat(default.net), mlp._flat(asked.net))
    placed = mlp.sharded(rows, 5).repartitionById(5, F.col("shard")).select("shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert sorted(placed) == [(k, k) for k in range(5)]


def test_rows_beyond_whole_batches_can_be_left_out(spark):
    rows = fixed_rows(spark, 130)
    net = mlp.build([1, 4, 1], 0)
    assert mlp.train(mlp.start(net), rows, 1, batch=50).adam.step == 3
    assert mlp.train(mlp.start(net), rows, 1, batch=50, tail=False).adam.step == 2


def test_sweep_of_networks(spark):
    points = gaussian(spark, 3000)
    net = mlp.build([1, 16, 1], 4)
    settings = [(0.05, 0.3, 1), (0.05, 0.3, 60), (0.02, 0.3, 60), (0.05, 0.6, 60)]
    got = sweep.sweep(points, settings, net, batch=8, seed=2).toPandas().sort_values(["prob", "sigma", "epochs"]).reset_index(drop=True)
    assert list(zip(got["prob"], got["sigma"], got["epochs"], strict=True)) == sorted(settings)
    by = {(r.prob, r.sigma, r.epochs): r for r in got.itertuples()}
    assert by[0.05, 0.3, 60].loss < by[0.05, 0.3, 1].loss
    assert by[0.05, 0.3, 60].kl < by[0.05, 0.3, 1].kl
    assert by[0.05, 0.3, 60].kl < 0.1
    assert by[0.05, 0.3, 60].seconds > by[0.05, 0.3, 1].seconds > 0
    assert by[0.02, 0.3, 60].cells > by[0.05, 0.3, 60].cells
    with pytest.raises(ValueError, match="no such setting"):
        sweep.sweep(points, [(0.0, 0.1, 1)], net)
    assert sweep.sweep(points.where("false"), settings, net).count() == 0
