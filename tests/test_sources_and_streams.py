"""Array files, state of streams, functions in SQL."""

import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from densityflow.functions import noise, sql
from densityflow.operators import kgmm
from densityflow.sources import arrays
from densityflow.streaming import stats

# ---- array files --------------------------------------------------------------------------------


@pytest.mark.parametrize("case", ["rows", "columns", "fortran", "vector", "ints", "floats"])
@pytest.mark.parametrize(("stride", "most"), [(1, None), (3, None), (7, 5), (1, 1000)])
def test_array_files(spark, tmp_path, case, stride, most):
    x = np.random.default_rng(1).normal(size=(101, 6)) * 100
    if case in ("ints", "floats"):
        x = x.astype("<i4" if case == "ints" else "<f4")
    stored = {"columns": x.T.copy(), "fortran": np.asfortranarray(x), "vector": x[:, 0]}.get(case, x)
    np.save(tmp_path / "a.npy", stored)
    got = sorted(arrays.load_array(spark, str(tmp_path / "a.npy"), stride, most).collect())
    want = x[:, :1] if case == "vector" else x
    kept = list(range(0, 101, stride))[:most]
    assert [r.t for r in got] == kept
    assert np.array_equal(np.array([r.x for r in got]), want[kept].astype(float))


def test_conditions_cut_the_ranges(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan, StringContains

    np.save(tmp_path / "a.npy", np.zeros((1000, 4)))
    reader = arrays.ArrayReader(str(tmp_path / "a.npy"), {"stride": "10", "rows": "100"})
    left = list(reader.pushFilters([GreaterThanOrEqual(("t",), 305), LessThan(("t",), 520), StringContains(("x",), "a")]))
    assert len(left) == 1
    parts = reader.partitions()
    assert [(p.first, p.last) for p in parts] == [(310, 410), (410, 510), (510, 520)]
    size, offset = 4 * 8, reader.layout.offset
    for p in parts:
        assert all(offset + p.first * size <= a < b <= offset + p.last * size for a, b in reader.spans(p))
    list(reader.pushFilters([EqualTo(("t",), 315)]))
    assert sum(len(list(reader.read(p))) for p in reader.partitions()) == 0


def test_far_times_are_read_one_by_one(tmp_path):
    np.save(tmp_path / "a.npy", np.arange(20_000 * 50, dtype=float).reshape(20_000, 50))
    reader = arrays.ArrayReader(str(tmp_path / "a.npy"), {"stride": "400"})
    part = arrays.Range(0, 4000)
    assert [b - a for a, b in reader.spans(part)] == [400] * 10
    (batch,) = reader.read(part)
    assert batch.column(1)[3].as_py()[0] == 1200 * 50


def test_filters_reach_the_source(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(900.0).reshape(300, 3))
    df = arrays.load_array(spark, str(tmp_path / "a.npy")).where("t >= 290 AND x[0] > 0")
    assert sorted(r.t for r in df.collect()) == list(range(290, 300))


def test_written_and_described(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(50, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "t long, x array<double>").repartition(5)
    path = str(tmp_path / "b.npy")
    arrays.save_array(df, path, 50, 4, dt=0.25)
    assert np.array_equal(np.load(path), x)
    assert arrays.describe(path) == {"times": 50, "places": 4, "dtype": "<f8", "dt": 0.25}
    os.remove(f"{path}.json")
    assert arrays.describe(path)["dt"] is None
    for times, places in ((49, 4), (50, 3), (51, 4)):
        with pytest.raises(Exception, match="doesn't fit|were to be written"):
            arrays.save_array(df, path, times, places)
    np.save(path, np.zeros((2, 2, 2)))
    with pytest.raises(ValueError, match="one or two axes"):
        arrays.layout(path)
    np.save(path, np.array(["a"]))
    with pytest.raises(ValueError, match="of numbers"):
        arrays.layout(path)


# ---- streams ------------------------------------------------------------------------------------


def test_state_goes_on_from_the_checkpoint(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / k) for k in ("in", "out", "cp"))
    every = spark.range(3000).select(F.col("id").alias("event_id"), noise.hash_normal(F.col("id").cast("string")).alias("value"))
    args = (folder, "event_id long, value double", "event_id", "value", 0.3, 5, -2.0, 0.5, 8, out, checkpoint)
    for k in range(2):
        every.where(F.col("event_id") % 2 == k).coalesce(1).write.mode("append").parquet(folder)
        stats.stream_cells(spark, *args)
    points = every.select(F.col("event_id").alias("row"), F.col("value").alias("y0"))
    noisy = kgmm.draw(points, F.lit(0.3), range(1, 2), 5).withColumn("cell", kgmm.grid_cell(F.col("x0"), -2.0, 0.5, 8))
    want = kgmm.cell_sums(noisy, ["cell"]).select("cell", *stats.SUMS).toPandas().sort_values("cell")
    got = stats.latest(spark, out).toPandas().sort_values("cell")
    assert np.allclose(got.to_numpy(float), want.to_numpy(float))
    deltas = stats.batch_deltas(spark, out).toPandas().sort_values("batch")
    assert deltas["n"].tolist() == [1500, 1500]
    assert deltas["delta"].iloc[0] == pytest.approx(1.0)
    assert 0 < deltas["delta"].iloc[1] < 0.5
    stats.stream_cells(spark, *args)  # nothing new
    assert len(glob.glob(f"{out}/batch=*")) == 2
    assert spark.conf.get(stats.PROVIDER, None) != stats.ROCKS


def test_a_batch_that_is_repeated_counts_once(spark, tmp_path):
    """The run that wrote its rows but not its commit writes them again from the state before."""
    folder, out, checkpoint = (str(tmp_path / k) for k in ("in", "out", "cp"))
    rows = spark.range(100).select(F.col("id").alias("event_id"), F.lit(1.0).alias("value"))
    args = (folder, "event_id long, value double", "event_id", "value", 0.3, 5, -2.0, 0.5, 8, out, checkpoint)
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(folder)
        stats.stream_cells(spark, *args)
    for f in (f"{checkpoint}/commits/1", f"{checkpoint}/commits/.1.crc"):
        os.remove(f)
    stats.stream_cells(spark, *args)
    assert stats.latest(spark, out).agg(F.sum("n")).first()[0] == 200


# ---- SQL ----------------------------------------------------------------------------------------


def test_functions_in_sql_equal_those_of_the_library(spark):
    assert set(sql.register(spark)) == {"swish", "swish_slope", "noise_key", "hash_uniform", "hash_normal", "grid_cell"}
    df = spark.range(50).select("id", F.concat(F.lit("k"), "id").alias("key"), ((F.col("id") - 25) / 4).alias("x"))
    df.createOrReplaceTempView("some_rows")
    got = spark.sql("SELECT id, hash_normal(key) AS a, hash_uniform(key) AS b, grid_cell(x, -2, 0.5, 8) AS c, swish(x) AS s, swish_slope(x) AS t, noise_key(7, 1, id, 2) AS k FROM some_rows").toPandas().sort_values("id")
    want = df.select("id", noise.hash_normal(F.col("key")).alias("a"), noise.hash_uniform(F.col("key")).alias("b"), kgmm.grid_cell(F.col("x"), -2.0, 0.5, 8).alias("c"), noise.noise_key(7, 1, F.col("id"), 2).alias("k")).toPandas().sort_values("id")
    assert (got[["a", "b", "c", "k"]].to_numpy() == want[["a", "b", "c", "k"]].to_numpy()).all()
    from densityflow.operators.mlp import ACTIVATIONS

    x = (got["id"] - 25) / 4
    assert np.allclose(got["s"], ACTIVATIONS["swish"][0](x)) and np.allclose(got["t"], ACTIVATIONS["swish"][1](x))
    plan = spark.sql("SELECT swish(x) FROM some_rows")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert json.dumps(plan)


# ---- runs ---------------------------------------------------------------------------------------


def test_runs_are_one_scan(spark, tmp_path):
    from densityflow.sources import store

    paths = {}
    for k in range(4):
        paths[f"run {k}"] = f"{'file://' if k % 2 else ''}{tmp_path}/store {k}"
        store.save(store.variables(spark, {"kl": k / 2, "clusters": 10 * k, "text": "x", "field": np.ones((2, 2))} | ({"only": 1.5} if k == 2 else {})), paths[f"run {k}"])
    store.save(store.variables(spark, {"kl": 99.0}), paths["run 1"] + "/elsewhere", "other")
    paths["again"] = paths["run 3"]
    found = store.read_runs(spark, paths, {"kl": -1.0, "only": 0.25, "clusters": 0.0})
    got = {r.run: (r.kl, r.only, r.clusters) for r in found.collect()}
    assert got == {"run 0": (0.0, 0.25, 0.0), "run 1": (0.5, 0.25, 10.0), "run 2": (1.0, 1.5, 20.0), "run 3": (1.5, 0.25, 30.0), "again": (1.5, 0.25, 30.0)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert store.read_runs(spark, {}, {"kl": 0.0}).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.read_runs(spark, {"none": f"{tmp_path}/none"}, {"kl": 0.0}).count()
