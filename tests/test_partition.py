"""Cells from trees: the distributed fit against one in memory, and batches against plain descent."""

import numpy as np
import pandas as pd
import pytest
from matching import assert_same
from pyspark.sql import functions as F
from test_operators import gaussian

from densityflow.operators import kgmm, partition
from densityflow.plans import catalog


def cloud(spark, n=3000, dims=3, seed=1):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(k, 0.2 + k, (n // 3, dims)) for k in range(3)])
    return x, spark.createDataFrame(pd.DataFrame({f"x{j}": x[:, j] for j in range(dims)})).repartition(5)


def signature(tree, x):
    """Groups of rows by their cell, whatever the numbers of nodes."""
    cell = tree.cell[tree.node(x)]
    return sorted(tuple(np.flatnonzero(cell == c)) for c in np.unique(cell))


@pytest.mark.parametrize("local_rows", [10_000, 700, 0])
def test_distributed_fit_equals_one_in_memory(spark, local_rows):
    x, df = cloud(spark)
    prob = 0.01
    got = partition.mass_tree(df, prob, local_rows=local_rows)
    normal, limit, left = partition.grown(x, 2 * prob * len(x))
    want = partition.Cells(normal, limit, left, partition.in_order(left))
    assert len(got) == len(want) > 40
    assert got.depth == want.depth
    assert signature(got, x) == signature(want, x)


def test_cells_hold_between_their_bounds(spark):
    x, df = cloud(spark, 9000)
    tree = partition.mass_tree(df, 0.002)
    n = np.bincount(tree.cell[tree.node(x)], minlength=len(tree))
    assert n.max() < 2 * 0.002 * len(x)
    assert n.sum() == len(x) and (n > 0).all()
    placed = df.select("x0", "x1", "x2", tree.of(df).alias("cell")).toPandas()
    assert (tree.cell[tree.node(placed[["x0", "x1", "x2"]].to_numpy())] == placed["cell"]).all()
    # leaves are numbered from left to right
    assert sorted(tree.cell[tree.left < 0].tolist()) == list(range(len(tree)))


def test_cells_of_equal_and_of_few_points(spark):
    same = spark.range(500).select(F.lit(2.5).alias("x0"), F.lit(-1.0).alias("x1"))
    assert len(partition.mass_tree(same, 0.01)) == 1
    assert len(partition.mass_tree(same, 0.01, local_rows=10)) == 1
    assert len(partition.mass_tree(same.limit(1), 1e-6)) == 1
    two = spark.createDataFrame([(0.0,)] * 300 + [(1.0,)] * 100, "x0 double")
    tree = partition.mass_tree(two, 0.01)
    assert len(tree) == 2
    assert two.groupBy(tree.of(two).alias("c")).count().orderBy("c").collect() == [(0, 300), (1, 100)]


def test_a_tree_that_is_too_large_is_refused(spark, monkeypatch):
    _, df = cloud(spark)
    monkeypatch.setattr(partition, "MOST_BYTES", 1000)
    with pytest.raises(ValueError, match="too large to broadcast"):
        partition.mass_tree(df, 0.002)


def test_plans_have_no_literal_for_a_cell(spark):
    _, df = cloud(spark)
    tree = partition.mass_tree(df, 0.0005)
    assert len(tree) > 500
    plan = df.select(tree.of(df).alias("c"))._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 2000
    deep = partition.MeanSplits(df, 11, 3)
    assert len(df.select(deep.cell(df).alias("c"))._jdf.queryExecution().executedPlan().toString()) < 2000


def test_mean_splits_of_many_levels(spark):
    points = gaussian(spark, 5000).withColumn("x0", F.col("y0"))
    tree = partition.MeanSplits(points, 9)
    assert len(tree.means) == 511
    n = points.groupBy(tree.cell(points).alias("cell")).count().toPandas()
    assert n["cell"].between(0, 511).all()
    assert len(n) > 400


def test_estimate_in_cells_by_mass(spark):
    sigma = 0.5
    found, _ = kgmm.estimate(gaussian(spark, 20_000), sigma, prob=0.02, most=3, seed=3)
    got = found.toPandas()
    assert 25 <= len(got) <= 50
    assert np.sqrt(np.average((got.score0 + got.center0 / (1 + sigma**2)) ** 2, weights=got.n)) < 0.12


@pytest.mark.parametrize("name", ["kgmm_bisecting", "kgmm_estimate_64d"])
def test_cells_of_a_query_are_fitted_to_all_points(spark, sf, duck, monkeypatch, name):
    """SQL fits them to every row; a table beyond the cap of a sample is stood for by a lower cap."""
    monkeypatch.setattr(kgmm, "partition_cap", lambda *_, **__: 100)
    assert_same(catalog.QUERIES[name](spark, sf), duck, catalog.ORACLES[name])
