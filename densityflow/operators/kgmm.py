"""Scores and divergences of smoothed data by averages of noise in cells of state space.

x = y + sigma * z with z standard normal; in each cell, -E[z] / sigma estimates the score and
(E|z|^2 - d) / sigma^2 - |score|^2 its divergence. One projection and one aggregation; sums, not
means, are kept, so that rounds and batches merge.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densityflow.functions.noise import hash_normal, noise_key
from densityflow.operators.partition import mass_tree
from densityflow.sources.store import dropped, stored


def draw(points: DataFrame, sigma: Column, rounds: range, seed: int, dims: int = 1) -> DataFrame:
    """points: (row, y0 ..). Each round's noisy points: round, x0 .., z0 .."""
    out = points.withColumn("round", F.explode(F.array(*[F.lit(r) for r in rounds])))
    for j in range(dims):
        out = out.withColumn(f"z{j}", hash_normal(noise_key(seed, F.col("round"), F.col("row"), j + 1)))
    return out.select("*", *[(F.col(f"y{j}") + sigma * F.col(f"z{j}")).alias(f"x{j}") for j in range(dims)])


def grid_cell(x: Column, low: float, width: float, cells: int) -> Column:
    return F.least(F.greatest(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(0)), F.lit(cells - 1)).cast("int")


def cell_sums(noisy: DataFrame, keys: list[str], dims: int = 1) -> DataFrame:
    norm = sum((F.col(f"z{j}") * F.col(f"z{j}") for j in range(1, dims)), F.col("z0") * F.col("z0"))
    sums = [F.sum(f"{v}{j}").alias(f"s{v}{j}") for v in "zx" for j in range(dims)]
    return noisy.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(norm).alias("szz"), *sums)


def merge_sums(parts: DataFrame, keys: list[str], dims: int = 1) -> DataFrame:
    names = ["n", "szz", *(f"s{v}{j}" for v in "zx" for j in range(dims))]
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])


def scores(sums: DataFrame, keys: list[str], sigma: Column, dims: int = 1) -> DataFrame:
    n = F.col("n")
    score = [-(F.col(f"sz{j}") / n) / sigma for j in range(dims)]
    square = sum((s * s for s in score[1:]), score[0] * score[0])
    out = [*keys, F.col("n"), *[(F.col(f"sx{j}") / n).alias(f"center{j}") for j in range(dims)], *[s.alias(f"score{j}") for j, s in enumerate(score)]]
    return sums.select(*out, ((F.col("szz") / n - F.lit(float(dims))) / (sigma * sigma) - square).alias("divergence"))


def training_set(result: DataFrame, sigma: float, dims: int = 1) -> DataFrame:
    """(center, z target, weight): what a network learns E[z|x] from."""
    return result.select(*[f"center{j}" for j in range(dims)], *[(-F.lit(sigma) * F.col(f"score{j}")).alias(f"target{j}") for j in range(dims)], F.col("n").alias("weight"))


def trace(noisy: DataFrame, rounds: int, dims: int = 1) -> DataFrame:
    """(round, delta): how far the cumulative means of z moved in each round after the first."""
    z = [f"z{j}" for j in range(dims)]
    each = noisy.groupBy("round", "cell").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in z])
    upto = each.select(F.explode(F.sequence(F.col("round"), F.lit(rounds))).alias("round"), "cell", "n", *z)
    upto = upto.groupBy("round", "cell").agg(*[(F.sum(c) / F.sum("n")).alias(c) for c in z])
    last = upto.select((F.col("round") + 1).alias("round"), "cell", *[F.col(c).alias(f"old_{c}") for c in z])
    return upto.join(last, ["round", "cell"], "left").where("round > 1").groupBy("round").agg(_moved(z).alias("delta"))


def _moved(z: list[str]) -> Column:
    """The squared distance of the means from the old ones, by their squared size."""
    new = sum((F.col(c) * F.col(c) for c in z[1:]), F.col(z[0]) * F.col(z[0]))
    steps = [F.col(c) - F.coalesce(f"old_{c}", F.lit(0.0)) for c in z]
    step = sum((d * d for d in steps[1:]), steps[0] * steps[0])
    return F.coalesce(F.sum(step), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(new), F.lit(0.0)), F.lit(1e-300))


def converge(points: DataFrame, sigma: float, cell: Callable[[DataFrame], Column], seed: int, conv: float = 1e-2, most: int = 150, dims: int = 1) -> tuple[DataFrame, int]:
    """Adds rounds of noise until the means of z move by at most conv, at most so many: the scores, and
    how many rounds it took. cell names the cell of noisy points (x0 ..). The table of cells is stored
    after each round."""
    z = [f"z{j}" for j in range(dims)]
    total, old, round_ = None, None, 0
    while True:
        round_ += 1
        noisy = draw(points, F.lit(sigma), range(round_, round_ + 1), seed, dims)
        new = cell_sums(noisy.withColumn("cell", cell(noisy)), ["cell"], dims)
        before, total = total, stored(new if total is None else merge_sums(total.unionByName(new), ["cell"], dims))
        means = total.select("cell", *[(F.col(f"s{c}") / F.col("n")).alias(c) for c in z])
        still = old is not None and means.join(old, "cell", "left").agg(_moved(z)).first()[0] <= conv
        if before is not None:
            dropped(before)
        if still or round_ >= most:
            break
        old = means.select("cell", *[F.col(c).alias(f"old_{c}") for c in z])
    return scores(total, ["cell"], F.lit(sigma), dims), round_


def on_stride(points: DataFrame, n: int, cap: int) -> DataFrame:
    """Every ceil(n / cap)-th of n points, by a digest of the row: about cap of them."""
    key = F.conv(F.substring(F.md5(F.col("row").cast("string")), 1, 8), 16, 10).cast("bigint")
    return points.where(F.pmod(key, F.lit(max(1, -(-n // max(1, cap))))) == 0)


def partition_cap(prob: float, chunk: int = 100_000, most_samples: int = 0) -> int:
    """How many points a partition is fitted to."""
    return most_samples if most_samples > 0 else max(chunk, math.ceil(100 / max(prob, 2.3e-16)))


def estimate(points: DataFrame, sigma: float, dims: int = 1, prob: float = 1e-3, conv: float = 1e-2, most: int = 150, seed: int = 0, partition: Callable[[DataFrame, float], Callable[[DataFrame], Column]] | None = None, most_samples: int = 0, whole: bool = False) -> tuple[DataFrame, int]:
    """Centres, scores and divergences of points (row, y0 ..) smoothed by sigma, in cells of about prob,
    and the rounds of noise that it took until they moved by at most conv.

    Cells are halved while they hold 2 * prob of a sample with the first round's noise; whole takes all
    points for it, however many. partition fits cells of another kind: called with that sample and prob,
    it gives what names the cell of noisy points. No observations are an error."""
    n = points.count()
    if not n:
        raise ValueError("there are no observations")
    fitted = points if whole else on_stride(points, n, partition_cap(prob, most_samples=most_samples))
    sample = draw(fitted, F.lit(sigma), range(1, 2), seed, dims)
    cell = partition(sample, prob) if partition else mass_tree(sample, prob).of
    return converge(points, sigma, cell, seed, conv, most, dims)


def bisecting_cells(sample: DataFrame, prob: float, features: list[str], seed: int = 7):
    """A fitted model whose prediction is the cell: cells are halved while they hold 2 * prob of the sample."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import VectorAssembler

    tree = BisectingKMeans(k=max(2, int(4 / prob)), minDivisibleClusterSize=2 * prob, featuresCol="_v", predictionCol="cell", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_v"), tree]).fit(sample)
