"""Projections, filters and samples of observations.

Observations come in long form (t, dim, x) or as snapshots (t, x array). Statistics are one row for
each dimension; they are stored and broadcast if they are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densityflow.functions.noise import hash_uniform, noise_key
from densityflow.sources.store import bounded, stored

EPS = 2.220446049250313e-16


def to_long(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("t", F.posexplode("x").alias("dim", "x")).select("t", "dim", F.col("x").cast("double").alias("x"))


def to_snapshots(long: DataFrame) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return long.groupBy("t").agg(F.transform(pairs, lambda p: p["x"]).alias("x"))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def dim_stats(long: DataFrame) -> DataFrame:
    return long.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("low"), F.max("x").alias("high"), F.sum("x").alias("total"))


def scales(long: DataFrame, mode: str = "per_dim", zero_std: str = "eps") -> DataFrame:
    """(dim, mean, std) to normalise with; mode: per_dim, max (the largest deviation for all) or
    global; a deviation that is not positive becomes machine epsilon or one."""
    floor = F.lit(EPS if zero_std == "eps" else 1.0)
    positive = lambda c: F.when(c > 0, c).otherwise(floor)
    if mode == "global":
        one = long.agg(F.avg("x").alias("mean"), positive(F.stddev_samp("x")).alias("std"))
        return long.select("dim").distinct().join(F.broadcast(one))
    stats = dim_stats(long).select("dim", "mean", positive(F.col("std")).alias("std"))
    if mode == "max":
        top = stats.agg(F.max("std").alias("std"))
        return stats.select("dim", "mean").join(F.broadcast(top))
    if mode != "per_dim":
        raise ValueError(f"no mode {mode}")
    return stats


def normalize(long: DataFrame, by: DataFrame) -> DataFrame:
    return long.join(bounded(by), "dim").select("t", "dim", ((F.col("x") - F.col("mean")) / F.col("std")).alias("x"))


def unnormalize(long: DataFrame, by: DataFrame) -> DataFrame:
    return long.join(bounded(by), "dim").select("t", "dim", (F.col("x") * F.col("std") + F.col("mean")).alias("x"))


def add_mean_field(long: DataFrame, field: DataFrame) -> DataFrame:
    """field: (dim, mean), for the dimensions of long and no others."""
    differing = long.select("dim").distinct().join(field.select("dim", F.lit(1).alias("_in")), "dim", "full").where("_in IS NULL").limit(1).count()
    if differing or field.join(long.select("dim").distinct(), "dim", "left_anti").limit(1).count():
        raise ValueError("the field has other dimensions")
    return long.join(bounded(field.select("dim", "mean")), "dim").select("t", "dim", (F.col("x") + F.col("mean")).alias("x"))


def mode_stride(long: DataFrame, stride: int) -> DataFrame:
    return long.where(F.col("dim") % stride == 0).select("t", (F.col("dim") / stride).cast("int").alias("dim"), "x")


def reference_modes(long: DataFrame, total: int, latent: int) -> DataFrame:
    """latent of total dimensions, by a stride of their ratio rounded up, else evenly spaced."""
    stride = -(-total // latent)
    kept = [k * stride for k in range(latent) if k * stride < total]
    if len(kept) < latent:
        kept = sorted({round(k * (total - 1) / max(1, latent - 1)) for k in range(latent)})
    return long.where(F.col("dim").isin(kept))


def time_stride(df: DataFrame, stride: int, max_snapshots: int | None = None) -> DataFrame:
    kept = df.where(F.pmod("t", F.lit(stride)) == 0)
    return kept if max_snapshots is None else kept.where(F.col("t") <= stride * (max_snapshots - 1))


def head(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("t") < n)


def split_at(df: DataFrame, n: int, share: float = 0.8) -> DataFrame:
    """Marks the first share of n times as training."""
    return df.withColumn("train", F.col("t") < F.bround(F.lit(share * n), 0))


def strided(df: DataFrame, n: int, most: int, at: str = "t") -> DataFrame:
    """Every ceil(n / most)-th row."""
    return df.where(F.pmod(at, F.lit(max(1, -(-n // max(1, most))))) == 0)


def exact_subset(df: DataFrame, n: int, seed: int, row: str, width: int = 3) -> DataFrame:
    """n rows without replacement, the same each time: those of the smallest digests of their key.

    The n-th smallest digest is found by counting prefixes, a longer one in each pass (at most 16 ** width
    counts), and rows are filtered by it; none are sorted. Rows of the digest that is cut are numbered."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col(row).cast("string")))
    if n <= 0:
        return df.where(F.lit(False))
    prefix, need = "", n
    while len(prefix) < 32:
        inside = df.where(F.substring(key, 1, len(prefix)) == prefix) if prefix else df
        counts = inside.groupBy(F.substring(key, len(prefix) + 1, width).alias("next")).count().toPandas().sort_values("next")
        upto = counts["count"].cumsum()
        if not len(counts) or upto.iloc[-1] < need:  # fewer rows than asked for
            return df
        at = int(upto.searchsorted(need))
        prefix, need = prefix + counts["next"].iloc[at], need - int(upto.iloc[at] - counts["count"].iloc[at])
        if need == counts["count"].iloc[at]:
            return df.where(F.substring(key, 1, len(prefix)) <= prefix)
    equal = numbered(df.where(key == prefix), df.columns, "_place").where(F.col("_place") < need).drop("_place")
    return df.where(key < prefix).unionByName(equal)


def align(snapshots: DataFrame, target: int = 16) -> DataFrame:
    """Turns each snapshot so that its first maximum stands at target (from 1)."""
    n = F.size("x")
    shift = F.lit(target) - F.array_position("x", F.array_max("x")).cast("int")
    turned = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col("x")[F.pmod(i - shift, n)])
    return snapshots.select("t", turned.alias("x"))


def stack_circshifts(snapshots: DataFrame, copies: int, n: int) -> DataFrame:
    """Copies turned by 0 .. copies - 1 places, a copy's times after the last one's n."""
    if copies < 1:
        raise ValueError("copies must be positive")
    size = F.size("x")
    out = snapshots.select("t", "x", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    turned = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.col("x")[F.pmod(i - F.col("copy"), size)])
    return out.select((F.col("copy") * n + F.col("t")).alias("t"), turned.alias("x"))


def augment_circular(snapshots: DataFrame, factor: int, dims: int, n: int) -> DataFrame:
    """Copies turned the other way by multiples of dims / factor."""
    if factor <= 0 or factor > dims or dims % factor:
        raise ValueError("factor must divide the number of dimensions")
    step, size = dims // factor, F.size("x")
    out = snapshots.select("t", "x", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))).alias("copy"))
    turned = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.col("x")[F.pmod(i + F.col("copy") * step, size)])
    return out.select((F.col("copy") * n + F.col("t")).alias("t"), turned.alias("x"))


def circshift_mean_field(long: DataFrame, copies: int, dims: int) -> DataFrame:
    """(dim, mean) over all turned copies, from the sums of the dimensions alone."""
    sums = long.groupBy("dim").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    moved = sums.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda c: F.pmod(F.col("dim") + c, F.lit(dims)))).alias("dim"), "s", "n")
    return moved.groupBy("dim").agg((F.sum("s") / F.sum("n")).alias("mean"))


def burned_in(trajectories: DataFrame, burnin: int, resolution: int) -> DataFrame:
    """(traj, k, x) without the first min(S, ceil(burnin / resolution) + 1) snapshots of each."""
    return trajectories.where(F.col("k") >= -(-burnin // resolution) + 1)


def normalize_vector(x: Column, mean: Column, std: Column) -> Column:
    """Of arrays of one length."""
    return F.transform(F.arrays_zip(x.alias("x"), mean.alias("m"), std.alias("s")), lambda p: (p["x"] - p["m"]) / p["s"])


def unnormalize_vector(x: Column, mean: Column, std: Column) -> Column:
    return F.transform(F.arrays_zip(x.alias("x"), mean.alias("m"), std.alias("s")), lambda p: p["x"] * p["s"] + p["m"])


def scales_row(by: DataFrame) -> DataFrame:
    """(mean array, std array), one row from scales; a value for each dimension."""
    one = by.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("s"))
    return one.select(F.transform("s", lambda p: p["mean"]).alias("mean"), F.transform("s", lambda p: p["std"]).alias("std"))


def observable(long: DataFrame, k: int, dims: int) -> DataFrame:
    """(t, x) of one dimension, k being brought into 0 .. dims - 1."""
    return long.where(F.col("dim") == max(0, min(k, dims - 1))).select("t", "x")


def window_head(long: DataFrame, window: int, dt: float, stride: int = 1) -> DataFrame:
    """(time, dim, x) of the first times, on the axis of the series before it was strided."""
    return long.where(F.col("t") < window).select((F.col("t") * F.lit(dt * stride)).alias("time"), "dim", "x")


def for_kde(snapshots: DataFrame, n: int, dims: int, most: int) -> DataFrame:
    """(x): the values of every ceil(n / max(1, most / dims))-th of n snapshots."""
    return strided(snapshots, n, max(1, most // dims)).select(F.explode("x").alias("x")).select(F.col("x").cast("double").alias("x"))


def numbered(df: DataFrame, order: list[str], to: str) -> DataFrame:
    """df with the place of each row in the order, from 0 without gaps: ranges are sorted where they
    are, and only their counts meet."""
    part, place = "_part", "_place"
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(part, (F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))  # a row for each range
    return ranged.join(bounded(before), part).withColumn(to, F.coalesce("_before", F.lit(0)) + F.col(place)).drop(part, place, "_before")


def bootstrap(numbered_rows: DataFrame, n: int, at: str, train: int, check: int, seed: int) -> DataFrame:
    """Draws with replacement: (k, train, and the drawn row's columns), training draws first."""
    spark = numbered_rows.sparkSession
    u = hash_uniform(noise_key(seed, 0, F.col("k"), 9))
    draws = spark.range(train + check).select(F.col("id").alias("k"), (F.col("id") < train).alias("train")).withColumn("_pick", F.least(F.floor(u * n), F.lit(n - 1)))
    return draws.join(numbered_rows, F.col("_pick") == F.col(at)).drop("_pick")


def minibatches(df: DataFrame, key: str, epochs: int, size: int, seed: int) -> DataFrame:
    """df for each epoch in an order of its own, with its place and the batch of so many that it falls into."""
    out = None
    for epoch in range(1, epochs + 1):
        mixed = df.withColumn("_k", F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch), F.col(key).cast("string"))))
        placed = numbered(mixed, ["_k"], "place").drop("_k").withColumn("epoch", F.lit(epoch)).withColumn("batch", F.floor(F.col("place") / size).cast("int"))
        out = placed if out is None else out.unionByName(placed)
    return out


def circshift_modes(snapshots: DataFrame, stride: int, copies: int, dims: int, n: int) -> DataFrame:
    """(t, dim, x): copies turned by 0 .. copies - 1 places, less the mean of all copies, at every
    stride-th place. Places that are not kept are never made."""
    if stride <= 0:
        raise ValueError("the stride must be positive")
    copies = max(copies, 1)
    mean = circshift_mean_field(to_long(snapshots), copies, dims)
    out = snapshots.select("t", "x", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    kept = F.transform(F.sequence(F.lit(0), F.lit(dims - 1), F.lit(stride)), lambda i: F.struct(i.alias("place"), F.col("x")[F.pmod(i - F.col("copy"), F.lit(dims))].cast("double").alias("x")))
    rows = out.select((F.col("copy") * n + F.col("t")).alias("t"), F.explode(kept).alias("e")).select("t", "e.place", "e.x")
    rows = rows.join(bounded(mean.select(F.col("dim").alias("place"), "mean")), "place")
    return rows.select("t", (F.col("place") / stride).cast("int").alias("dim"), (F.col("x") - F.col("mean")).alias("x"))


def nearest_by_rank(points: DataFrame, places: list[float], k: int) -> DataFrame:
    """(place, z): the mean z over the k points (x, z) around each place in the order of x: k / 2 before
    the first that is not less, moved inwards at the ends. Only ranks within windows are joined."""
    n = points.count()
    if not n:
        raise ValueError("there are no points")
    ranked = numbered(points.select("x", "z"), ["x", "z"], "rank")
    grid = points.sparkSession.createDataFrame([(i, float(p)) for i, p in enumerate(places)], "i int, place double")
    below = [F.sum((F.col("x") < F.lit(float(p))).cast("long")).alias(f"b{i}") for i, p in enumerate(places)]
    counts = points.agg(*below)
    at = grid.join(F.broadcast(counts)).withColumn("below", F.get(F.array(*[f"b{i}" for i in range(len(places))]), F.col("i")))
    low = F.greatest(F.lit(0), F.col("below") - k // 2)
    high = F.least(F.lit(n - 1), low + k - 1)
    spans = at.select("place", F.greatest(F.lit(0), high - k + 1).alias("low"), high.alias("high"))
    ranks = spans.select("place", F.explode(F.sequence("low", "high")).alias("rank"))
    return ranks.join(ranked, "rank").groupBy("place").agg(F.avg("z").alias("z"))
