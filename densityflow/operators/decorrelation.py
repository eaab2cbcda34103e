"""Autocorrelations, decorrelation times and lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densityflow.operators.blocks import lag_sums
from densityflow.sources.store import bounded, stored


def autocorrelation(long: DataFrame, lags: int) -> DataFrame:
    """(dim, k, rho) of (t, dim, x) with t = 0 .. n - 1, for k = 0 .. lags: by blocks of time and Fourier
    transforms. Covariances are divided by n - k; without variance rho is null."""
    mean = bounded(long.groupBy("dim").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("sd")))
    # scaled by the deviation, so that what transforms round off is small beside one
    scale = F.when(F.col("sd") > 0, F.col("sd"))
    c = long.join(mean, "dim").select("dim", "t", ((F.col("x") - F.col("m")) / scale).alias("d"))
    sums = stored(lag_sums(c, lags))
    zero = bounded(sums.where("k = 0").select("dim", F.col("s").alias("s0")))
    every = mean.select("dim", "n", F.explode(F.sequence(F.lit(0), F.least(F.lit(lags), F.col("n") - 1).cast("int"))).alias("k"))
    found = every.join(sums.select("dim", F.col("k").cast("int").alias("k"), "s"), ["dim", "k"], "left").join(zero, "dim", "left")
    cov, first = F.coalesce("s", F.lit(0.0)) / (F.col("n") - F.col("k")), F.col("s0") / F.col("n")
    return found.select("dim", "k", F.when(first > 0, cov / F.nullif(first, F.lit(0.0))).alias("rho"))


def decorrelation_times(rho: DataFrame) -> DataFrame:
    """(dim, tau): 1 + 2 times the sum of rho before it first is not positive; 1 without variance."""
    first = rho.where("k > 0 AND (rho <= 0 OR rho IS NULL)").groupBy("dim").agg(F.min("k").alias("stop"))
    kept = rho.join(bounded(first), "dim", "left")
    use = (F.col("k") > 0) & (F.col("stop").isNull() | (F.col("k") < F.col("stop")))
    return kept.groupBy("dim").agg((1 + 2 * F.coalesce(F.sum(F.when(use, F.col("rho"))), F.lit(0.0))).alias("tau"))


def long_decorrelation_times(long: DataFrame, first_lags: int = 64) -> DataFrame:
    """As above with as many lags as it takes: they double until every dimension has its stop."""
    n = long.groupBy("dim").count().agg(F.max("count")).first()[0] or 0
    lags = min(first_lags, max(n - 1, 0))
    while True:
        rho = stored(autocorrelation(long, lags))
        stops = rho.groupBy("dim").agg(F.max(F.coalesce((F.col("k") > 0) & ((F.col("rho") <= 0) | F.col("rho").isNull()), F.lit(False))).alias("s"))
        if lags >= n - 1 or not stops.where("NOT s").limit(1).count():
            return decorrelation_times(rho)
        lags = min(2 * lags, n - 1)


def lag_means(snapshots: DataFrame, dims: int) -> DataFrame:
    """(lag, r) of snapshots (t, x array): the mean correlation of dimensions at each circular distance,
    over the pairs of which both vary. Products are summed inside a row, so that a snapshot gives a row
    for each distance and none for each pair."""
    long = snapshots.select(F.posexplode("x").alias("dim", "x"))
    stats = long.groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_samp(F.col("x").cast("double")).alias("s"))
    one = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("stats"))  # a row for each dimension
    varies = F.transform("stats", lambda p: F.coalesce(p["s"] > 0, F.lit(False)))
    z = F.transform(F.zip_with("x", "stats", lambda x, p: F.struct(x.cast("double").alias("x"), p.alias("p"))), lambda q: F.when(q["p"]["s"] > 0, (q["x"] - q["p"]["m"]) / q["p"]["s"]).otherwise(F.lit(0.0)))
    scaled = snapshots.join(F.broadcast(one)).select(z.alias("z"), varies.alias("v"))
    places = F.sequence(F.lit(0), F.lit(dims - 1))

    def summed(lag: Column) -> Column:
        return F.aggregate(places, F.lit(0.0), lambda a, i: a + F.col("z")[i] * F.col("z")[F.pmod(i + lag, F.lit(dims))])

    def pairs(lag: Column) -> Column:
        return F.size(F.filter(places, lambda i: F.col("v")[i] & F.col("v")[F.pmod(i + lag, F.lit(dims))]))

    rows = scaled.select(F.explode(F.transform(places, lambda lag: F.struct(lag.alias("lag"), summed(lag).alias("c"), pairs(lag).alias("n")))).alias("e")).select("e.*")
    sums = rows.groupBy("lag").agg(F.sum("c").alias("c"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    return sums.select("lag", (F.col("c") / F.nullif((F.col("rows") - 1) * F.col("n"), F.lit(0))).alias("r"))


def spatial_scale(snapshots: DataFrame, dims: int) -> DataFrame:
    """(scale): the first circular distance at which the mean correlation is not positive."""
    stop = lag_means(snapshots, dims).where("lag > 0 AND (r <= 0 OR r IS NULL)")
    return stop.agg(F.coalesce(F.min("lag"), F.lit(dims)).cast("int").alias("scale"))


def every_time(n: int, most: int = 4096) -> int:
    """The stride that leaves at least most of n snapshots (and less than twice as many) for a covariance."""
    return max(1, n // most)


def analysis(long: DataFrame, snapshots: DataFrame | None = None, first_lags: int = 64) -> DataFrame:
    """(dim, tau, n_effective): times of all dimensions, and n over the longest, at least 1.

    With snapshots, the dimensions are equivalent places on a circle, and there is one row (tau, n_effective,
    scale, n_space_time): their mean time, and with the spatial scale the count n / (tau * scale).
    No dimension gives no row (a circle: tau 0); fewer than two times have a tau of 1."""
    n = long.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))
    tau = stored(long_decorrelation_times(long, first_lags))
    if snapshots is None:
        longest = tau.agg(F.greatest(F.max("tau"), F.lit(1.0)).alias("longest"))
        return tau.join(F.broadcast(longest.join(n))).select("dim", "tau", (F.col("n") / F.col("longest")).alias("n_effective"))
    dims = snapshots.select(F.max(F.size("x"))).first()[0] or 0
    mean = tau.agg(F.coalesce(F.avg("tau"), F.lit(0.0)).alias("tau"), F.greatest(F.max("tau"), F.lit(1.0)).alias("longest"))
    one = mean.join(F.broadcast(n)).join(F.broadcast(spatial_scale(snapshots, dims)))
    return one.select("tau", (F.coalesce("n", F.lit(0)) / F.coalesce("longest", F.lit(1.0))).alias("n_effective"), "scale", (F.coalesce("n", F.lit(0)) / (F.greatest("tau", F.lit(1.0)) * F.greatest("scale", F.lit(1)))).alias("n_space_time"))
