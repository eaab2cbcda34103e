"""Histograms, kernel densities and relative entropies."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densityflow.operators.interpolate import interpolated
from densityflow.operators.transform import is_finite
from densityflow.sources.store import bounded, stored


#: Values of a part that are put in order without cutting it once more.
IN_ORDER = 100_000


def bin_of(x: Column, low: Column, width: Column, bins: Column) -> Column:
    return F.least(F.greatest(F.floor((x - low) / width), F.lit(0)), bins - 1).cast("int")


def histogram(values: DataFrame, bins: int | None = None) -> DataFrame:
    """values: (x). (bin, x, density, width), a row for each bin, empty ones included.

    Bins default to half the root of the count, 50 to 200. Only finite values count. Empty input gives
    no row; equal values give one row without a density."""
    values = values.where(is_finite(F.col("x")))
    stats = values.agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).where("n > 0")
    nb = F.lit(bins) if bins else F.least(F.greatest(F.bround(F.sqrt("n") / 2, 0), F.lit(50)), F.lit(200)).cast("int")
    stats = stats.withColumn("bins", F.when(F.col("high") > F.col("low"), nb).otherwise(F.lit(1))).withColumn("width", (F.col("high") - F.col("low")) / F.col("bins"))
    found = values.join(F.broadcast(stats))
    found = found.groupBy(F.when(F.col("width") > 0, bin_of(F.col("x"), F.col("low"), F.nullif("width", F.lit(0.0)), F.col("bins"))).otherwise(F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    grid = stats.select("*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    density = F.when(F.col("width") > 0, F.coalesce("c", F.lit(0)) / (F.col("n") * F.nullif("width", F.lit(0.0))))
    return grid.join(F.broadcast(found), "bin", "left").select("bin", (F.col("low") + (F.col("bin") + 0.5) * F.col("width")).alias("x"), density.alias("density"), "width")


def smooth(hist: DataFrame, bandwidth: float | None = None) -> DataFrame:
    """Gaussian smoothing over neighbouring bins, weights normalised; a thirtieth of the range by default."""
    span = hist.agg((F.max("bin") + 1).alias("bins"))
    h = hist.join(F.broadcast(span)).withColumn("bw", F.lit(bandwidth) if bandwidth else F.col("bins") * F.col("width") / 30.0)
    reach = F.ceil(3 * F.col("bw") / F.col("width")).cast("int")
    near = h.select(F.explode(F.sequence(F.greatest(F.col("bin") - reach, F.lit(0)), F.least(F.col("bin") + reach, F.col("bins") - 1))).alias("at"), "bin", "density", "width", "bw")
    d = (F.col("at") - F.col("bin")) * F.col("width") / F.col("bw")
    w = F.exp(-0.5 * d * d)
    out = near.groupBy(F.col("at").alias("bin")).agg((F.sum(w * F.col("density")) / F.sum(w)).alias("density"))
    return out.join(F.broadcast(hist.select("bin", "x", "width")), "bin").select("bin", "x", "density", "width")


def bivariate(pairs: DataFrame, bins: int | None = None, x_range: tuple[float, float] | None = None, y_range: tuple[float, float] | None = None) -> DataFrame:
    """pairs: (x, y). (yi, xi, density) of the bins that are hit, by finite pairs in range.

    Bins default to a quarter of the root of the count, 30 to 100; ranges to the extrema. If a range
    has no width, or no pair is in range, there is one bin of density 0."""
    ok = is_finite(F.col("x")) & is_finite(F.col("y"))
    pairs = pairs.where(ok)
    s = pairs.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    for c, given in (("x", x_range), ("y", y_range)):
        if given:
            s = s.withColumn(f"{c}0", F.lit(float(given[0]))).withColumn(f"{c}1", F.lit(float(given[1])))
    default = F.least(F.greatest(F.bround(F.sqrt("n") / 4, 0), F.lit(30)), F.lit(100)).cast("int")
    s = s.withColumn("bins", F.lit(bins) if bins else default)
    s = s.select("*", *[((F.col(f"{c}1") - F.col(f"{c}0")) / F.col("bins")).alias(f"{c}w") for c in "xy"])
    wide = s.where("xw > 0 AND yw > 0")
    placed = pairs.join(F.broadcast(wide)).where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    at = [bin_of(F.col(c), F.col(f"{c}0"), F.col(f"{c}w"), F.col("bins")).alias(k) for c, k in (("y", "yi"), ("x", "xi"))]
    hit = placed.groupBy(*at).agg(F.count(F.lit(1)).alias("c"), (F.first("xw") * F.first("yw")).alias("area"))
    total = hit.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("all"))
    found = hit.join(F.broadcast(total)).select("yi", "xi", (F.col("c") / (F.col("all") * F.col("area"))).alias("density"))
    none = total.where("all = 0").select(F.lit(0).alias("yi"), F.lit(0).alias("xi"), F.lit(0.0).alias("density"))
    return found.unionByName(none)


def averaged(long: DataFrame, bins: int, low: float, high: float, dims: int, normalize_by: str = "valid") -> DataFrame:
    """(bin, density): the mean over dims of each dimension's histogram of its values in range.

    Counts are divided by the dimension's values in range (valid) or by all its rows (all)."""
    w = (high - low) / bins
    hit = long.where(is_finite(F.col("x")) & F.col("x").between(low, high)).groupBy("dim", bin_of(F.col("x"), F.lit(low), F.lit(w), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    totals = hit.groupBy("dim").agg(F.sum("c").alias("n")) if normalize_by == "valid" else long.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    return hit.join(bounded(totals), "dim").groupBy("bin").agg((F.sum(F.col("c") / (F.col("n") * w)) / dims).alias("density"))


def circular_pairs(snapshots: DataFrame, distance: int) -> DataFrame:
    """(x, y) of each value and its neighbour so many places on, around the end, without a join."""
    n = F.size("x")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.col("x")[i].cast("double").alias("x"), F.col("x")[F.pmod(i + distance, n)].cast("double").alias("y")))
    return snapshots.select(F.explode(pairs).alias("p")).select("p.x", "p.y")


def quantiles(values: DataFrame, keys: list[str], shares: dict[str, float], parts: int = 4096, span: DataFrame | None = None) -> DataFrame:
    """(keys, a column for each share): exact quantiles, with linear interpolation, of finite x.

    No buffer holds a key's values: parts of the range are counted, the one that a rank falls into is
    cut into parts again if it holds many rows, and only what stands in that one is put in order, by
    distinct values. span: (keys, _n, _a, _b), numbers and ends of the values, if they are known."""
    on = keys or ["_one"]
    v = (values if keys else values.withColumn("_one", F.lit(1))).where(is_finite(F.col("x"))).select(*on, F.col("x").cast("double").alias("x"))
    if span is None:
        span = bounded(v.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min("x").alias("_a"), F.max("x").alias("_b")))
    part = lambda x, a, b: F.when(b > a, F.least(F.floor((x - a) / F.nullif(b - a, F.lit(0.0)) * parts), F.lit(parts - 1))).otherwise(F.lit(0)).cast("int")
    one = v.join(span, on).select(*on, "x", part(F.col("x"), F.col("_a"), F.col("_b")).alias("_p"))
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("_n") - 1) * F.lit(share)).alias("h")) for name, share in shares.items()])).alias("_s")
    want = span.select(*on, "_n", ranks).select(*on, F.col("_s.name").alias("_name"), F.col("_s.h").alias("_h"), F.explode(F.array(F.floor("_s.h"), F.least(F.ceil("_s.h"), F.col("_n") - 1))).alias("_rank")).distinct()

    def placed(counts: DataFrame, want: DataFrame, group: list[str], by: str) -> DataFrame:
        """want with the part that each rank falls into, and the rank inside it."""
        upto = F.sum("_c").over(Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
        c = counts.withColumn("_upto", upto)
        inside = (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c"))
        return want.join(c, group).where(inside).withColumn("_rank", F.col("_rank") - (F.col("_upto") - F.col("_c"))).drop("_upto", "_c")

    first = bounded(placed(one.groupBy(*on, "_p").agg(F.count(F.lit(1)).alias("_c"), F.count(F.lit(1)).alias("_size"), F.min("x").alias("_low"), F.max("x").alias("_high")), want, on, "_p"))
    edge = first.groupBy(*on, "_p").agg(F.first("_low").alias("_low"), F.first("_high").alias("_high"))
    if (first.agg(F.max("_size")).first()[0] or 0) <= IN_ORDER:
        rest = one.join(F.broadcast(edge), [*on, "_p"]).groupBy(*on, "_p", "x").agg(F.count(F.lit(1)).alias("_c"))
        third = placed(rest, first.drop("_low", "_high", "_size"), [*on, "_p"], "x")
    else:
        two = one.join(F.broadcast(edge), [*on, "_p"]).select(*on, "_p", "x", part(F.col("x"), F.col("_low"), F.col("_high")).alias("_q"))
        second = bounded(placed(two.groupBy(*on, "_p", "_q").agg(F.count(F.lit(1)).alias("_c")), first.drop("_low", "_high", "_size"), [*on, "_p"], "_q"))
        edge = second.select(*on, "_p", "_q").distinct()
        rest = two.join(F.broadcast(edge), [*on, "_p", "_q"]).groupBy(*on, "_p", "_q", "x").agg(F.count(F.lit(1)).alias("_c"))
        third = placed(rest, second, [*on, "_p", "_q"], "x")
    ends = third.groupBy(*on, "_name").agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.first("_h").alias("_h"))
    value = F.col("_x0") + (F.col("_h") - F.floor("_h")) * (F.col("_x1") - F.col("_x0"))
    return ends.groupBy(*on).agg(*[F.max(F.when(F.col("_name") == name, value)).alias(name) for name in shares]).select(*keys, *shares)


def robust_range(values: DataFrame, clip: float = 0.001) -> DataFrame:
    """(low, high): outer quantiles and a margin of 2 %; fallbacks for empty and constant input."""
    v = values.where(is_finite(F.col("x")))
    ends = v.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    q = ends.join(F.broadcast(quantiles(v, [], {"a": clip, "b": 1 - clip})), how="left")
    q = q.select(F.when(F.col("b") > F.col("a"), F.col("a")).otherwise(F.col("low")).alias("a"), F.when(F.col("b") > F.col("a"), F.col("b")).otherwise(F.col("high")).alias("b"))
    pad = F.when(F.col("b") > F.col("a"), 0.0).otherwise(F.greatest(F.abs("a"), F.lit(1.0)) * 1e-3 + 1e-6)
    q = q.select((F.col("a") - pad).alias("a"), (F.col("b") + pad).alias("b"))
    margin = (F.col("b") - F.col("a")) * 0.02
    return q.select(F.coalesce(F.col("a") - margin, F.lit(-1.0)).alias("low"), F.coalesce(F.col("b") + margin, F.lit(1.0)).alias("high"))


def symmetric_range(values: DataFrame, padding: float = 0.02) -> DataFrame:
    top = values.where(is_finite(F.col("x"))).agg((F.max(F.abs("x")) * (1 + padding)).alias("high"))
    return top.select((-F.col("high")).alias("low"), "high")


def joint_symmetric_range(sets: list[tuple[DataFrame, int]], padding: float = 0.02, most: int = 500_000) -> DataFrame:
    """One symmetric range for several sets (t, x) with their numbers of rows, each read at a stride by
    which the sets share most rows in order: a set gets what those before it have left."""
    parts, left = [], most
    for values, n in sets:
        if left <= 0 or n == 0:
            break
        stride = max(1, -(-n // left))
        parts.append(values.where(F.pmod("t", F.lit(stride)) == 0).select("x"))
        left -= -(-n // stride)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return symmetric_range(every, padding)


def silverman(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, h, low, high): bandwidth by Silverman's rule and the grid's ends, 4 h beyond the data."""
    s = bounded(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"), F.min("x").alias("a"), F.max("x").alias("b")))
    span = s.select(*keys, F.col("n").alias("_n"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    s = s.join(bounded(quantiles(values, keys, {"q1": 0.25, "q3": 0.75}, span=F.broadcast(span))), keys)
    iqr = F.col("q3") - F.col("q1")
    spread = F.when(iqr > 0, F.least("sd", iqr / 1.34)).otherwise(F.col("sd"))
    s = s.withColumn("h", 0.9 * spread * F.pow("n", F.lit(-0.2)))
    return s.select(*keys, "n", "h", (F.col("a") - 4 * F.col("h")).alias("low"), (F.col("b") + 4 * F.col("h")).alias("high"))


def kde(values: DataFrame, keys: list[str], points: int = 2048) -> DataFrame:
    """(keys, i, x, density): linear binning of finite values on a uniform grid, then Gaussian kernels of it.

    The grid's bins are at most points for each key, whatever the data's size; a key's are convolved with
    the kernel, cut at eight bandwidths, in one go. A key without a spread has no density."""
    values = stored(values.where(is_finite(F.col("x"))).select(*keys, F.col("x").cast("double").alias("x")))
    s = bounded(silverman(values, keys))
    step = (F.col("high") - F.col("low")) / (points - 1)
    v = values.join(s, keys).withColumn("step", step)
    pos = (F.col("x") - F.col("low")) / F.nullif("step", F.lit(0.0))
    left = F.least(F.floor(pos), F.lit(points - 2)).cast("int")
    v = v.withColumn("left", left).withColumn("part", pos - F.col("left"))
    # both ends of a value from one row of sums: w at the left, 1 - w at the right
    sums = v.groupBy(*keys, F.col("left").alias("i")).agg(F.sum(1 - F.col("part")).alias("w0"), F.sum("part").alias("w1"))
    sums = sums.join(s, keys)
    fields = dict(values.dtypes)
    kinds = "".join(f"`{k}` {fields[k]}, " for k in keys)

    def smoothed(rows: pd.DataFrame) -> pd.DataFrame:
        one = rows.iloc[0]
        n, h, low, high = (float(one[c]) for c in ("n", "h", "low", "high"))
        i = np.arange(points)
        step = (high - low) / (points - 1)
        if not h > 0:
            density = np.full(points, np.nan)
        else:
            w = np.zeros(points + 1)
            at = rows["i"].to_numpy(int)
            np.add.at(w, at, rows["w0"].to_numpy(float))
            np.add.at(w, at + 1, rows["w1"].to_numpy(float))
            reach = math.ceil(8 * h / step)
            d = np.arange(-reach, reach + 1) * step / h
            density = np.convolve(w[:points], np.exp(-0.5 * d * d) / (h * math.sqrt(2 * math.pi)))[reach : reach + points] / n
        return pd.DataFrame({**{k: pd.Series([one[k]] * points, dtype=rows[k].dtype) for k in keys}, "i": i, "x": low + i * step, "density": density})

    return sums.groupBy(*keys).applyInPandas(smoothed, f"{kinds}i int, x double, density double")


def relative_entropy(p: DataFrame, q: DataFrame, keys: list[str], points: int = 2048) -> DataFrame:
    """(keys, kl) of two tables (keys, x): densities on a common grid by arithmetic interpolation,
    renormalised and floored at 1e-10. Both tables must have the same columns: values are not compared
    with series of several dimensions. Both densities are worked out together; a key that only one table
    has gives no row."""
    if set(p.columns) != {*keys, "x"} or set(q.columns) != {*keys, "x"}:
        raise ValueError("both must have the same keys and x")
    sides = p.select(*keys, "x", F.lit(0).alias("_side")).unionByName(q.select(*keys, "x", F.lit(1).alias("_side")))
    both = kde(sides, [*keys, "_side"], points)
    both = both if keys else both.withColumn("_one", F.lit(1))
    keyed = keys or ["_one"]
    fields = dict(both.dtypes)

    def entropy(rows: pd.DataFrame) -> pd.DataFrame:
        """Of one key: two grids of so many points."""
        out = rows.iloc[:1][keyed].copy()
        one, two = (rows[rows["_side"] == k].sort_values("i") for k in (0, 1))
        if not len(one) or not len(two):
            return out.iloc[:0].assign(kl=pd.Series(dtype=float))
        a, b = min(one["x"].iloc[0], two["x"].iloc[0]), max(one["x"].iloc[-1], two["x"].iloc[-1])
        dx = (b - a) / (points - 1)
        at = a + np.arange(points) * dx
        d = [np.interp(at, k["x"], k["density"]) for k in (one, two)]
        if not dx > 0 or not all(np.isfinite(x).all() for x in d):
            return out.assign(kl=np.nan)
        f, g = (np.maximum(x / (x.sum() * dx), 1e-10) for x in d)
        return out.assign(kl=float((f * np.log(f / g)).sum() * dx))

    kinds = "".join(f"`{k}` {fields[k]}, " for k in keyed)
    return both.groupBy(*keyed).applyInPandas(entropy, f"{kinds}kl double").select(*keys, "kl")


def relative_entropy_of(p: DataFrame, q: DataFrame, keys: list[str], points: int = 2048) -> DataFrame:
    """(keys, kl) of two densities (keys, x, density) on any places: both are interpolated on a common
    uniform grid, beyond their ends by their first and last value, renormalised and floored at 1e-10."""
    keyed = keys or ["_one"]
    p, q = (d.select(*(keys or [F.lit(1).alias("_one")]), F.col("x").cast("double").alias("x"), F.col("density").alias("y")) for d in (p, q))
    ends = p.unionByName(q).where(is_finite(F.col("x"))).groupBy(*keyed).agg(F.min("x").alias("a"), F.max("x").alias("b"))
    grid = ends.withColumn("dx", (F.col("b") - F.col("a")) / (points - 1)).select(*keyed, "a", "dx", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    grid = grid.select(*keyed, "i", "dx", (F.col("a") + F.col("i") * F.col("dx")).alias("g"))
    both = stored(interpolated(q, interpolated(p, grid, keyed, to="p"), keyed, to="q"))
    sums = both.groupBy(*keyed).agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    d = both.join(bounded(sums), keyed)
    pn, qn = (F.greatest(F.col(c) / (F.col(f"s{c}") * F.col("dx")), F.lit(1e-10)) for c in "pq")
    return d.groupBy(*keyed).agg(F.sum(pn * F.ln(pn / qn) * F.col("dx")).alias("kl")).select(*keys, "kl")
