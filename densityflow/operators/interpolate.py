"""Linear interpolation between samples on any sorted places, as an as-of merge of two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densityflow.operators.transform import is_finite
from densityflow.sources.store import bounded, stored


def interpolated(samples: DataFrame, grid: DataFrame, keys: list[str], at: str = "g", to: str = "y") -> DataFrame:
    """grid with a column `to`: the samples (keys, x, y) at each row's place `at`, by straight lines between
    the samples around it, and by the first or last sample beyond them.

    Both tables are cut into common ranges of keys and places, however they lie; rows of one place are
    cut as well, so that no place is hot. In a range each row sees the last and the next sample, and
    across its edges those of the ranges around it: two samples a range and key meet. Samples of one
    place count as their mean, those without finite x and y don't count; a place that is null or not
    finite, and a key without samples, give null."""
    s = samples.where(is_finite(F.col("x")) & is_finite(F.col("y"))).groupBy(*keys, F.col("x").cast("double").alias("_x")).agg(F.avg("y").alias("_y"))
    row = F.struct(*[F.col(c) for c in grid.columns]).alias("_row")
    kind = f"struct<{','.join(f'`{c}`:{t}' for c, t in grid.dtypes)}>"
    both = s.select(*keys, "_x", "_y", F.lit(0).alias("_kind"), F.lit(None).cast(kind).alias("_row"))
    both = both.union(grid.select(*keys, F.col(at).cast("double").alias("_x"), F.lit(None).cast("double").alias("_y"), F.lit(1).alias("_kind"), row))
    both = both.withColumn("_salt", F.monotonically_increasing_id())
    ranged = stored(both.repartitionByRange(*keys, "_x", "_kind", "_salt").withColumn("_part", F.spark_partition_id()).drop("_salt"))
    sample = F.when(F.col("_kind") == 0, F.struct(F.col("_x").alias("x"), F.col("_y").alias("y")))
    ends = ranged.groupBy("_part", *keys).agg(F.min(sample).alias("_first"), F.max(sample).alias("_last"))
    # what follows is looked for backwards: a frame to the end is read anew for each row, one from the start is carried on
    order, back = (Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, -1) for c in (F.asc("_part"), F.desc("_part")))  # a row for each range
    before, after = F.last("_last", ignorenulls=True).over(order), F.last("_first", ignorenulls=True).over(back)
    edges = bounded(ends.select("_part", *keys, before.alias("_before"), after.alias("_after")))
    own, turned = (Window.partitionBy("_part", *keys).orderBy(f("_x"), f("_kind")).rowsBetween(Window.unboundedPreceding, 0) for f in (F.asc, F.desc))
    low, high = (F.last(sample, ignorenulls=True).over(w) for w in (own, turned))
    near = ranged.select("*", low.alias("_low"), high.alias("_high")).where("_kind = 1")
    same = [edges[c].eqNullSafe(near[c]) for c in keys]
    on = edges["_part"] == near["_part"]
    for c in same:
        on = on & c
    found = near.join(edges, on, "left").select("_row", "_x", F.coalesce("_low", "_before").alias("_a"), F.coalesce("_high", "_after").alias("_b"))
    a, b, x = F.col("_a"), F.col("_b"), F.col("_x")
    line = a.y + (x - a.x) / F.nullif(b.x - a.x, F.lit(0.0)) * (b.y - a.y)
    value = F.when(~is_finite(x), None).when(a.isNull(), b.y).when(b.isNull() | (a.x == x), a.y).otherwise(line)
    return found.select("_row.*", value.alias(to))
