"""The library's functions under names for SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

_UNIFORM = "((CAST(conv(substring(md5(key), {0}, 8), 16, 10) AS DOUBLE) + 0.5D) / 4294967296.0D)"
#: Scalar functions, each one expression that the optimizer sees through.
FUNCTIONS = {
    "swish(x DOUBLE) RETURNS DOUBLE": "x / (1.0D + exp(-x))",
    "swish_slope(x DOUBLE) RETURNS DOUBLE": "1.0D / (1.0D + exp(-x)) * (1.0D + x * (1.0D - 1.0D / (1.0D + exp(-x))))",
    "noise_key(seed STRING, round STRING, id STRING, dim STRING) RETURNS STRING": "concat_ws(':', seed, round, id, dim)",
    "hash_uniform(key STRING) RETURNS DOUBLE": _UNIFORM.format(1),
    "hash_normal(key STRING) RETURNS DOUBLE": f"sqrt(-2.0D * ln({_UNIFORM.format(1)})) * cos(2.0D * pi() * {_UNIFORM.format(9)})",
    "grid_cell(x DOUBLE, low DOUBLE, width DOUBLE, cells INT) RETURNS INT": "CAST(least(greatest(floor((x - low) / width), 0), cells - 1) AS INT)",
}


def register(spark: SparkSession) -> list[str]:
    """Makes the scalar functions known to the session."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]


def register_scores(spark: SparkSession, points: str, name: str = "score_cells") -> str:
    """A table function over a view of points (row, y0): the scores and divergences of its cells.

    name(sigma, rounds, seed, low, width, cells) gives (cell, n, center0, score0, divergence)."""
    register(spark)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(sigma DOUBLE, rounds INT, seed INT, low DOUBLE, width DOUBLE, cells INT)
RETURNS TABLE (cell INT, n BIGINT, center0 DOUBLE, score0 DOUBLE, divergence DOUBLE) RETURN
SELECT cell, n, sx / n, -(sz / n) / sigma, (szz / n - 1) / (sigma * sigma) - (sz / n / sigma) * (sz / n / sigma) FROM (
  SELECT cell, count(*) AS n, sum(x) AS sx, sum(z) AS sz, sum(z * z) AS szz FROM (
    SELECT z, x, grid_cell(x, low, width, cells) AS cell FROM (
      SELECT z, y0 + sigma * z AS x FROM (
        SELECT y0, hash_normal(noise_key(CAST(seed AS STRING), CAST(round AS STRING), CAST(row AS STRING), '1')) AS z
        FROM (SELECT row, y0, explode(sequence(1, rounds)) AS round FROM {points})))) GROUP BY cell)""")
    return name
