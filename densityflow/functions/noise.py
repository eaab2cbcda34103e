"""Standard normal noise keyed by hashes: the same on every engine, run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _uniform(digest: Column, at: int) -> Column:
    return (F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def noise_key(seed: int | Column, round_: int | Column, row: Column, dim: int | Column) -> Column:
    parts = [p if isinstance(p, Column) else F.lit(p) for p in (seed, round_, row, dim)]
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def hash_uniform(key: Column) -> Column:
    """In (0, 1)."""
    return _uniform(F.md5(key), 1)


def hash_normal(key: Column) -> Column:
    """Box and Muller's transform of the two halves of a digest's first 64 bits."""
    digest = F.md5(key)
    return F.sqrt(F.lit(-2.0) * F.ln(_uniform(digest, 1))) * F.cos(F.lit(2.0) * F.pi() * _uniform(digest, 9))
