"""Sums over pairs of times at every lag, by blocks of time and Fourier transforms.

The sum over t of x(t) * x(t + k) for all lags k up to a bound: a series is cut into blocks; a block
meets the two blocks that lie m blocks on, whose product of padded spectra has the sums for lags from
m blocks to m + 1, and the sums of all blocks are added. A block is as long as the largest lag, up to
MOST_BLOCK, so that a row is copied twice, or once more for each MOST_BLOCK of lags, and never once
for each lag; a task holds three blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BLOCK, MOST_BLOCK = 1 << 12, 1 << 17


def block_length(lags: int) -> int:
    return min(max(1 << max(lags, 1).bit_length(), LEAST_BLOCK), MOST_BLOCK)


def lag_products(early: np.ndarray, late: np.ndarray, most: int) -> np.ndarray:
    """For k = 0 .. most, the sum over t of early[t] * late[t + k]; late is as long as early and most more."""
    size = 1 << (len(early) + len(late) - 1).bit_length()
    spectrum = np.conj(np.fft.rfft(early, size)) * np.fft.rfft(late, size)
    return np.fft.irfft(spectrum, size)[: most + 1]


def _pairs_of(length: int, lags: int):
    """The rows (dim, j, m, t, d) of one pair of places: (dim, k, s)."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        dim, j, m = (held[0].column(c)[0].as_py() for c in range(3))
        t = np.concatenate([b.column(3).to_numpy() for b in held])
        d = np.concatenate([b.column(4).to_numpy(zero_copy_only=False) for b in held])
        early, late = np.zeros(length), np.zeros(2 * length)
        own = t // length == j
        np.add.at(early, t[own] - j * length, d[own])
        at = t - (j + m) * length
        inside = (at >= 0) & (at < 2 * length)
        np.add.at(late, at[inside], d[inside])
        most = min(length - 1, lags - m * length)
        if early.any() and late.any():
            sums = lag_products(early, late, most)
            k = m * length + np.arange(most + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), dim, dtype=np.int32)), pa.array(k), pa.array(sums)], names=["dim", "k", "s"])

    return products


def lag_sums(values: DataFrame, lags: int) -> DataFrame:
    """(dim, k, s) of (dim, t, d): sums of products of values k apart, k = 0 .. lags. Null values count as
    absent; a lag without a product other than zero may be absent."""
    length = block_length(lags)
    whole = lags // length
    at = F.floor(F.col("t") / F.lit(length))
    # (block, distance) of the pairs that a row belongs to: as the early block, or as one of the two late ones
    places = [F.struct(at.alias("j"), F.lit(m).cast("long").alias("m")) for m in range(whole + 1)]
    places += [F.struct((at - m).alias("j"), F.lit(m).cast("long").alias("m")) for m in range(1, whole + 1)]
    places += [F.struct((at - m - 1).alias("j"), F.lit(m).cast("long").alias("m")) for m in range(whole + 1)]
    rows = values.where("d IS NOT NULL").select(F.col("dim").cast("int").alias("dim"), F.col("t").cast("long").alias("t"), F.col("d").cast("double").alias("d"), F.explode(F.array(*places)).alias("p"))
    rows = rows.select("dim", "p.j", "p.m", "t", "d").where("j >= 0")
    found = rows.groupBy("dim", "j", "m").applyInArrow(_pairs_of(length, lags), "dim int, k long, s double")
    return found.groupBy("dim", "k").agg(F.sum("s").alias("s"))
