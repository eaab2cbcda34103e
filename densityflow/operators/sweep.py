"""Networks of many settings trained side by side, as one job.

A setting is a share of a cell, a smoothing and numbers of epochs. Noise is drawn once a round for all
settings; one aggregation gives the cells of all, keyed by setting; and a group for each share and
smoothing, which holds no more than its cells, is trained in a task, on to the largest number of epochs,
and judged at each. Nothing loops on the driver.

A network is judged by the loss on its cells and by how far the density that its score implies (the
exponential of the score's integral along the axis, renormalised) is from the observed histogram. Points
have one dimension.
"""

from __future__ import annotations

import math
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densityflow.functions.noise import hash_normal, noise_key
from densityflow.operators import mlp
from densityflow.operators.density import bin_of

RESULT = "prob double, sigma double, epochs int, cells int, loss double, kl double, seconds double"


def implied_density(net: mlp.Network, sigma: float, places: np.ndarray, activation: str = "swish") -> np.ndarray:
    """At evenly spaced places."""
    score = -mlp.forward(net, places[:, None], activation)[0][:, 0] / sigma
    step = places[1] - places[0] if len(places) > 1 else 1.0
    log = np.r_[0.0, np.cumsum((score[1:] + score[:-1]) / 2) * step]
    p = np.exp(log - log.max())
    return p / (p.sum() * step)


def divergence_from(observed: np.ndarray, implied: np.ndarray, step: float) -> float:
    p, q = np.maximum(observed, 1e-10), np.maximum(implied, 1e-10)
    return float((p * np.log(p / q)).sum() * step)


def sweep(points: DataFrame, settings: list[tuple[float, float, int]], net: mlp.Network, rounds: int = 2, batch: int = 64, rate: float = 1e-2, bins: int = 64, seed: int = 0, optimizer=mlp.Adam, activation: str = "swish") -> DataFrame:
    """settings: (prob, sigma, epochs); points: (row, y0). A row for each setting: the cells that were hit, the
    loss, the relative entropy, and the seconds of training until then."""
    for prob, sigma, epochs in settings:
        if not 0 < prob <= 1 or sigma <= 0 or epochs < 0:
            raise ValueError(f"no such setting: {(prob, sigma, epochs)}")
    ends = points.agg(F.min("y0").alias("low"), F.max("y0").alias("high"), F.count("y0").alias("n")).where("n > 0 AND high > low")
    seen = points.join(F.broadcast(ends)).groupBy("low", "high", "n", bin_of(F.col("y0"), F.col("low"), (F.col("high") - F.col("low")) / bins, F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    seen = seen.groupBy("low", "high", "n").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("hits"))  # one row, a number for each bin
    pairs = sorted({(p, s) for p, s, _ in settings})
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("prob"), F.lit(s).alias("sigma"), F.lit(math.ceil(1 / p)).alias("parts")) for p, s in pairs])).alias("s")
    drawn = points.select("row", "y0", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    drawn = drawn.select("y0", hash_normal(noise_key(seed, F.col("round"), F.col("row"), 1)).alias("z"), each).select("y0", "z", "s.*")
    drawn = drawn.join(F.broadcast(ends)).withColumn("x", F.col("y0") + F.col("sigma") * F.col("z"))
    cell = bin_of(F.col("x"), F.col("low"), (F.col("high") - F.col("low")) / F.col("parts"), F.col("parts"))
    cells = drawn.groupBy("prob", "sigma", cell.alias("cell")).agg(F.count(F.lit(1)).alias("w"), F.avg("x").alias("x"), F.avg("z").alias("z"))
    cells = cells.join(F.broadcast(seen))
    wanted = {(p, s): sorted({e for a, b, e in settings if (a, b) == (p, s)}) for p, s in pairs}

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cell")
        prob, sigma, low, high, n = (rows[c].iloc[0] for c in ("prob", "sigma", "low", "high", "n"))
        x, z, w = (rows[c].to_numpy(float) for c in "xzw")
        x, z = x[:, None], z[:, None]
        width = (high - low) / bins
        places = low + (np.arange(bins) + 0.5) * width
        hits = dict(rows["hits"].iloc[0])
        observed = np.array([hits.get(k, 0) for k in range(bins)]) / (n * width)
        now, steps, done, began, out = net, optimizer(net, rate), 0, time.perf_counter(), []
        for epochs in wanted[prob, sigma]:
            while done < epochs:
                done += 1
                order = np.random.default_rng([seed, done]).permutation(len(x))
                for k in range(0, len(x), batch):
                    part = order[k : k + batch]
                    _, g = mlp.gradient(now, x[part], z[part], w[part], activation)
                    now = steps.update(now, [[q / w[part].sum() for q in layer] for layer in g])
            seconds = time.perf_counter() - began
            loss = mlp.gradient(now, x, z, w, activation)[0] / w.sum()
            kl = divergence_from(observed, implied_density(now, sigma, places, activation), width)
            out.append((prob, sigma, epochs, len(x), loss, kl, seconds))
        return pd.DataFrame(out, columns=["prob", "sigma", "epochs", "cells", "loss", "kl", "seconds"])

    return cells.groupBy("prob", "sigma").applyInPandas(train, RESULT)
