"""Ensembles of stochastic trajectories: each row of a table is one, so that Spark deals them out."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densityflow.functions.noise import hash_normal, noise_key


def fold(starts: DataFrame, drift: Callable[[Column], Column], diffusion: float, dt: float, steps: int, seed: int) -> DataFrame:
    """(traj, x) after so many Euler steps from starts (traj, x), with keyed noise, as one expression."""
    kick = lambda k: F.lit(diffusion * math.sqrt(dt)) * hash_normal(noise_key(seed, k, F.col("traj"), 0))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("x").cast("double"), lambda x, k: x + F.lit(dt) * drift(x) + kick(k))
    return starts.select("traj", end.alias("x"))


def evolve(starts: DataFrame, drift: Callable[[np.ndarray], np.ndarray], diffusion: float, dt: float, steps: int, resolution: int, boundary: tuple[float, float] | None, seed: int, dims: int = 1, wall: str = "clamp") -> DataFrame:
    """(traj, k, x): snapshots 0 .. steps / resolution of trajectories from starts (traj, x array).

    wall says what a step beyond the boundary does: clamp, reflect or reset (to the start)."""
    if wall not in ("clamp", "reflect", "reset"):
        raise ValueError(wall)
    if boundary and boundary[1] <= boundary[0]:
        raise ValueError("the boundary must not be empty")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), 1024):
                block = part.iloc[a : a + 1024]
                x = np.array(block["x"].tolist(), dtype=float).reshape(len(block), dims)
                start, rngs = x.copy(), [np.random.default_rng([seed, int(t) & 0x7FFFFFFFFFFFFFFF]) for t in block["traj"]]
                kept = [x.copy()]
                noise = np.stack([r.standard_normal((steps, dims)) for r in rngs]) if steps else None
                for k in range(1, steps + 1):
                    x = x + dt * drift(x) + diffusion * math.sqrt(dt) * noise[:, k - 1]
                    if boundary:
                        low, high = boundary
                        if wall == "clamp":
                            x = np.clip(x, low, high)
                        elif wall == "reflect":
                            x = np.abs((x - low + 2 * (high - low)) % (2 * (high - low)) - (high - low)) * -1 + high
                        else:
                            x = np.where((x < low) | (x > high), start, x)
                    if k % resolution == 0:
                        kept.append(x.copy())
                rows = np.stack(kept, axis=1)
                yield pd.DataFrame({"traj": np.repeat(block["traj"].to_numpy(), len(kept)), "k": np.tile(np.arange(len(kept)), len(block)), "x": list(rows.reshape(-1, dims))})

    return starts.select("traj", "x").mapInPandas(run, "traj long, k int, x array<double>")


def reduced_drift(x: Column, a: float, b: float, c: float, f: float) -> Column:
    return F.lit(f) + F.lit(a) * x + F.lit(b) * x * x - F.lit(c) * x * x * x


def reduced_score(x: Column, a: float, b: float, c: float, f: float, big_a: float, big_b: float, s: float) -> Column:
    """(2 drift - d/dx g^2) / g^2 with g^2 = (A - B x)^2 + s^2."""
    g2 = (F.lit(big_a) - F.lit(big_b) * x) * (F.lit(big_a) - F.lit(big_b) * x) + F.lit(s * s)
    slope = F.lit(-2 * big_b) * (F.lit(big_a) - F.lit(big_b) * x)
    return (2 * reduced_drift(x, a, b, c, f) - slope) / g2
