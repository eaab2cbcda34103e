"""Small networks for E[z|x]: inference a batch at a time, training where the rows are.

A network is a list of (weights, bias) with an activation between layers. Training takes rows
(row, x array, z array, w), stored in shards by row. In each epoch every shard is read in an order of
its own (by digests of epoch and row) and takes Adam's steps over minibatches from the common state;
the shards' networks and moments are then averaged, weighted by rows. A row's noise, order and shard
follow from its key, so that results don't depend on how Spark cuts the table, and only one network's
numbers a shard meet. The state is carried on by whoever trains further.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densityflow.operators import kgmm
from densityflow.operators.spectral import by_batch, matrix_of
from densityflow.operators.transform import numbered
from densityflow.sources.store import dropped, stored

Network = list[tuple[np.ndarray, np.ndarray]]
Activation = tuple[Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray], np.ndarray]]


def _sigmoid(u: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-u))


#: Values and derivatives.
ACTIVATIONS: dict[str, Activation] = {
    "swish": (lambda u: u * _sigmoid(u), lambda u: _sigmoid(u) * (1 + u * (1 - _sigmoid(u)))),
    "tanh": (np.tanh, lambda u: 1 - np.tanh(u) ** 2),
    "relu": (lambda u: np.maximum(u, 0), lambda u: (u > 0).astype(float)),
    "identity": (lambda u: u, np.ones_like),
}


def build(sizes: list[int], seed: int = 0) -> Network:
    """Glorot's uniform start."""
    rng = np.random.default_rng(seed)
    out = []
    for a, b in zip(sizes, sizes[1:], strict=False):
        bound = np.sqrt(6.0 / (a + b))
        out.append((rng.uniform(-bound, bound, (b, a)), np.zeros(b)))
    return out


def forward(net: Network, x: np.ndarray, activation: str = "swish") -> tuple[np.ndarray, list]:
    """x: (rows, dims). The output, and each layer's input and sums."""
    f, _ = ACTIVATIONS[activation]
    kept = []
    for k, (w, b) in enumerate(net):
        u = x @ w.T + b
        kept.append((x, u))
        x = f(u) if k < len(net) - 1 else u
    return x, kept


def gradient(net: Network, x: np.ndarray, z: np.ndarray, w: np.ndarray, activation: str = "swish") -> tuple[float, list]:
    """Weighted squared error, summed, and its gradient."""
    _, slope = ACTIVATIONS[activation]
    y, kept = forward(net, x, activation)
    g = 2 * w[:, None] * (y - z)
    out = []
    for k in range(len(net) - 1, -1, -1):
        x_in, u = kept[k]
        if k < len(net) - 1:
            g = g * slope(u)
        out.append((g.T @ x_in, g.sum(axis=0)))
        g = g @ net[k][0]
    return float((w[:, None] * (y - z) ** 2).sum()), out[::-1]


def jacobians(net: Network, x: np.ndarray, activation: str = "swish") -> np.ndarray:
    """(rows, outputs, inputs)."""
    _, slope = ACTIVATIONS[activation]
    _, kept = forward(net, x, activation)
    j = np.broadcast_to(net[0][0], (len(x), *net[0][0].shape))
    for (w, _), (_, u) in zip(net[1:], kept, strict=False):
        j = np.einsum("om,rmi->roi", w, slope(u)[:, :, None] * j)
    return j


def divergences(net: Network, x: np.ndarray, activation: str = "swish") -> np.ndarray:
    return np.einsum("rii->r", jacobians(net, x, activation))


def push(net: Network, x: np.ndarray, v: np.ndarray, activation: str = "swish") -> np.ndarray:
    """Jacobian times v, row by row."""
    _, slope = ACTIVATIONS[activation]
    _, kept = forward(net, x, activation)
    for k, ((w, _), (_, u)) in enumerate(zip(net, kept, strict=True)):
        v = v @ w.T * (slope(u) if k < len(net) - 1 else 1.0)
    return v


class Adam:
    def __init__(self, net: Network, rate: float, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8):
        self.rate, self.step, self.betas, self.eps = rate, 0, betas, eps
        self.m = [[np.zeros_like(p) for p in layer] for layer in net]
        self.v = [[np.zeros_like(p) for p in layer] for layer in net]

    def update(self, net: Network, grads: list) -> Network:
        self.step += 1
        one, two = self.betas
        out = []
        for k, layer in enumerate(net):
            new = []
            for j, p in enumerate(layer):
                g = grads[k][j]
                self.m[k][j] = one * self.m[k][j] + (1 - one) * g
                self.v[k][j] = two * self.v[k][j] + (1 - two) * g * g
                new.append(p - self.rate * self.m[k][j] / (1 - one**self.step) / (np.sqrt(self.v[k][j] / (1 - two**self.step)) + self.eps))
            out.append(tuple(new))
        return out


class Descent(Adam):
    """Plain steps down the gradient; with momentum, along its decaying sum (in m)."""

    def __init__(self, net: Network, rate: float, momentum: float = 0.0):
        super().__init__(net, rate)
        self.momentum = momentum

    def update(self, net: Network, grads: list) -> Network:
        self.step += 1
        self.m = [[self.momentum * m + g for m, g in zip(ms, gs, strict=True)] for ms, gs in zip(self.m, grads, strict=True)]
        return [tuple(p - self.rate * m for p, m in zip(layer, ms, strict=True)) for layer, ms in zip(net, self.m, strict=True)]


def _flat(layers: list) -> np.ndarray:
    return np.concatenate([p.ravel() for layer in layers for p in layer])


def _shaped(flat: np.ndarray, like: Network) -> list:
    out, at = [], 0
    for layer in like:
        part = []
        for p in layer:
            part.append(flat[at : at + p.size].reshape(p.shape))
            at += p.size
        out.append(tuple(part))
    return out


@dataclass
class State:
    """A network and what Adam needs to go on."""

    net: Network
    adam: Adam
    activation: str = "swish"
    losses: list[float] = field(default_factory=list)
    checks: list[float] = field(default_factory=list)


def start(net: Network, rate: float = 1e-3, activation: str = "swish", optimizer: Callable[..., Adam] = Adam, **settings) -> State:
    """settings: those of the optimizer, such as betas and eps, or momentum."""
    return State(net, optimizer(net, rate, **settings), activation)


def _batches(batches: Iterator[pa.RecordBatch], size: int, tail: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, x, z, w) of at most size rows of one shard, of exactly so many without tail."""
    held: list[tuple] = []
    count = 0

    def whole(n: int):
        nonlocal held, count
        s, x, z, w = (np.concatenate([h[k] for h in held]) for k in range(4))
        held, count = [(s[n:], x[n:], z[n:], w[n:])], len(s) - n
        return int(s[0]), x[:n], z[:n], w[:n]

    for b in batches:
        shards = b.column(0).to_numpy()
        cuts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(shards) else []
        for i, j in zip(cuts, np.r_[cuts[1:], len(shards)], strict=False):
            if count and next(h for h in held if len(h[0]))[0][0] != shards[i]:
                last = whole(count)
                if tail:
                    yield last
            part = b.slice(int(i), int(j - i))
            held = [h for h in held if len(h[0])] + [(shards[i:j], matrix_of(part.column(1)), matrix_of(part.column(2)), part.column(3).to_numpy())]
            count += int(j - i)
            while count >= size:
                yield whole(size)
    if count and tail:
        yield whole(count)


def _epoch(state: State, batch: int, tail: bool = True):
    """Rows (at, value): a shard's numbers times its rows; the last three are its loss, weight and rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, net, adam, loss, weight, rows = None, None, None, 0.0, 0.0, 0

        def done():
            numbers = np.r_[_flat(net), _flat(adam.m), _flat(adam.v), float(adam.step)] * rows
            values = np.r_[numbers, loss, weight, float(rows)]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["at", "value"])

        for s, x, z, w in _batches(batches, batch, tail):
            if s != shard:
                if shard is not None:
                    yield done()
                shard, net, adam, loss, weight, rows = s, state.net, copy.deepcopy(state.adam), 0.0, 0.0, 0
            scale = max(float(w.sum()), 1e-300) * z.shape[1]
            here, g = gradient(net, x, z, w, state.activation)
            net = adam.update(net, [[p / scale for p in layer] for layer in g])
            loss, weight, rows = loss + here, weight + scale, rows + len(x)
        if shard is not None:
            yield done()

    return run


def sharded(rows: DataFrame, shards: int) -> DataFrame:
    """rows (row, x, z, w) with their shard by a digest of the row."""
    return rows.select("row", "x", "z", "w", F.pmod(F.xxhash64(F.col("row").cast("string")), F.lit(shards)).cast("int").alias("shard"))


#: Rows of a shard, if no number of shards is given.
SHARD_ROWS = 65_536


def _gradients(state: State):
    """(at, value): the gradient of a task's rows, its loss and its weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x, z, w = matrix_of(b.column(0)), matrix_of(b.column(1)), b.column(2).to_numpy()
                loss, g = gradient(state.net, x, z, w, state.activation)
                here = np.r_[_flat(g), loss, float(w.sum()) * z.shape[1]]
                total = here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "value"])

    return run


def _synchronous_epoch(state: State, rows: DataFrame, order: Column, batch: int, tail: bool) -> tuple[float, float]:
    """A step for each batch of rows in the order; the loss and weight of all batches before their steps."""
    placed = stored(numbered(rows.select("x", "z", F.col("w").cast("double").alias("w"), order.alias("_k")), ["_k"], "place"))
    n = placed.count()
    loss = weight = 0.0
    for first in range(0, n if tail else n - n % batch, batch):
        part = placed.where((F.col("place") >= first) & (F.col("place") < first + batch)).select("x", "z", "w")
        sums = part.mapInArrow(_gradients(state), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()  # one network's numbers
        v = sums.sort_values("at")["value"].to_numpy()
        scale = max(float(v[-1]), 1e-300)
        state.net = state.adam.update(state.net, _shaped(v[:-2] / scale, state.net))
        loss, weight = loss + v[-2], weight + scale
    dropped(placed)
    return loss, weight


def train(state: State, rows: Callable[[int], DataFrame] | DataFrame, epochs: int, batch: int = 8192, shards: int | None = None, seed: int = 0, check: DataFrame | None = None, synchronous: bool = False, tail: bool = True) -> State:
    """rows (row, x, z, w), or what gives them for an epoch (fresh noise), counted on from earlier ones.

    check: rows on which each epoch's network is judged. Without tail, rows that fill no whole batch are
    left out of an epoch."""
    state = State(state.net, copy.deepcopy(state.adam), state.activation, list(state.losses), list(state.checks))
    if shards is None and not synchronous:
        some = rows if isinstance(rows, DataFrame) else rows(len(state.losses) + 1)
        shards = max(1, -(-some.count() // SHARD_ROWS))
    fixed = None
    if isinstance(rows, DataFrame):
        fixed = stored(rows.select("row", "x", "z", "w") if synchronous else sharded(rows, shards).repartitionById(shards, F.col("shard")))
    for _ in range(epochs):
        epoch = len(state.losses) + 1
        order = F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch), F.col("row").cast("string")))
        if synchronous:
            loss, weight = _synchronous_epoch(state, rows(epoch) if fixed is None else fixed, order, batch, tail)
            if not weight:
                raise ValueError("no rows to train on")
        else:
            now = fixed if fixed is not None else sharded(rows(epoch), shards)
            now = now.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", order).select("shard", "x", "z", F.col("w").cast("double").alias("w"))
            sums = now.mapInArrow(_epoch(state, batch, tail), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()  # one network's numbers
            if not len(sums):
                raise ValueError("no rows to train on")
            v = sums.sort_values("at")["value"].to_numpy()
            loss, weight, n = v[-3:]
            size = len(_flat(state.net))
            net, m, s = (v[k * size : (k + 1) * size] / n for k in range(3))
            state.net = _shaped(net, state.net)
            state.adam.m, state.adam.v = ([list(layer) for layer in _shaped(x, state.net)] for x in (m, s))
            state.adam.step = round(v[3 * size] / n)
        state.losses.append(float(loss / weight))
        if check is not None:
            state.checks.append(full_loss(state, check))
    if fixed is not None:
        dropped(fixed)
    return state


def noisy_rows(points: DataFrame, sigma: float, dims: int, seed: int) -> Callable[[int], DataFrame]:
    """For points (row, y0 ..): each epoch's (row, x, z, w) with fresh noise."""

    def of(epoch: int) -> DataFrame:
        drawn = kgmm.draw(points, F.lit(sigma), range(epoch, epoch + 1), seed, dims)
        return drawn.select("row", F.array(*[f"x{j}" for j in range(dims)]).alias("x"), F.array(*[f"z{j}" for j in range(dims)]).alias("z"), F.lit(1.0).alias("w"))

    return of


def cell_rows(cells: DataFrame, dims: int) -> DataFrame:
    """Rows to train on from (center0 .., target0 .., weight), keyed by their centres."""
    x, z = (F.array(*[F.col(f"{k}{j}") for j in range(dims)]) for k in ("center", "target"))
    return cells.select(F.concat_ws(":", *[F.col(f"center{j}").cast("string") for j in range(dims)]).alias("row"), x.alias("x"), z.alias("z"), F.col("weight").cast("double").alias("w"))


def full_loss(state: State, rows: DataFrame, by_dim: bool = True) -> float:
    """Weighted mean squared error over all rows, in one pass; of all dimensions together without by_dim."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss = weight = 0.0
        for b in batches:
            if b.num_rows:
                x, z, w = matrix_of(b.column(0)), matrix_of(b.column(1)), b.column(2).to_numpy()
                y, _ = forward(state.net, x, state.activation)
                loss, weight = loss + float((w[:, None] * (y - z) ** 2).sum()), weight + float(w.sum()) * (z.shape[1] if by_dim else 1)
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([weight])], names=["loss", "weight"])

    rows = rows.select("x", "z", F.col("w").cast("double").alias("w"))
    s = rows.mapInArrow(run, "loss double, weight double").agg(F.sum("loss"), F.sum("weight")).first()
    return s[0] / s[1] if s[1] else float("nan")


def noise_loss(state: State, points: DataFrame, sigma: float, dims: int, samples: int, seed: int) -> float:
    """Mean squared error over so many fresh draws of noise."""
    drawn = kgmm.draw(points, F.lit(sigma), range(1, samples + 1), seed, dims)
    return full_loss(state, drawn.select(F.array(*[f"x{j}" for j in range(dims)]).alias("x"), F.array(*[f"z{j}" for j in range(dims)]).alias("z"), F.lit(1.0).alias("w")))


def scores(net: Network, snapshots: DataFrame, sigma: float, activation: str = "swish") -> DataFrame:
    """(t, x): the score at snapshots (t, x array)."""
    return by_batch(snapshots, lambda x: -forward(net, x, activation)[0] / sigma)


def jacobian(net: Network, snapshots: DataFrame, sigma: float, activation: str = "swish") -> DataFrame:
    """(t, x): the score's Jacobian, row by row."""
    return by_batch(snapshots, lambda x: -jacobians(net, x, activation).reshape(len(x), -1) / sigma)


def divergence(net: Network, snapshots: DataFrame, sigma: float, activation: str = "swish") -> DataFrame:
    """(t, divergence): the exact trace."""
    out = by_batch(snapshots, lambda x: -divergences(net, x, activation)[:, None] / sigma)
    return out.select("t", F.col("x")[0].alias("divergence"))


def probe(seed: int, k: int, t: Column, dims: int) -> Column:
    """An array of signs that follow from the seed, the probe, the row and the dimension."""
    sign = lambda j: F.when(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(k), t.cast("string"), j.cast("string"))), 1, 1) < "8", 1.0).otherwise(-1.0)
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), sign)


def probed_divergence(net: Network, snapshots: DataFrame, sigma: float, dims: int, probes: int = 1, seed: int = 0, activation: str = "swish", normal: Callable[[int, Column], Column] | None = None) -> DataFrame:
    """(t, divergence) by Hutchinson's estimator: the mean of v'Jv over probes v of signs, or of what
    normal(k, t) gives, an array for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix_of(b.column(1))
                total = np.zeros(len(x))
                for k in range(probes):
                    v = matrix_of(b.column(2 + k))
                    total += (v * push(net, x, v, activation)).sum(axis=1) / probes
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(-total / sigma)], names=["t", "divergence"])

    draw = normal or (lambda k, t: probe(seed, k, t, dims))
    drawn = snapshots.select("t", F.transform("x", lambda v: v.cast("double")).alias("x"), *[draw(k, F.col("t")).alias(f"v{k}") for k in range(probes)])
    return drawn.mapInArrow(run, f"t {dict(snapshots.dtypes)['t']}, divergence double")


@dataclass
class ScoreModel:
    """A trained network as functions of snapshots (t, x array)."""

    state: State
    sigma: float
    dims: int
    cells: DataFrame | None = None
    with_divergence: bool = True
    with_jacobian: bool = True
    probes: int = 0
    seed: int = 0

    def score(self, snapshots: DataFrame) -> DataFrame:
        return scores(self.state.net, snapshots, self.sigma, self.state.activation)

    def divergence(self, snapshots: DataFrame) -> DataFrame:
        """Exact, or by probes; zeros if the model was made without."""
        if not self.with_divergence:
            return snapshots.select("t", F.lit(0.0).alias("divergence"))
        if self.probes:
            return probed_divergence(self.state.net, snapshots, self.sigma, self.dims, self.probes, self.seed, self.state.activation)
        return divergence(self.state.net, snapshots, self.sigma, self.state.activation)

    def jacobian(self, snapshots: DataFrame) -> DataFrame:
        if not self.with_jacobian:
            return snapshots.select("t", F.array_repeat(F.lit(0.0), self.dims * self.dims).alias("x"))
        return jacobian(self.state.net, snapshots, self.sigma, self.state.activation)


def fit(points: DataFrame, dims: int, sigma: float = 0.1, hidden: tuple[int, ...] = (128, 128), epochs: int = 50, batch: int = 8192, rate: float = 1e-2, preprocessing: bool = False, state: State | None = None, shards: int | None = None, seed: int = 0, activation: str = "swish", divergence: bool = True, jacobian: bool = True, probes: int = 0, synchronous: bool = False, **kgmm_options) -> ScoreModel:
    """A score model of points (row, y0 ..): from fresh noise in each epoch, or, with preprocessing,
    from averages of noise in cells. A state goes on from where it was left."""
    state = state or start(build([dims, *hidden, dims], seed), rate, activation)
    cells = None
    if preprocessing:
        found, _ = kgmm.estimate(points, sigma, dims, seed=seed, **kgmm_options)
        cells = stored(kgmm.training_set(found, sigma, dims))
        state = train(state, cell_rows(cells, dims), epochs, batch, shards, seed, synchronous=synchronous)
    else:
        state = train(state, noisy_rows(points, sigma, dims, seed), epochs, batch, shards, seed, synchronous=synchronous)
    return ScoreModel(state, sigma, dims, cells, divergence, jacobian, probes, seed)


def weighted_linear(cells: DataFrame) -> DataFrame:
    """(slope, intercept, loss) of the weighted least squares line: a network without hidden layers."""
    w, x, z = F.col("weight"), F.col("center0"), F.col("target0")
    s = cells.agg(F.sum(w).alias("w"), F.sum(w * x).alias("x"), F.sum(w * z).alias("z"), F.sum(w * x * x).alias("xx"), F.sum(w * x * z).alias("xz"), F.sum(w * z * z).alias("zz"))
    c = lambda k: F.col(k)
    s = s.withColumn("slope", (c("w") * c("xz") - c("x") * c("z")) / (c("w") * c("xx") - c("x") * c("x")))
    s = s.withColumn("intercept", (c("z") - c("slope") * c("x")) / c("w"))
    loss = (c("zz") - 2 * c("slope") * c("xz") - 2 * c("intercept") * c("z") + c("slope") * c("slope") * c("xx") + 2 * c("slope") * c("intercept") * c("x") + c("intercept") * c("intercept") * c("w")) / c("w")
    return s.select("slope", "intercept", loss.alias("loss"))
