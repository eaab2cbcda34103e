"""Cells of state space from binary trees, kept as flat arrays and applied to whole batches.

A node has a direction and a limit: points whose product with the direction is beyond the limit go
right. The tree reaches the tasks as one broadcast of at most MOST_BYTES (its size follows from the
smallest share of a cell, not from the data), and a batch goes down it a level at a time.

mass_tree halves a cell while it holds 2 * prob of the sample, by 2-means: from the mean of its widest
dimension, so many rounds of centres and nearest sides. All open cells of a level are split together,
by aggregations whose results are a row for each cell and dimension; a cell that has become small
enough for one task is finished there, by the same rule, with all its descendants.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from densityflow.operators.spectral import matrix_of
from densityflow.sources.store import dropped, stored

MOST_BYTES = 256 << 20
#: Rows of a cell that one task finishes.
LOCAL_ROWS = 50_000
PASSES = 2


@dataclass
class Cells:
    """right child = left child + 1; leaves have no left child (-1) and the number of their cell."""

    normal: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    cell: np.ndarray

    def __len__(self) -> int:
        return int((self.left < 0).sum())

    @property
    def depth(self) -> int:
        deep = np.zeros(len(self.left), dtype=np.int64)
        for k in np.flatnonzero(self.left >= 0):  # children come after their parent
            deep[self.left[k]] = deep[self.left[k] + 1] = deep[k] + 1
        return int(deep.max())

    def node(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x."""
        at = np.zeros(len(x), dtype=np.int64)
        going = np.arange(len(x)) if len(self.left) and self.left[0] >= 0 else np.empty(0, np.int64)
        while len(going):
            here = at[going]
            beyond = np.einsum("rd,rd->r", x[going], self.normal[here]) > self.limit[here]
            at[going] = self.left[here] + beyond
            going = going[self.left[at[going]] >= 0]
        return at

    def of(self, points: DataFrame) -> Column:
        """The cell of points (x0 ..), by batches."""
        dims = self.normal.shape[1]
        shared = points.sparkSession.sparkContext.broadcast((self.normal, self.limit, self.left, self.cell))

        def place(*columns: pa.Array) -> pa.Array:
            tree = Cells(*shared.value)
            x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns])
            return pa.array(tree.cell[tree.node(x)], pa.int32())

        return F.arrow_udf(place, "int")(*[points[f"x{j}"] for j in range(dims)])


def in_order(left: np.ndarray) -> np.ndarray:
    """For each node, the number of its leaf from left to right; -1 inside."""
    out, stack, count = np.full(len(left), -1, dtype=np.int32), [0], 0
    while stack:
        k = stack.pop()
        if left[k] < 0:
            out[k] = count
            count += 1
        else:
            stack += [int(left[k]) + 1, int(left[k])]
    return out


def _widest(n: float, sums: np.ndarray, squares: np.ndarray) -> tuple[int, float] | None:
    """The dimension of the largest variance, and its mean."""
    mean = sums / n
    var = squares / n - mean * mean
    k = int(np.argmax(var))
    return (k, float(mean[k])) if var[k] > 1e-14 * max(1.0, float(mean[k] * mean[k])) else None


def _between(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, float]:
    """What is nearer to high than to low."""
    return high - low, float((high @ high - low @ low) / 2)


def halves(x: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, float, np.ndarray] | None:
    """A cell's direction, limit, and which rows are beyond; None if its rows are all alike."""
    first = _widest(len(x), x.sum(axis=0), (x * x).sum(axis=0))
    if first is None:
        return None
    beyond = x[:, first[0]] > first[1]
    w = b = None
    for _ in range(passes):
        if beyond.all() or not beyond.any():
            return None
        w, b = _between(x[~beyond].mean(axis=0), x[beyond].mean(axis=0))
        beyond = x @ w > b
    return None if beyond.all() or not beyond.any() else (w, b, beyond)


def grown(x: np.ndarray, least: float, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(normal, limit, left) of the tree of x, the root first."""
    normal, limit, left = [np.zeros(x.shape[1])], [0.0], [-1]
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop(0)
        split = halves(x[rows], passes) if len(rows) >= max(least, 2) else None
        if split is None:
            continue
        normal[node], limit[node], left[node] = split[0], split[1], len(left)
        for beyond in (~split[2], split[2]):
            todo.append((len(left), rows[beyond]))
            normal.append(np.zeros(x.shape[1]))
            limit.append(0.0)
            left.append(-1)
    return np.array(normal), np.array(limit), np.array(left, dtype=np.int64)


class _Growing:
    """The tree so far, on the driver: its size is that of the model."""

    def __init__(self, dims: int):
        self.normal, self.limit, self.left = [np.zeros(dims)], [0.0], [-1]

    def split(self, node: int, w: np.ndarray, b: float) -> tuple[int, int]:
        self.normal[node], self.limit[node], self.left[node] = w, b, len(self.left)
        for _ in range(2):
            self.normal.append(np.zeros_like(w))
            self.limit.append(0.0)
            self.left.append(-1)
        return self.left[node], self.left[node] + 1

    def cells(self) -> Cells:
        left = np.array(self.left, dtype=np.int64)
        tree = Cells(np.array(self.normal), np.array(self.limit), left, in_order(left))
        if tree.normal.nbytes > MOST_BYTES:
            raise ValueError(f"a tree of {len(tree)} cells in {tree.normal.shape[1]} dimensions is too large to broadcast: choose a larger prob")
        return tree


def _sums(spark: SparkSession, rows: DataFrame, tree: Cells, open_nodes: np.ndarray, planes: dict[int, tuple[np.ndarray, float]] | None) -> dict[tuple[int, int], tuple[float, np.ndarray, np.ndarray]]:
    """For each open node, and each side of its plane: rows, sums and sums of squares."""
    nodes = len(tree.left)
    slot = np.full(nodes, -1, dtype=np.int64)
    slot[open_nodes] = np.arange(len(open_nodes))
    w, b = np.zeros((len(open_nodes), tree.normal.shape[1])), np.full(len(open_nodes), np.inf)
    for k, node in enumerate(open_nodes.tolist()):
        if planes:
            w[k], b[k] = planes[node]
    shared = spark.sparkContext.broadcast((tree, slot, w, b))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, slot, w, b = shared.value
        total = np.zeros((2 * len(w), 2 * w.shape[1] + 1))
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column(0))
                at = slot[tree.node(x)]
                x, at = x[at >= 0], at[at >= 0]
                key = 2 * at + (np.einsum("rd,rd->r", x, w[at]) > b[at])
                order = np.argsort(key, kind="stable")
                key, x = key[order], x[order]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
                if len(first):
                    both = np.column_stack([np.ones(len(x)), x, x * x])
                    total[key[first]] += np.add.reduceat(both, first, axis=0)
        for k in np.flatnonzero(total[:, 0]):
            yield pa.RecordBatch.from_arrays([pa.array([int(k)] * total.shape[1], pa.int64()), pa.array(np.arange(total.shape[1])), pa.array(total[k])], names=["key", "at", "value"])

    got = rows.mapInArrow(add, "key long, at long, value double").groupBy("key", "at").agg(F.sum("value").alias("value")).toPandas()
    shared.unpersist()
    found: dict[tuple[int, int], tuple[float, np.ndarray, np.ndarray]] = {}
    dims = tree.normal.shape[1]
    for key, part in got.sort_values(["key", "at"]).groupby("key"):
        v = part["value"].to_numpy()
        found[int(open_nodes[key // 2]), int(key % 2)] = v[0], v[1 : dims + 1], v[dims + 1 :]
    return found


def mass_tree(sample: DataFrame, prob: float, passes: int = PASSES, local_rows: int = LOCAL_ROWS) -> Cells:
    """Cells of points (x0 ..), halved while they hold 2 * prob of the sample."""
    spark = sample.sparkSession
    dims = len([c for c in sample.columns if c[:1] == "x" and c[1:].isdigit()])
    rows = stored(sample.select(F.array(*[F.col(f"x{j}").cast("double") for j in range(dims)]).alias("x")))
    n = rows.count()
    least = 2 * prob * n
    tree, sizes, parents = _Growing(dims), {0: n}, {}
    while wide := [k for k, m in sizes.items() if m > local_rows and m >= max(least, 2)]:
        now, open_nodes = tree.cells(), np.array(wide)
        axes = {}
        for (node, _), (m, sums, squares) in _sums(spark, rows, now, open_nodes, None).items():
            if (top := _widest(m, sums, squares)) is not None:
                axes[node] = np.eye(dims)[top[0]], top[1]
        planes, split = axes, {}
        for _ in range(passes):
            open_nodes = np.array(sorted(planes))
            if not len(open_nodes):
                break
            sides = _sums(spark, rows, now, open_nodes, planes)
            centres = {k: [sides.get((k, s)) for s in (0, 1)] for k in planes}
            planes = {k: _between(low[1] / low[0], high[1] / high[0]) for k, (low, high) in centres.items() if low and high}
        counts = _sums(spark, rows, now, np.array(sorted(planes)), planes) if planes else {}
        for k in wide:
            split[k] = k in planes and (k, 0) in counts and (k, 1) in counts
            if split[k]:
                for side, child in enumerate(tree.split(k, *planes[k])):
                    sizes[child], parents[child] = counts[k, side][0], k
            del sizes[k]
    small = [k for k, m in sizes.items() if m >= max(least, 2)]
    if small:
        _finish(spark, rows, tree, small, least, passes)
    dropped(rows)
    return tree.cells()


def _finish(spark: SparkSession, rows: DataFrame, tree: _Growing, small: list[int], least: float, passes: int) -> None:
    """The descendants of small cells, each cell's in one task."""
    shared = spark.sparkContext.broadcast(tree.cells())

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.node(matrix_of(batch.column(0)))), batch.column(0)], names=["node", "x"])

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["x"].to_numpy())
        x = x[np.lexsort(x.T[::-1])]  # sums don't depend on how rows arrive
        normal, limit, left = grown(x, least, passes)
        return pd.DataFrame({"node": rows["node"].iloc[0], "at": np.arange(len(left)), "left": left, "plane": [np.r_[b, w] for b, w in zip(limit, normal, strict=True)]})

    tagged = rows.mapInArrow(tag, "node long, x array<double>").where(F.col("node").isin(small))
    found = tagged.groupBy("node").applyInPandas(grow, "node long, at long, left long, plane array<double>").toPandas()
    shared.unpersist()
    for node, part in found.sort_values(["node", "at"]).groupby("node"):
        place = {0: int(node)}
        for at, left, plane in zip(part["at"], part["left"], part["plane"], strict=True):
            if left >= 0:
                place[left], place[left + 1] = tree.split(place[at], np.asarray(plane[1:]), float(plane[0]))


class MeanSplits:
    """Cells by repeated halving to a fixed depth: a cell of level l is split at its mean of dimension l mod dims.

    Nodes are numbered as in a heap and their means stand in one array. Means are of a stored sample, a
    pass over it for each level."""

    def __init__(self, sample: DataFrame, depth: int, dims: int = 1):
        self.depth, self.dims, self.means = depth, dims, np.full(2**depth - 1, np.nan)
        sample = stored(sample.select(*[f"x{j}" for j in range(dims)]))
        for level in range(depth):
            at = sample.select(self._node(sample, level).alias("node"), F.col(f"x{level % dims}").alias("x"))
            found = at.groupBy("node").agg(F.avg("x").alias("m")).toArrow()  # a row for each cell
            self.means[found["node"].to_numpy()] = found["m"].to_numpy()
        dropped(sample)

    def _node(self, points: DataFrame, levels: int) -> Column:
        if not levels:
            return F.lit(0)
        shared, dims = points.sparkSession.sparkContext.broadcast(self.means[: 2**levels - 1]), self.dims

        def place(*columns: pa.Array) -> pa.Array:
            x = [c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]
            node = np.zeros(len(x[0]), dtype=np.int64)
            for level in range(levels):
                node = 2 * node + 1 + (x[level % dims] > shared.value[node])
            return pa.array(node, pa.int32())

        return F.arrow_udf(place, "int")(*[points[f"x{j}"] for j in range(dims)])

    def cell(self, points: DataFrame) -> Column:
        return self._node(points, self.depth) - F.lit(2**self.depth - 1)


def mean_splits(sample: DataFrame, prob: float):
    """Cells of about a share of prob, to one depth."""
    dims = len([c for c in sample.columns if c[:1] == "x" and c[1:].isdigit()])
    return MeanSplits(sample, max(0, math.ceil(math.log2(1 / prob))), dims).cell
