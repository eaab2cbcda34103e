"""Real Fourier coefficients of snapshots, packed as [Re c0, Re c1, Im c1, .., Re c(n/2)], and PCA.

Snapshots are transformed a batch at a time by fast Fourier transforms; covariances are summed as
products of batches where the rows are, and only a matrix of the dimensions meets. Leading axes come from
block Krylov iteration, which needs no such matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densityflow.sources.store import dropped, stored


def matrix_of(column: pa.Array) -> np.ndarray:
    """(rows, places) of an Arrow column of arrays of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def arrays_of(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def by_batch(snapshots: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(t, x): f of the matrix of each batch's snapshots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), arrays_of(f(matrix_of(b.column(1))))], names=["t", "x"])

    kind = dict(snapshots.dtypes)["t"]
    return snapshots.select("t", F.transform("x", lambda v: v.cast("double")).alias("x")).mapInArrow(run, f"t {kind}, x array<double>")


def pack(x: np.ndarray) -> np.ndarray:
    c = np.fft.rfft(x, axis=1)
    out = np.empty(x.shape)
    out[:, 0] = c[:, 0].real
    out[:, 1::2] = c[:, 1:].real
    out[:, 2::2] = c[:, 1:-1].imag
    return out


def unpack(x: np.ndarray) -> np.ndarray:
    c = np.zeros((len(x), x.shape[1] // 2 + 1), dtype=complex)
    c[:, 0] = x[:, 0]
    c[:, 1:] = x[:, 1::2]
    c[:, 1:-1] += 1j * x[:, 2::2]
    return np.fft.irfft(c, x.shape[1], axis=1)


def fourier_pack(snapshots: DataFrame, n: int) -> DataFrame:
    """n must be even, so that a packed vector has n values."""
    if n % 2:
        raise ValueError("an even number of dimensions is needed")
    return by_batch(snapshots, pack)


def fourier_unpack(packed: DataFrame, n: int) -> DataFrame:
    if n % 2:
        raise ValueError("an even number of dimensions is needed")
    return by_batch(packed, unpack)


def covariance(snapshots: DataFrame, stride: int = 1) -> DataFrame:
    """(i, j, mean_i, mean_j, c): covariances of all pairs of dimensions, of every stride-th time."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, None, None
        for b in batches:
            if b.num_rows:
                x = matrix_of(b.column(0))
                n, s, p = n + len(x), x.sum(axis=0) + (0 if s is None else s), x.T @ x + (0 if p is None else p)
        if n:
            d = len(s)
            i, j = np.repeat(np.arange(d, dtype=np.int32), d), np.tile(np.arange(d, dtype=np.int32), d)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(p.ravel()), pa.array(s[i]), pa.array(s[j]), pa.array(np.full(d * d, n, dtype=np.int64))], names=["i", "j", "p", "si", "sj", "n"])

    x = snapshots.where(F.pmod("t", F.lit(stride)) == 0).select(F.transform("x", lambda v: v.cast("double")).alias("x"))
    parts = x.mapInArrow(sums, "i int, j int, p double, si double, sj double, n long")
    s = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("p", "si", "sj", "n")])
    return s.select("i", "j", (F.col("si") / F.col("n")).alias("mean_i"), (F.col("sj") / F.col("n")).alias("mean_j"), ((F.col("p") - F.col("si") * F.col("sj") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))).alias("c"))


def principal_axes(snapshots: DataFrame, modes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, axes as rows, variances) of the largest modes; an axis's largest component is positive."""
    rows = covariance(snapshots).toPandas().sort_values(["i", "j"])  # a row for each pair of dimensions
    d = int(rows["i"].max()) + 1
    c, mean = rows["c"].to_numpy().reshape(d, d), rows["mean_j"].to_numpy()[:d]
    values, vectors = np.linalg.eigh(c)
    axes = vectors[:, ::-1][:, :modes].T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return mean, axes, values[::-1][:modes]


def _moments(snapshots: DataFrame) -> tuple[int, np.ndarray]:
    """(rows, means): a number for each dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, None
        for b in batches:
            if b.num_rows:
                x = matrix_of(b.column(0))
                n, s = n + len(x), x.sum(axis=0) + (0 if s is None else s)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s), pa.array(np.full(len(s), n, dtype=np.int64))], names=["i", "s", "n"])

    x = snapshots.select(F.transform("x", lambda v: v.cast("double")).alias("x"))
    rows = x.mapInArrow(sums, "i int, s double, n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toPandas().sort_values("i")
    n = int(rows["n"].iloc[0]) if len(rows) else 0
    return n, rows["s"].to_numpy() / n if n else np.empty(0)


def _applied(snapshots: DataFrame, mean: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For centred rows X and a basis Q of few columns: X'XQ, summed where the rows are, and R of the
    tall-skinny QR of XQ, from the R of each task's."""
    d, k = basis.shape
    shared = snapshots.sparkSession.sparkContext.broadcast((mean, basis))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, q = shared.value
        w, r = np.zeros((d, k)), np.empty((0, k))
        for b in batches:
            if b.num_rows:
                x = matrix_of(b.column(0)) - mean
                y = x @ q
                w += x.T @ y
                r = np.linalg.qr(np.concatenate([r, y]), mode="r")
        if len(r):
            square = np.zeros((k, k))
            square[: len(r)] = r
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + k, dtype=np.int64)), arrays_of(np.concatenate([w, square]))], names=["i", "row"])

    x = snapshots.select(F.transform("x", lambda v: v.cast("double")).alias("x"))
    rows = x.mapInArrow(parts, "i long, row array<double>")
    columns = [F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(k)]
    rows = stored(rows)
    w = rows.where(F.col("i") < d).groupBy("i").agg(*columns).toPandas().sort_values("i").drop(columns="i").to_numpy()
    factors = rows.where(F.col("i") >= d).select("row")

    def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.empty((0, k))
        for b in batches:
            if b.num_rows:
                r = np.linalg.qr(np.concatenate([r, matrix_of(b.column(0))]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([arrays_of(r)], names=["row"])

    merged = factors.coalesce(8).mapInArrow(stacked, "row array<double>").toArrow()  # at most 8 factors of k rows
    r = np.linalg.qr(np.array(merged["row"].to_pylist()), mode="r")
    dropped(rows)
    shared.unpersist()
    return w, r


def _outside(image: np.ndarray, basis: np.ndarray, least: float) -> np.ndarray:
    """An orthonormal basis of what the columns of image hold beside basis, as far as it is longer than least."""
    u, sizes, _ = np.linalg.svd(image - basis @ (basis.T @ image), full_matrices=False)
    u = u[:, sizes > least][:, : len(basis) - basis.shape[1]]
    return np.linalg.qr(u - basis @ (basis.T @ u))[0]


def _rest(image: np.ndarray, axes: np.ndarray, values: np.ndarray) -> float:
    """What is left of axes when the covariance is applied to them (image), beside their own directions."""
    return float(np.abs(image - axes * values).max())


def leading_axes(snapshots: DataFrame, modes: int, more: int = 16, most: int = 1000, tolerance: float = 1e-10, seed: int = 0, blocks: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, axes as rows, variances) of the largest modes, by block Krylov iteration on modes and some more
    columns: no matrix of all pairs of dimensions is made, and the driver holds dims times columns of so
    many blocks. An axis's largest component is positive.

    A round applies the covariance to one block. The next block is what that gave beside all blocks so
    far; after so many, the best directions in them are a new first block. In rounds on one block alone
    a flat spectrum does not settle. Axes that have not settled after about most rounds are an error."""
    n, mean = _moments(snapshots)
    if n < 2:
        raise ValueError("two snapshots at least are needed")
    k = min(modes + more, len(mean))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(mean), k)))[0]
    rounds = 0
    while True:
        w, r = _applied(snapshots, mean, q)
        rounds += 1
        _, sizes, turned = np.linalg.svd(r)  # of XQ: the variances inside the subspace, and its axes
        values, basis, image = sizes**2 / (n - 1), q @ turned.T, w @ turned.T / (n - 1)
        limit = tolerance * max(values[0], 1e-300)
        if k == len(mean) or _rest(image[:, :modes], basis[:, :modes], values[:modes]) <= limit:
            break
        axes, last = image, image  # one block alone is subspace iteration
        for _ in range(blocks - 1):
            new = _outside(last, basis, 1e-13 * values[0])
            if not new.shape[1]:
                break
            last = _applied(snapshots, mean, new)[0] / (n - 1)
            rounds += 1
            basis, image = np.concatenate([basis, new], axis=1), np.concatenate([image, last], axis=1)
            product = basis.T @ image
            inside, turned = np.linalg.eigh((product + product.T) / 2)
            axes, top = basis @ turned[:, ::-1], turned[:, ::-1][:, :modes]
            if _rest(image @ top, axes[:, :modes], inside[::-1][:modes]) <= limit / 2:
                break
        if rounds >= most:
            raise ArithmeticError(f"the axes have not settled after {most} rounds")
        q = np.linalg.qr(axes[:, :k])[0]
    axes = basis[:, :modes].T
    return mean, axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None], values[:modes]


def pca(snapshots: DataFrame, modes: int) -> DataFrame:
    """(t, x): centred snapshots projected on the first principal axes."""
    mean, axes, _ = leading_axes(snapshots, modes)
    return project(snapshots, axes, mean)


def project(snapshots: DataFrame, basis: np.ndarray, mean: np.ndarray | float = 0.0) -> DataFrame:
    """(t, x): the products of centred snapshots with the rows of basis."""
    return by_batch(snapshots, lambda x: (x - mean) @ basis.T)


def reconstruct(coordinates: DataFrame, basis: np.ndarray, fourier_mean: np.ndarray | float, mean_field: np.ndarray | float) -> DataFrame:
    """(t, x): fields from coordinates of packed Fourier coefficients in the rows of basis."""
    if basis.shape[1] % 2:
        raise ValueError("an even number of dimensions is needed")
    return by_batch(coordinates, lambda x: unpack(x @ basis + fourier_mean) + mean_field)


