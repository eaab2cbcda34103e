"""Operator 7: quality classifier, logistic regression over hashed word n-grams.

Features of a text are hashed: its words and word pairs, and the n-grams (to three) of word shapes,
that is which kinds of characters a word has and whether it repeats the word before. Each family
has values log(1 + count), scaled to length 1. Weights are learned by FTRL-proximal: shards of the
labelled sample each take a pass from the common state, the driver averages their changes, and
further passes go on from there. Scores are sparse dot products, worked out where the texts are.

The sample has at most MAX_ROWS labelled rows, those of the smallest hashes of doc_id; all texts are
scored, whole. lang, source, doc_id and labels are never features.

Defined results: null and empty texts have no features and get the score of the bias alone;
repeated rows each get their score; a doc_id with several labels has their majority (1 on a tie);
without any labelled row every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densityflow.llm.common import cut, let_go
from densityflow.llm.shingles import PLACES, mix, slices

DIMS = 1 << 18
MAX_ROWS = 20_000
SHARDS = 8
PASSES = 6
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
BIAS = 0
#: Rows of a batch that are Python objects, or features, at a time.
PIECE = 256

_CLASSES = np.full(256, 128, dtype=np.uint8)  # beyond ASCII
_CLASSES[:128] = 64
for _bit, _chars in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (4, b"0123456789"), (8, b".,;:'\"()-"), (16, b"!?"), (32, b"#*$%&|<>")):
    _CLASSES[list(_chars)] = _bit
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _family(salt: int, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed indexes and their scaled values."""
    keys = np.concatenate(grams) if grams else np.empty(0, dtype=np.uint64)
    if not len(keys):
        return np.empty(0, dtype=np.int64), np.empty(0)
    index, n = np.unique(1 + (mix(keys + np.uint64(salt)) % np.uint64(DIMS - 1)).astype(np.int64), return_counts=True)
    value = np.log1p(n)
    return index, value / np.sqrt(np.dot(value, value))


def features(text: str, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted indexes and values; hashes: those of the words of text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    space = _SPACE[raw]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]]) if len(raw) else np.empty(0, dtype=np.int64)
    if not len(starts):
        return np.array([BIAS]), np.array([1.0])
    kinds = np.bitwise_or.reduceat(np.where(space, 0, _CLASSES[raw]).astype(np.uint8), starts).astype(np.uint64)
    same = np.r_[False, hashes[1:] == hashes[:-1]]
    shape = kinds + np.uint64(256) * same
    a, b, c = PLACES[:3]
    words = [hashes] + ([hashes[:-1] * a + hashes[1:] * b] if len(hashes) > 1 else [])
    shapes = [shape] + [g for g in ((shape[:-1] + np.uint64(1)) * a + shape[1:] * b, (shape[:-2] + np.uint64(2)) * a + shape[1:-1] * b + shape[2:] * c) if len(g)]
    (i, x), (j, y) = _family(1, words), _family(2, shapes)
    index, value = np.concatenate([[BIAS], i, j]), np.concatenate([[1.0], x, y])
    distinct, at = np.unique(index, return_inverse=True)
    return distinct, np.bincount(at, weights=value)


def batch_features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    from densityflow.llm.shingles import word_hashes

    for a, b in slices(texts):
        for text, hashes in zip(texts[a:b], word_hashes(texts[a:b]), strict=True):
            yield features(text or "", hashes)


def pieces(rows):
    """An array or a batch, PIECE rows at a time."""
    return (rows.slice(at, PIECE) for at in range(0, len(rows), PIECE))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            found = list(batch_features(piece.column(2).to_pylist()))
            columns = [piece.column(0), piece.column(1), pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "index", "value"])


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl_pass(z: np.ndarray, n: np.ndarray, rows) -> None:
    """One pass over rows of (index, value, label), in place."""
    for index, value, label in rows:
        w = weights(z[index], n[index])
        p = 1.0 / (1.0 + np.exp(-np.clip(np.dot(w, value), -35, 35)))
        g = (p - label) * value
        sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA
        z[index] += g - sigma * w
        n[index] += g * g


def _pass(z: np.ndarray, n: np.ndarray):
    """Changes that each shard makes to the state; rows come sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, mine, square = None, z, n

        def changes():
            at = np.flatnonzero(square != n)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((at, pa.list_(pa.int64())), ((mine - z)[at], pa.list_(pa.float64())), ((square - n)[at], pa.list_(pa.float64())))], names=["at", "z", "n"])

        for batch in batches:
            shards, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(batch.num_rows):
                if shards[k] != shard:
                    if shard is not None:
                        yield changes()
                    shard, mine, square = shards[k], z.copy(), n.copy()
                ftrl_pass(mine, square, [(np.asarray(batch.column(2)[k].values), np.asarray(batch.column(3)[k].values), labels[k])])
        if shard is not None:
            yield changes()

    return run


def labelled(labels: DataFrame, keep: Column, label: str = "quality") -> DataFrame:
    """(doc_id, label): at most MAX_ROWS rows for which keep holds."""
    one = labels.where(keep & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS)


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality") -> np.ndarray:
    """The weights, from documents (doc_id, text) and labels (doc_id, label column) where keep holds."""
    chosen = F.broadcast(cut(labelled(labels, keep, label)))  # at most MAX_ROWS rows of two numbers
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "label", "text")
    featured = sample.mapInArrow(_featurise, "doc_id long, label double, index array<int>, value array<double>")
    rows = cut(featured.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int")))
    # the shards are the same however many tasks share them
    shards = rows.repartition(SHARDS, "shard").sortWithinPartitions("shard", F.xxhash64("doc_id", "label"), "doc_id").select("shard", "label", "index", "value")
    z, n = np.zeros(DIMS), np.zeros(DIMS)
    for _ in range(PASSES):
        # a row for each shard, no longer than DIMS; no pass needs the shuffle of the one before
        with let_go(docs.sparkSession):
            changes = shards.mapInArrow(_pass(z, n), "at array<bigint>, z array<double>, n array<double>").toArrow()
        if not changes.num_rows:
            break
        for at, dz, dn in zip(*(changes.column(k) for k in range(3)), strict=True):
            i = np.asarray(at.values)
            z[i] += np.asarray(dz.values) / changes.num_rows
            n[i] += np.asarray(dn.values) / changes.num_rows
    return weights(z, n)


def score_column(spark, w: np.ndarray, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(w.astype(np.float32))  # DIMS numbers

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value.astype(np.float64)
        for texts in parts:
            dots = np.array([np.dot(own[i], v) for piece in pieces(texts) for i, v in batch_features(piece.to_pylist())], dtype=float)
            yield pa.array(1.0 / (1.0 + np.exp(-np.clip(dots, -35, 35))))

    return score(text)


def held_out(doc_id: str = "doc_id", folds: int = 3) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    w = train(docs, labels, ~held_out())
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(docs.sparkSession, w, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that score at least 0.5."""
    w = train(docs, labels, ~held_out())
    return docs.where(score_column(docs.sparkSession, w, F.col("text")) >= 0.5)
