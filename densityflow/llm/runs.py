"""Operator 13: periodic runs of words, found by uniting suffix classes in the order of their common prefixes.

A run is a maximal stretch of words whose smallest period q fits in it at least twice. The suffixes
of a text are sorted by doubling; each neighbouring pair is an edge whose weight is the length of
their common prefix (LCP). Kruskal's algorithm takes the edges by decreasing LCP and unites classes
of suffixes, whose positions are kept in order, the smaller into the larger. When two positions
become neighbours in a class at LCP l and lie d <= l apart, the words from the first on for d + l
have period d, and no smaller one: a smaller one would put a position of the class between the two.
These are seeds. A run that begins at s gets one from s and s + q, for their LCP is its length less
q, and seeds of a run agree in where it ends; so its seeds with the smallest position give it whole.

A run of at least `least` words begins with a common prefix of at least least / 2, so the union stops
there, and texts in which no window of that many words occurs twice have none.

A text is one row and is worked on in one task; memory is some 40 bytes a word and 4 more for each
doubling of the longest repeat. Defined results: null texts, and texts without words, have no runs
and an empty collapsed text; rows that repeat each get a row; empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densityflow.llm.common import let, words
from densityflow.llm.shingles import PLACES, mix, slices, word_hashes

LEAST = 12
SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def repeats(hashes: np.ndarray, width: int) -> bool:
    """Whether a window of so many words may occur twice."""
    n = len(hashes) - width + 1
    if n < 2:
        return False
    sums = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        sums = mix(sums + hashes[k : n + k] * PLACES[k % len(PLACES)])
    sums.sort()
    return bool((sums[1:] == sums[:-1]).any())


def suffixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes, and the LCP of each with the next. codes: words as numbers from 0."""
    n = len(codes)
    ranks, levels, step = codes.astype(np.int64), [codes.astype(np.int32)], 1
    while True:
        after = np.zeros(n, dtype=np.int64)  # what lies beyond the end comes first
        after[: n - step] = ranks[step:] + 1
        keys = ranks * (n + 1) + after
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        ranks[order] = np.r_[0, np.cumsum(keys[1:] != keys[:-1])]
        step *= 2
        if ranks[order[-1]] == n - 1:
            break
        levels.append(ranks.astype(np.int32))
    x, y = order[:-1], order[1:]
    lcp = np.zeros(n - 1, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = np.minimum(x + lcp, n - 1), np.minimum(y + lcp, n - 1)
        equal = (np.maximum(x, y) + lcp < n) & (levels[k][i] == levels[k][j])
        lcp += equal * (1 << k)
    return order, lcp


def seeds(order: np.ndarray, lcp: np.ndarray, shallow: int) -> dict[tuple[int, int], int]:
    """(end, period): the smallest position of a run's seeds. LCPs below shallow unite nothing."""
    n = len(order)
    edges = np.flatnonzero(lcp >= shallow)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    xs, ys, ls = order[edges].tolist(), order[edges + 1].tolist(), lcp[edges].tolist()
    parent = list(range(n))
    before, after = [-1] * n, [-1] * n
    classes: dict[int, list[int]] = {}
    found: dict[tuple[int, int], int] = {}

    def root(p: int) -> int:
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        return p

    at, many = 0, len(ls)
    while at < many:
        level = ls[at]
        moved: dict[int, tuple[int, int]] = {}  # the neighbours before this level
        while at < many and ls[at] == level:
            large, small = root(xs[at]), root(ys[at])
            into, out = classes.get(large) or [large], classes.get(small) or [small]
            if len(into) < len(out):
                large, small, into, out = small, large, out, into
            parent[small] = large
            classes.pop(small, None)
            classes[large] = into
            for p in out:
                moved.setdefault(p, (before[p], after[p]))
                k = bisect_left(into, p)
                left, right = into[k - 1] if k else -1, into[k] if k < len(into) else -1
                into.insert(k, p)
                before[p], after[p] = left, right
                if left >= 0:
                    after[left] = p
                if right >= 0:
                    before[right] = p
            at += 1
        for p, (left, right) in moved.items():
            for i, j, old in ((before[p], p, left), (p, after[p], right)):
                # neighbours of a class that moved as a whole met at a higher level
                if i >= 0 and j >= 0 and old != (i if j == p else j) and j - i <= level:
                    key = (j + level, j - i)
                    if found.get(key, n) > i:
                        found[key] = i
    return found


def runs_of(text_words: list[bytes], hashes: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least so many words, by start, then period."""
    shallow = max(1, -(-least // 2))
    if not repeats(hashes, shallow):
        return []
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in text_words), np.int64, len(text_words))
    found = seeds(*suffixes(codes), shallow)
    return sorted(((start, end - start, period) for (end, period), start in found.items() if end - start >= least), key=lambda r: (r[0], r[2]))


def collapsed_words(text_words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Of each run, only the first period stays."""
    if not runs:
        return text_words
    depth = np.zeros(len(text_words) + 1, dtype=np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [text_words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def _finder(least: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                runs, rest = [], []
                split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts[a:b]]
                for ws, hashes in zip(split, word_hashes(texts[a:b], split), strict=True):
                    own = runs_of(ws, hashes, least)
                    runs.append([{"start": s, "length": m, "period": q} for s, m, q in own])
                    rest.append(b" ".join(collapsed_words(ws, own)).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(runs, row), pa.array(rest, pa.string())], names=["doc_id", "runs", "collapsed"])

    return find


def periodic_runs(docs: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed), a row for each row of docs: its runs by start, then period, and its words
    joined by spaces without those that a run repeats."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_finder(least), SCHEMA)


def looped(doc_id: Column, text: Column) -> Column:
    """The text, in one of ten documents with its tail replaced by repeats of what the tail begins with.

    doc_id decides which, where from and how often; without a doc_id the text stays."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def loop(ws: Column) -> Column:
        n = F.size(ws)
        start = g % n
        period = 1 + F.floor((n - start) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < start, ws[i]).otherwise(ws[(start + (i - start) % period).cast("int")])), " ")

    some = let(words(text), lambda ws: F.when(F.size(ws) > 0, loop(ws)).otherwise(F.lit("")))
    return F.when(h % 10 == 0, some).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of periodic_runs."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("m"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(F.lit(1000) * -F.col("m.less") / F.col("m.period")).cast("long")
    return out.select("doc_id", "n_runs", F.col("m.start").alias("start"), (-F.col("m.less")).alias("length"), F.col("m.period").alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
