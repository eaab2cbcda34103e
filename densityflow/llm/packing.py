"""Operator 9: packing into length buckets of least padding.

The histogram of lengths over all documents is worked out on Spark; it has at most
sqrt(2 * all tokens) rows, as so many different lengths need that many tokens. Dynamic programming
on it (with a convex hull of lines, as the cost of a bucket is linear in its bound) finds the
boundaries that minimise the padding. In each bucket, documents are numbered without gaps and dealt
into batches of as many rows as a token budget allows at the bucket's bound; a document that alone
exceeds the budget is a batch.

Length is the number of words and one end token. Defined results: null and empty texts have length
1; repeated rows each get a place; an empty table gives an empty result; with fewer lengths than
buckets each length has its own; other columns are ignored.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densityflow.llm.common import cut, gapless, words

BUCKETS = 16
BUDGET = 65_536


def optimal_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most so many buckets over ascending lengths, of the least total padding."""
    m = len(lengths)
    if m <= buckets:
        return list(lengths)
    rows, tokens = [0], [0]
    for x, c in zip(lengths, counts, strict=True):
        rows.append(rows[-1] + c)
        tokens.append(tokens[-1] + c * x)
    best: list[int | None] = [0] + [None] * m
    parents = []
    for _ in range(buckets):
        after: list[int | None] = [None] * (m + 1)
        parent = np.zeros(m + 1, dtype=np.int64)
        lines: deque[tuple[int, int, int]] = deque()  # slope, height, from where
        for j in range(1, m + 1):
            if best[j - 1] is not None:
                slope, height = -rows[j - 1], best[j - 1] + tokens[j - 1]
                while len(lines) > 1:
                    (s1, h1, _), (s2, h2, _) = lines[-2], lines[-1]
                    if (height - h1) * (s1 - s2) <= (h2 - h1) * (s1 - slope):
                        lines.pop()
                    else:
                        break
                lines.append((slope, height, j - 1))
            if not lines:
                continue
            x = lengths[j - 1]
            while len(lines) > 1 and lines[1][0] * x + lines[1][1] <= lines[0][0] * x + lines[0][1]:
                lines.popleft()
            after[j] = lines[0][0] * x + lines[0][1] + x * rows[j] - tokens[j]
            parent[j] = lines[0][2]
        best = after
        parents.append(parent)
    bounds, j = [], m
    for parent in reversed(parents):
        bounds.append(lengths[j - 1])
        j = int(parent[j])
    return bounds[::-1]


def packed(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, bucket, padded_to, slot, batch, place)."""
    lengths = (F.size(words(F.col(text))) + 1).cast("long")
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), lengths.alias("n_tokens"), F.spark_partition_id().alias("chunk")))
    histogram = sorted((r[0], r[1]) for r in rows.groupBy("n_tokens").count().collect())
    bounds = optimal_bounds([x for x, _ in histogram], [n for _, n in histogram], buckets)
    bucket = sum([(F.col("n_tokens") > F.lit(b)).cast("int") for b in bounds[:-1]], F.lit(0))
    table = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(1).cast("long"))
    rows = rows.withColumn("bucket", bucket.cast("int")).withColumn("padded_to", table[F.col("bucket")])
    out = gapless(rows, "bucket", "chunk", ["doc_id", "n_tokens"], "slot")
    per = F.greatest(F.floor(F.lit(budget) / F.col("padded_to")), F.lit(1)).cast("long")
    out = out.withColumn("batch", F.floor(F.col("slot") / per).cast("long")).withColumn("place", (F.col("slot") % per).cast("long"))
    return out.select("doc_id", "n_tokens", "bucket", "padded_to", "slot", "batch", "place")
