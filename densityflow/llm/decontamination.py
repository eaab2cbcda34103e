"""Operator 6: containment search for benchmark items by MinHash, then exact verification.

An item is contained in a document if at least a share ``threshold`` of its distinct five-word
shingles occurs there. MinHash values of an item are the smallest hashes of its own shingles; that
such a value occurs among the document's shingles has the containment as its probability, however
long the document is. Items are partitioned by size: up to n - ceil(threshold * n) + 1 values are
kept where that is few (one of them must then occur, so nothing can be missed), and
``SKETCH`` of them in partitions of larger items (a contained item is missed with a probability
below (1 - threshold) ** SKETCH). Candidates are verified on the shingles themselves.

Documents' shingles meet only the sketches, so that the join is a broadcast of the benchmark's
sketch if that is small, and a shuffle of hashes otherwise. DataFrame functions only.

Defined results: texts are lower-cased; null or empty texts contain nothing and are contained in
nothing; an item of fewer than five words has its whole sequence as its one shingle, found in a
document that consists of it; repeated rows of a doc_id (or item_id) count as one; a null doc_id or
item_id is a value like any other; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densityflow.llm.common import cut, if_small, shingle_hashes, shingle_texts, tidy, words

SKETCH = 12
#: Small benchmark sketches are broadcast: rows of two numbers.
SKETCH_ROWS = 500_000


def _lower_words(text: str):
    return words(F.lower(F.col(text)))


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """(h, item): the smallest shingle hashes of each item, as many as its size partition keeps."""
    hashed = items.select("item", F.array_sort(F.array_distinct(shingle_hashes(F.col("ws")))).alias("hs"))
    n = F.size("hs")
    enough = n - F.ceil(F.lit(threshold) * n - F.lit(1e-9)).cast("int") + 1
    size_class = F.floor(F.log2(F.greatest(n, F.lit(1))))
    keep = F.when(size_class <= 5, enough).otherwise(F.least(enough, F.lit(SKETCH)))
    return hashed.select("item", F.explode(F.slice("hs", F.lit(1), F.greatest(keep, F.lit(0)))).alias("h"))


@tidy
def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of each contained item."""
    tests = items.select(F.col(item_id).alias("item"), F.col(text).alias("t")).withColumn("ws", _lower_words("t")).where(F.size("ws") > 0)
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("t"))
    sketch = cut(sketches(tests, threshold).distinct())
    hashes = texts.withColumn("ws", _lower_words("t")).select("doc", F.explode(shingle_hashes(F.col("ws"))).alias("h"))
    hits = hashes.join(if_small(sketch, SKETCH_ROWS), "h").select("doc", "item").distinct()
    hits = cut(hits)
    some = hits.select(F.col("doc").alias("_doc")).distinct()
    near = texts.join(if_small(some), texts["doc"].eqNullSafe(F.col("_doc")), "left_semi")
    near = cut(near.withColumn("row", F.monotonically_increasing_id()))
    # each item's own shingles, so that of a document's shingles only those of some item are joined
    wanted = cut(tests.select("item", F.monotonically_increasing_id().alias("test"), F.array_distinct(shingle_texts(F.col("ws"))).alias("s")))
    of_items = wanted.select("test", F.explode("s").alias("g"))
    every = near.withColumn("ws", _lower_words("t")).select("row", F.explode(F.array_distinct(shingle_texts(F.col("ws")))).alias("g"))
    shared = every.join(if_small(of_items), "g").groupBy("row", "test").agg(F.count(F.lit(1)).alias("n_shared"))
    found = shared.join(if_small(wanted.select("test", "item", F.size("s").cast("long").alias("n_shingles"))), "test")
    found = found.where(F.col("n_shared") >= F.lit(threshold) * F.col("n_shingles") - F.lit(1e-9))
    found = found.join(near.select("row", "doc"), "row")
    pairs = hits.select(F.col("doc").alias("_doc"), F.col("item").alias("_item"))
    found = found.join(pairs, F.col("doc").eqNullSafe(F.col("_doc")) & F.col("item").eqNullSafe(F.col("_item")), "left_semi")
    best = found.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(F.max(F.struct((F.col("n_shared") / F.col("n_shingles")).alias("c"), "n_shingles", "n_shared")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shingles", "b.n_shared", F.col("b.c").alias("containment"))


def without_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs without those that contain an item."""
    bad = cut(contained(docs, items, threshold).select(F.col("doc_id").alias("_bad")).distinct())
    bad = if_small(bad)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")
