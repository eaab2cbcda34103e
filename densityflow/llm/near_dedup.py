"""Operator 10: near duplicates by one-permutation MinHash.

One hash of each shingle places it in one of ROWS * BANDS bins; a bin's value is its smallest hash.
An empty bin borrows the value of the first filled bin in a random order of its own, which is
optimal densification. Bins are banded into bucket keys. Documents of equal shingle sets are one
class, and only classes are linked, so that exact copies never meet in a bucket.

In each bucket the class that meets most others is the centre, and star-shaped candidate edges go
from it to the rest: as many as members, not as pairs. Edges are confirmed on full shingle sets;
links give components. A star alone could miss a link between two members that are both unlike
their centre. So the members of buckets that hold someone outside the centre's component are joined once
more, not by bucket but by prefixes: each set's shingles, the rarest first, of which two sets that reach
the threshold must share one of the first few. Pairs of one component are left out, and those that counts
prove too far apart: of each, the shingles that some other such member has, too, are counted by
residues, and the sum of the smaller counts bounds what they share. Nothing is capped, and nothing
meets only because it shares a bucket.

A pair of similarity s meets in some bucket with a probability of 1 - (1 - s ** rows) ** bands:
0.9999997 at 0.85 with 48 bands of 8 rows, and 0.9999995 at 0.8 with 48 of 6.

Defined results: null and empty texts have an empty set, are linked with nothing and are kept; rows
of equal text (or with the same doc_id) each get a row; a component is named by its smallest doc_id,
nulls last; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densityflow.llm.common import BROADCAST_ROWS, cut, if_small, tidy
from densityflow.llm.shingles import fingerprint, mix, shingle_set, slices, word_hashes

BANDS = 48
#: Residues by which the shingles of two classes are counted to bound what they share.
GROUPS = 64
#: Members of a star that one task holds against its centre.
STAR = 128


def rows_for(percent: int) -> int:
    return 8 if percent >= 85 else 6


def ranks(bins: int) -> np.ndarray:
    """For each bin, a random order of all bins."""
    return np.random.default_rng(20_240_229).random((bins, bins), dtype=np.float32)


def signature(shingles: np.ndarray, bins: int, order: np.ndarray) -> np.ndarray:
    """shingles: sorted and not empty."""
    at = ((shingles >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    filled = at[first]
    sig = np.zeros(bins, dtype=np.uint64)
    sig[filled] = shingles[first]
    if len(filled) < bins:
        empty = np.ones(bins, dtype=bool)
        empty[filled] = False
        empty = np.flatnonzero(empty)
        donors = filled[np.argmin(order[np.ix_(empty, filled)], axis=1)]
        sig[empty] = sig[donors]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = sig.reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        key = mix(key + grid[:, k])
    return key.view(np.int64)


def _signer(rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BANDS * rows
        order = ranks(bins)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                sizes, marks, keys = [], [], []
                for hashes in word_hashes(texts[a:b]):
                    s = shingle_set(hashes)
                    sizes.append(len(s))
                    marks.append(fingerprint(s) if len(s) else None)
                    keys.append(band_keys(signature(s, bins, order), BANDS, rows) if len(s) else None)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "fp", "bands"])

    return sign


def _stars(percent: int):
    """Rows by (centre, part), the centre's own text first: which members does it link with?"""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.empty(0, dtype=np.uint64)
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(4)]
            out: list[tuple[bytes, bytes]] = []
            for a, b in slices(cols[3]):
                for k, hashes in zip(range(a, b), word_hashes(cols[3][a:b]), strict=True):
                    s = shingle_set(hashes)
                    mark = fingerprint(s)
                    if cols[2][k] is None:
                        if mark == cols[0][k]:
                            centre, own = cols[0][k], s
                    elif mark == cols[2][k] and centre == cols[0][k]:
                        both = len(np.intersect1d(own, s, assume_unique=True))
                        if 100 * both >= percent * (len(own) + len(s) - both):
                            out.append((centre, mark))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["a", "b"])

    return confirm


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in slices(texts):
            sets = [shingle_set(h) for h in word_hashes(texts[a:b])]
            keep = [k for k, s in enumerate(sets) if len(s) and fingerprint(s) == marks[a + k]]
            yield pa.RecordBatch.from_arrays([pa.array([marks[a + k] for k in keep], pa.binary()), pa.array([sets[k].view(np.int64) for k in keep], pa.list_(pa.int64()))], names=["fp", "hs"])


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles a class may share with others, in all and by GROUPS residues."""
    for batch in batches:
        shared, groups = [], []
        for hs, own in zip(batch.column(1), batch.column(2), strict=True):
            rest = np.setdiff1d(np.asarray(hs.values), np.asarray(own.values) if own.is_valid else np.empty(0, np.int64), assume_unique=True)
            shared.append(len(rest))
            groups.append(np.bincount(rest.view(np.uint64) % np.uint64(GROUPS), minlength=GROUPS).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared, pa.int64()), pa.array(groups, pa.list_(pa.int32()))], names=["fp", "shared", "groups"])


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component; links: (a, b).

    Labels take the smallest of their neighbours' and then of their root's label, until none
    changes. Each round is cut in the shared folder; while labels are few they go to the edges, not both to
    new partitions, and no join of a round shuffles."""
    edges = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    few = labels.count() <= BROADCAST_ROWS  # as many in every round
    small = F.broadcast if few else lambda df: df
    while True:
        known = small(labels)
        near = edges.join(known, edges["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("m"))
        # every node is the end of an edge
        step = near.join(known, labels["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "m").alias("r"))
        step = cut(step) if few else step
        # the old root learns the smaller label as well, so that whole trees are joined at once
        hook = step.groupBy(F.col("old").alias("top")).agg(F.min("r").alias("best"))
        hook = small(hook.where(F.col("best") < F.col("top")))
        moved = step.join(hook, step["old"] == hook["top"], "left").select("node", "old", F.least("r", F.coalesce("best", "r")).alias("root"))
        moved = cut(moved)
        changed = moved.where(F.col("old") != F.col("root")).limit(1).count()
        labels = moved.select("node", "root")
        if not changed:
            return labels


class _Corpus:
    def __init__(self, docs: DataFrame, classes: DataFrame, percent: int):
        self.docs, self.classes, self.percent = docs, classes, percent

    def texts(self, marks: DataFrame) -> DataFrame:
        """(fp, text) of the classes in marks (fp); a doc_id that has several texts gives them all,
        and the tasks pick the right one by its fingerprint."""
        wanted = self.classes.join(if_small(marks), "fp", "left_semi").select("fp", F.col("first").alias("_id"))
        wanted = if_small(cut(wanted))
        return self.docs.join(wanted, self.docs["doc_id"].eqNullSafe(wanted["_id"])).select("fp", "text")

    def confirmed(self, edges: DataFrame) -> DataFrame:
        """Links among the candidate edges (a, b), a being the centre."""
        marks = cut(edges.select(F.col("a").alias("fp")).union(edges.select(F.col("b").alias("fp"))).distinct())
        texts = cut(self.texts(marks))
        stars = cut(edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(STAR)).cast("int").alias("parts")))
        # at most a STAR-th as many as edges; the edges of all others stay whole, and none is dealt by its centre alone
        large = if_small(cut(stars.where("parts > 1").select(F.col("a").alias("_a"), F.col("parts").alias("_parts"))))
        centres = stars.join(texts, F.col("a") == F.col("fp")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("binary").alias("b"), "text")
        part = F.pmod(F.xxhash64("b"), F.coalesce("_parts", F.lit(1))).cast("int")
        members = edges.join(large, F.col("a") == F.col("_a"), "left").select("a", "b", part.alias("part")).join(texts, F.col("b") == F.col("fp")).select("a", "part", "b", "text")
        rows = centres.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        return cut(rows.mapInArrow(_stars(self.percent), "a binary, b binary").distinct())


def _prefix_pairs(sets: DataFrame, percent: int, bounds: tuple[str, ...] = (), may=lambda x, y: F.lit(True)) -> DataFrame:
    """Pairs (x, y) of sets (fp, n, root, hs array) of two roots that may be as similar as percent; none that is
    gets lost.

    All shingles have one order, rare ones first. Two sets that reach the threshold share one of the
    first n - ceil(2pn / (100 + p)) + 1 shingles of the smaller and of the first n - ceil(pn / 100) + 1 of
    the other: else what remains is too little. A shingle that one set alone has meets nothing, so sets
    that fall short of the threshold by rare shingles of their own make no pair, however many they are; and one
    that a single root has joins nothing. Of the shingles that two sets share, the first one's places leave
    room for all they must share. may(x, y), names of the two sides, is what else is known of a pair, from
    the columns in bounds."""
    tokens = sets.select("fp", F.explode("hs").alias("h"))
    often = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    n, p = F.col("n"), percent
    probe, index = n - F.ceil(p * n / 100) + 1, n - F.ceil(2 * p * n / (100 + p)) + 1
    # what one set alone has comes first and is passed over by its number
    ranked = tokens.join(often, "h").groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("hs"))  # no more than a set's shingles
    carried = ["fp", "n", "root", *bounds]
    ranked = sets.select(*carried).join(ranked, "fp").withColumn("alone", n - F.size("hs"))
    some = ranked.select(*carried, index.alias("index"), "alone", F.posexplode(F.slice("hs", F.lit(1), F.greatest(probe - F.col("alone"), F.lit(0)).cast("int"))).alias("at", "t"))
    place = F.col("alone") + F.col("at")
    some = cut(some.select(*carried, F.col("t.h").alias("h"), (F.col("n") - place).alias("rest"), (place < F.col("index")).alias("indexed")))
    mixed = cut(some.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("indexed").alias("any")).where("low != high AND any").select("h"))
    some = cut(some.join(if_small(mixed), "h", "left_semi"))
    x, y = some.where("indexed").alias("x"), some.alias("y")
    smaller = F.struct("x.n", "x.fp") < F.struct("y.n", "y.fp")
    room = (100 + p) * F.least("x.rest", "y.rest") >= p * (F.col("x.n") + F.col("y.n"))
    met = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.root") != F.col("y.root")) & smaller & (100 * F.col("x.n") >= p * F.col("y.n")) & room & may("x", "y"))
    return met.select(F.col("x.fp").alias("x"), F.col("y.fp").alias("y")).distinct()


def _rest(members: DataFrame, roots: DataFrame, stars: DataFrame, corpus: _Corpus) -> DataFrame:
    """Candidate edges (a, b) between members of buckets whom the stars have not brought together."""
    label = F.coalesce("root", "fp")
    named = members.join(roots, members["fp"] == roots["node"], "left").select("key", "fp", "n", "centre", label.alias("root"))
    centre_root = roots.select(F.col("node").alias("_c"), F.col("root").alias("centre_root"))
    named = named.join(centre_root, F.col("centre") == F.col("_c"), "left").withColumn("outside", F.col("root") != F.coalesce("centre_root", "centre")).drop("_c", "centre_root")
    named = cut(named.where(F.col("fp") != F.col("centre")))  # the centre itself has met all
    open_keys = cut(named.where("outside").groupBy("key").agg(F.count(F.lit(1)).alias("_n")).select("key"))
    named = cut(named.join(if_small(open_keys), "key", "left_semi").select("fp", "n", "root").distinct())
    sets = cut(corpus.texts(named.select("fp")).mapInArrow(_sets, "fp binary, hs array<bigint>").dropDuplicates(["fp"]))
    alone = sets.select("fp", F.explode("hs").alias("h")).groupBy("h").agg(F.min("fp").alias("fp"), F.max("fp").alias("other")).where(F.col("fp") == F.col("other"))
    alone = alone.groupBy("fp").agg(F.collect_list("h").alias("own"))  # no more than the class's own shingles
    bounds = cut(sets.join(alone, "fp", "left").select("fp", "hs", "own").mapInArrow(_histograms, "fp binary, shared long, groups array<int>"))
    p = F.lit(corpus.percent)
    rich = cut(named.join(bounds, "fp").where(100 * F.col("shared") >= p * F.col("n")))

    def may(x: str, y: str):
        def reach(most):
            return 100 * most >= p * (F.col(f"{x}.n") + F.col(f"{y}.n") - most)

        most = F.aggregate(F.zip_with(f"{x}.groups", f"{y}.groups", lambda i, j: F.least(i, j)), F.lit(0), lambda i, j: i + j)
        return reach(F.least(f"{x}.shared", f"{y}.shared")) & reach(most)

    pairs = _prefix_pairs(sets.join(rich, "fp"), corpus.percent, ("shared", "groups"), may)
    return _directed(pairs.select(F.col("y").alias("a"), F.col("x").alias("b"))).join(stars, ["a", "b"], "left_anti")


def _directed(pairs: DataFrame) -> DataFrame:
    """Distinct unordered pairs; a is the one that was named as the centre."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    one = pairs.groupBy(low.alias("low"), high.alias("high")).agg(F.max("a").alias("a"))
    return one.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))


@tidy
def near_duplicates(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = cut(docs.mapInArrow(_signer(rows_for(percent)), "doc_id long, n long, fp binary, bands array<bigint>"))
    rows = signed.select("doc_id", "n", "fp")
    classes = signed.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    classes = cut(classes)
    slim = classes.select("fp", "first", "n")
    corpus = _Corpus(docs, slim, percent)
    bands = classes.select(F.explode("bands").alias("key"), "fp")
    buckets = cut(bands.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("c > 1"))
    large = buckets.where("c > 2").select("key", "c")
    members = cut(classes.select(F.explode("bands").alias("key"), "fp", "n").join(if_small(large), "key"))
    degree = members.groupBy("fp").agg(F.sum("c").alias("degree"))
    members = members.join(degree, "fp")
    centre = members.groupBy("key").agg(F.max(F.struct("degree", "fp")).alias("m")).select("key", F.col("m.fp").alias("centre"))
    members = cut(members.join(centre, "key").select("key", "fp", "n", "centre"))
    pairs = buckets.where("c = 2 AND a != b").select("a", "b")
    pairs = pairs.union(members.where(F.col("fp") != F.col("centre")).select(F.col("centre").alias("a"), F.col("fp").alias("b")))
    stars = cut(_directed(pairs))
    links = corpus.confirmed(stars)
    roots = components(links)
    more = cut(_rest(members, roots, stars.union(stars.select("b", "a")), corpus))
    if more.limit(1).count():
        links = links.union(corpus.confirmed(more))
        roots = components(links)
    least = roots.join(slim, roots["node"] == slim["fp"]).groupBy("root").agg(F.min("first").alias("component"))
    named = cut(roots.join(least, "root").select(F.col("node").alias("fp"), "component"))
    of_class = slim.join(named, "fp", "left").select("fp", F.coalesce("component", "first").alias("component"))
    out = rows.join(of_class, "fp", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one row of each component.

    A doc_id that names several texts stays if any of them does; rows that repeat both are one."""
    taken = docs.columns
    found = cut(near_duplicates(docs, percent))
    by_id = found.groupBy("doc_id").agg(F.max("kept").alias("_any"))
    gone = if_small(cut(by_id.where("NOT _any").select(F.col("doc_id").alias("_gone"))))
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
    twice = cut(found.where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_twice")))
    if twice.limit(1).count():
        again = F.broadcast(twice) if twice.count() < 100_000 else twice
        others = kept.join(again, kept["doc_id"].eqNullSafe(again["_twice"]), "left_anti")
        repeated = kept.join(again, kept["doc_id"].eqNullSafe(again["_twice"]), "left_semi")
        kept = others.unionByName(repeated.dropDuplicates(["doc_id", "text"]))
    return kept.select(*taken)
