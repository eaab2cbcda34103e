"""Operator 11: collocations, from count streams in prefix order and in suffix order.

The layout is that of external-memory estimators of n-gram models. Counts of phrases of one word up
to four are one stream per language, sorted twice by ranges: by their words (prefix order), where a
phrase stands after all its prefixes and before all that extend it to the right, and by their words
from the last to the first (suffix order), where the same holds of suffixes and of extensions to the
left. One pass over a sorted range, with a stack of at most three open phrases, so gives each phrase
the counts of its prefixes (what a cut leaves on the left) and the largest count of its extensions;
the pass in the other order gives the rest, and the two results meet in a merge join. Nothing is
looked up by hash there, and a hot first word is no group: ranges are cut anywhere, and what was
open where a range begins (three phrases a range at most) is handed on afterwards.

Before that, the counting: only phrases of at least `least` occurrences matter, and all parts of
such a phrase have as many. So words are counted first, then pairs of two frequent words, then
longer phrases of frequent pairs; these three counts go by 64-bit hashes, whose collisions can only
raise them. What they leave is counted again with its words at hand, told apart by 128 bits inside a
task and by its text between tasks. The tables
of frequent hashes reach the tasks as a filter of at most MOST_BLOCKS 64-bit blocks (16 MB); beyond
what it tells apart, more phrases are sent and then dropped by their counts.

Defined results: null and empty texts have no words; a null language is `und`; repeated rows and
doc_ids count as often as they occur; ties in score go by count and then by the phrase's UTF-8 bytes;
empty tables give empty results; other columns are ignored. Numbers are exact (38 digits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densityflow.llm.common import cut, tidy
from densityflow.llm.shingles import PLACES, mix, slices

LEAST = 30
LONGEST = 4
TOP = 2000
SHARE = 80
MOST_BLOCKS = 1 << 21
#: Input splits that one task counts phrases of.
SPLITS = 4
#: Counts that a task holds before it sends them.
HELD = 2_000_000
#: Phrases that a task holds before it sends them, some 100 bytes each.
HELD_PHRASES = 1_500_000
#: Lower case, one white space, and a full stop for all that ends a piece.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz" + b"." * 9)
STOP = b"."


def tokens(texts: list[str | None]) -> np.ndarray:
    """The words of all texts in order, with a stop wherever a piece ends."""
    joined = ".".join(t or "" for t in texts).encode("utf-8", "surrogatepass").translate(PLAIN)
    found = (joined.replace(STOP, b" . ") + b" .").split()
    out = np.empty(len(found), dtype=object)
    out[:] = found
    return out


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in slices(texts):
            groups: dict[str, list[str]] = {}
            for lang, text in zip(langs[a:b], texts[a:b], strict=True):
                groups.setdefault(lang, []).append(text or "")
            yield from groups.items()


def _seed(lang: str) -> np.uint64:
    return pd.util.hash_array(np.array([lang], dtype=object), categorize=False)[0]


def _hashed(flat: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(flat, categorize=False)


def window_hashes(hashes: np.ndarray, size: int, seed: np.uint64) -> np.ndarray:
    """A hash of the window of so many words from each place, and of its language."""
    n = len(hashes) - size + 1
    out = np.full(max(n, 0), seed + np.uint64(size), dtype=np.uint64)
    for k in range(size):
        out += hashes[k : n + k] * PLACES[k]
    return mix(out)


def _all_of(marks: np.ndarray, size: int) -> np.ndarray:
    """Whether all of so many neighbours are marked."""
    n = max(len(marks) - size + 1, 0)
    out = np.ones(n, dtype=bool)
    for k in range(size):
        out &= marks[k : n + k]
    return out


class Filter:
    """A Bloom filter of one 64-bit block a key; blocks is a power of two."""

    def __init__(self, blocks: np.ndarray):
        self.blocks, self.shift = blocks, np.uint64(64 - max(len(blocks).bit_length() - 1, 1))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        mask = np.uint64(0)
        for k in (0, 6, 12):
            mask = mask | np.uint64(1) << ((keys >> np.uint64(k)) & np.uint64(63))
        return (self.blocks[keys >> self.shift] & mask) == mask


def filter_of(hashes: DataFrame):
    """A broadcast Filter of hashes (h): at most MOST_BLOCKS blocks come to the driver, however many rows."""
    wide = max(1, min((hashes.count() // 2).bit_length(), MOST_BLOCKS.bit_length() - 1))
    mask = F.lit(0).cast("long")
    for k in (0, 6, 12):
        place = F.shiftrightunsigned("h", k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    rows = hashes.groupBy(F.shiftrightunsigned("h", 64 - wide).cast("int").alias("block")).agg(F.bit_or(mask).alias("bits")).toArrow()
    blocks = np.zeros(1 << wide, dtype=np.uint64)
    blocks[rows["block"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(blocks)


def _counted(found: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct hashes and how often each came, of bounded pieces of the input."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged():
        keys, counts = np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.add.reduceat(counts, first)

    for hashes in found:
        if len(hashes):
            held.append(np.unique(hashes, return_counts=True))
            size += len(held[-1][0])
        if size > HELD:
            one = merged()
            if len(one[0]) > HELD // 2:
                yield one
                held, size = [], 0
            else:
                held, size = [one], len(one[0])
    if held:
        yield merged()


def _count_batches(pairs) -> Iterator[pa.RecordBatch]:
    for keys, counts in pairs:
        for a in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 50_000].view(np.int64)), pa.array(counts[a : a + 50_000])], names=["h", "n"])


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words: (lang, h, n), and (lang, null, n) for all words of a language."""
    totals: dict[str, int] = {}

    def found():
        for lang, texts in _by_language(batches):
            flat = tokens(texts)
            words = _hashed(flat[flat != STOP])
            totals[lang] = totals.get(lang, 0) + len(words)
            yield window_hashes(words, 1, _seed(lang))

    for batch in _count_batches(_counted(found())):
        yield pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.string()), *batch.columns], names=["lang", "h", "n"])
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())], names=["lang", "h", "n"])


def _longer(blocks, part: int, sizes: range):
    """Windows of these sizes whose windows of `part` words all pass the filter: (h, n)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(blocks.value)

        def found():
            for lang, texts in _by_language(batches):
                flat, seed = tokens(texts), _seed(lang)
                words = _hashed(flat)
                good = known(window_hashes(words, part, seed)) & _all_of(flat != STOP, part)
                for size in sizes:
                    at = np.flatnonzero(_all_of(good, size - part + 1))
                    yield window_hashes(words, size, seed)[at]

        yield from _count_batches(_counted(found()))

    return count


class _Held:
    """Phrases of one language and how often each came, told apart by two hashes of 64 bits."""

    def __init__(self):
        self.first, self.second = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.counts, self.phrases = np.empty(0, np.int64), np.empty(0, object)

    def add(self, first: np.ndarray, second: np.ndarray, phrase_at) -> None:
        """Occurrences by their hashes; phrase_at(k) is the phrase of the k-th."""
        order = np.argsort(first)
        x, y = first[order], second[order]
        if len(x) and ((y[1:] != y[:-1]) & (x[1:] == x[:-1])).any():
            order = np.lexsort((second, first))
            x, y = first[order], second[order]
        starts = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.empty(0, np.int64)
        counts = np.diff(np.r_[starts, len(x)])
        x, y, order = x[starts], y[starts], order[starts]
        at = np.searchsorted(self.first, x)
        known = np.zeros(len(x), dtype=bool)
        inside = at < len(self.first)
        known[inside] = (self.first[at[inside]] == x[inside]) & (self.second[at[inside]] == y[inside])
        self.counts[at[known]] += counts[known]
        new = ~known
        names = np.empty(int(new.sum()), dtype=object)
        names[:] = [phrase_at(k) for k in order[new].tolist()]
        place = at[new]
        self.first, self.second = np.insert(self.first, place, x[new]), np.insert(self.second, place, y[new])
        self.counts, self.phrases = np.insert(self.counts, place, counts[new]), np.insert(self.phrases, place, names)


def _phrases(blocks):
    """Phrases that pass the filter: (lang, phrase, n), a row for each in a piece of the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(blocks.value)
        held: dict[str, _Held] = {}

        def sent():
            for lang, own in held.items():
                for a in range(0, len(own.counts), 10_000):
                    names = [p.decode("utf-8", "surrogatepass") for p in own.phrases[a : a + 10_000]]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(own.counts[a : a + 10_000])], names=["lang", "phrase", "n"])
            held.clear()

        for lang, texts in _by_language(batches):
            flat, seed = tokens(texts), _seed(lang)
            codes, distinct = pd.factorize(flat)
            words, whole = _hashed(distinct)[codes], flat != STOP
            others = pd.util.hash_array(distinct, hash_key="another hash key", categorize=False)[codes]
            own = held.setdefault(lang, _Held())
            for size in range(1, LONGEST + 1):
                hashes = window_hashes(words, size, seed)
                at = np.flatnonzero(_all_of(whole, size))
                at = at[known(hashes[at])]
                second = window_hashes(others, size, seed)[at]
                own.add(hashes[at], second, lambda k, at=at, size=size: b" ".join(flat[at[k] : at[k] + size].tolist()))  # noqa: B023
            if sum(len(x.counts) for x in held.values()) > HELD_PHRASES:
                yield from sent()
        yield from sent()

    return count


def merged(docs: DataFrame) -> DataFrame:
    """docs in tasks of SPLITS input splits each, as long as every core has two: phrases that several splits
    have are then one row before they are sent."""
    splits = docs.rdd.getNumPartitions()
    return docs.coalesce(max(1, min(splits, max(2 * docs.sparkSession.sparkContext.defaultParallelism, splits // SPLITS))))


def phrase_counts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of phrases with at least so many occurrences, and (lang, n) of all words. docs: (lang, text)."""
    often = F.col("n") >= least
    single = docs.mapInArrow(_single, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    single = cut(single.where(F.col("lang").isNotNull() | often))
    words = single.where("lang IS NULL").select("h")
    one = filter_of(words)
    pairs = cut(docs.mapInArrow(_longer(one, 1, range(2, 3)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(often).select("h"))
    two = filter_of(pairs)
    longer = cut(docs.mapInArrow(_longer(two, 2, range(3, LONGEST + 1)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(often).select("h"))
    all_of_them = filter_of(words.union(pairs).union(longer))
    phrases = merged(docs).mapInArrow(_phrases(all_of_them), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(often)
    phrases = cut(phrases)
    for sent in (one, two, all_of_them):
        sent.unpersist()
    return phrases, single.where("lang IS NOT NULL").select("lang", "n")


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over a range of (lang, key, n), sorted: parts[k], the count of the first k + 1 words (null if
    it stands in a range before), and more, the largest count of an extension by a word in this range.
    What an earlier range holds gets a row without n for its extensions here."""
    parts_type = pa.list_(pa.int64())
    out: list[tuple] = []
    open_: list[list] = []  # (key, n, parts, more) of the phrases that the next one may extend
    of = ""

    def close(depth: int):
        while len(open_) > depth:
            key, n, parts, more = open_.pop()
            out.append((of, key, n, parts, more))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = [pa.string(), pa.list_(pa.string()), pa.int64(), parts_type, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["lang", "key", "n", "parts", "more"])

    for batch in batches:
        for lang, key, n in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            same = 0
            if lang == of:
                while same < min(len(open_), len(key) - 1) and open_[same][0][-1] == key[same]:
                    same += 1
            close(same)
            of = lang
            for k in range(same, len(key) - 1):  # stands in an earlier range
                open_.append([key[: k + 1], None, [], None])
            if len(key) > 1:
                above = open_[len(key) - 2]
                above[3] = n if above[3] is None else max(above[3], n)
            open_.append([key, n, [x[1] for x in open_[: len(key) - 1]], None])
        if len(out) > 10_000:
            yield batch_of(out)
            out.clear()
    close(0)
    yield batch_of(out)


def _ordered(phrases: DataFrame, key: Column) -> DataFrame:
    """(lang, key, n, parts, more) for each phrase in the order of key, whole over the edges of ranges."""
    tasks = max(1, int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    stream = phrases.select("lang", key.alias("key"), "n").repartitionByRange(tasks, "lang", "key").sortWithinPartitions("lang", "key")
    passed = cut(stream.mapInArrow(_along, "lang string, key array<string>, n long, parts array<long>, more long"))
    # phrases that were open where a range begins: no more than LONGEST - 1 a range
    handed = cut(passed.where("n IS NULL").groupBy("lang", "key").agg(F.max("more").alias("handed")))
    held = cut(passed.where("n IS NOT NULL").join(F.broadcast(handed), ["lang", "key"], "left").select("lang", "key", "n", "parts", F.greatest("more", "handed").alias("more")))
    counts = held.join(F.broadcast(handed.select("lang", "key")), ["lang", "key"], "left_semi").groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("before"))
    filled = F.transform("parts", lambda p, k: F.coalesce(p, F.element_at("before", F.slice("key", 1, k + 1))))
    return held.join(F.broadcast(counts), "lang", "left").select("lang", "key", "n", filled.alias("parts"), "more")


def _exact(x: Column) -> Column:
    return x.cast("decimal(19,0)")


@tidy
def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of two to four words."""
    docs = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    phrases, totals = phrase_counts(docs, least)
    split = phrases.select("lang", F.split("phrase", " ").alias("words"), "n")
    forward = _ordered(split, F.col("words")).where(F.size("key") > 1)
    backward = _ordered(split, F.reverse("words")).where(F.size("key") > 1)
    backward = backward.select("lang", F.reverse("key").alias("key"), F.col("parts").alias("ends"), F.col("more").alias("more_left"))
    both = forward.join(backward.hint("merge"), ["lang", "key"])
    longest = F.greatest("more", "more_left")  # a phrase inside a longer one is inside one that is a word longer and as frequent
    kept = both.where(longest.isNull() | (_exact(longest) * 100 < _exact(F.col("n")) * SHARE))
    # cut after k + 1 words: parts[k] to the left, the last size - k - 1 words to the right
    sides = F.transform("parts", lambda p, k: F.struct(p.alias("l"), F.element_at("ends", F.size("key") - 1 - k).alias("r"), k.alias("k")))
    each = F.transform(sides, lambda s: F.struct(_quotient(F.col("n"), s.l, s.r).alias("score"), s.k.alias("k"), s.l.alias("l"), s.r.alias("r")))
    scored = kept.select("lang", F.array_join("key", " ").alias("phrase"), F.col("n").alias("a"), F.array_min(each).alias("m"))
    scored = scored.select("lang", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), F.col("m.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _quotient(a: Column, left: Column, right: Column) -> Column:
    """floor(2000000 * a / (left + right)), exactly."""
    return F.call_function("div", _exact(a) * F.lit(2_000_000).cast("decimal(7,0)"), _exact(left) + _exact(right))
