"""Operator 12: near duplicates by SimHash fingerprints and multi-index hashing.

A bit of a text's 64-bit fingerprint is set if it is set in over half of its shingles' hashes. Two
fingerprints that differ in at most two bits differ in at most one bit of their high half, or in two
of it and then in none of their low half. So each fingerprint looks up the Hamming ball of one bit
around its high half in a table of high halves, and its low half itself in a table of low halves;
what it meets there is verified on all 64 bits. Copies have one fingerprint, and only distinct
fingerprints are looked up.

A bucket of the table holds up to SMALL fingerprints as one row, so a lookup costs no more than that
many comparisons. Of a larger bucket only its size and the bits in which its members differ are
kept: whoever looks it up enumerates the rest of its own ball in these bits (no other bit can
differ inside the bucket, but for what the ball still allows) and finds whole fingerprints by an
equi-join. No pairs of a bucket meet, and no fingerprint has more than 2,080 others in its ball.

Defined results: null texts, and texts without words, have fingerprint zero and are linked like any
other; fewer words than a shingle are one shingle; a component is named by its smallest doc_id,
nulls last; repeated rows and doc_ids each get a row; empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densityflow.llm.common import cut, tidy
from densityflow.llm.near_dedup import components
from densityflow.llm.shingles import slices, split_words

WIDTH = 3
SEED = 42
#: Members up to which a bucket of the table is kept as one row.
SMALL = 64
LOW = 0xFFFFFFFF
#: Rows whose set bits are counted in bytes.
BYTE = 255


def shingle_hashes(words: list[bytes]) -> list[int]:
    """XXH64 of each window of words, joined by spaces."""
    if len(words) < WIDTH:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[: -WIDTH] + 1]
    of = xxhash.xxh64_intdigest
    return [of(text[a:b], SEED) for a, b in zip(starts.tolist(), ends[WIDTH - 1 :].tolist(), strict=True)]


def fingerprints(lists: list[list[int]]) -> np.ndarray:
    """One unsigned 64-bit number for each list of hashes."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    out = np.zeros(len(lists), dtype=np.uint64)
    if not sizes.sum():
        return out
    flat = np.fromiter((h for hs in lists for h in hs), np.uint64, int(sizes.sum()))
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    filled = np.flatnonzero(sizes)
    pieces = -(-sizes[filled] // BYTE)
    begins = np.cumsum(sizes[filled]) - sizes[filled]
    first = np.cumsum(pieces) - pieces
    steps = np.arange(pieces.sum()) - np.repeat(first, pieces)
    counts = np.add.reduceat(bits, np.repeat(begins, pieces) + steps * BYTE, axis=0, dtype=np.uint8)
    counts = np.add.reduceat(counts.astype(np.int64), first, axis=0)
    over = (2 * counts > sizes[filled][:, None]).astype(np.uint8)
    out[filled] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in slices(texts):
            marks = fingerprints([shingle_hashes(split_words(t)) for t in texts[a:b]])
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(marks.view(np.int64))], names=["doc_id", "fp"])


def _high(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def _low(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(LOW))


def _whole(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 32).bitwiseOR(low)


def _apart(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def _table(marks: DataFrame, half, other) -> DataFrame:
    """(key, members, same, differ): the buckets of one half. members is null in large ones; same are the
    bits of the other half that all members have set, differ those in which they differ."""
    keyed = marks.select(half(F.col("fp")).alias("key"), "fp", other(F.col("fp")).alias("rest"))
    sized = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_and("rest").alias("same"), F.bit_or("rest").alias("some"))
    sized = cut(sized.select("key", "n", "same", F.col("some").bitwiseXOR(F.col("same")).alias("differ")))
    small = keyed.join(sized.where(F.col("n") <= SMALL).hint("merge"), "key").groupBy("key", "same", "differ").agg(F.collect_list("fp").alias("members"))
    large = sized.where(F.col("n") > SMALL).select("key", "same", "differ", F.lit(None).cast("array<bigint>").alias("members"))
    return cut(small.unionByName(large))


def _bits(mask: Column) -> Column:
    each = F.array(*[F.lit(1 << i) for i in range(32)])
    return F.filter(each, lambda b: b.bitwiseAND(mask) != 0)


def _ones(base: Column, bits: Column) -> Column:
    return F.transform(bits, lambda b: base.bitwiseXOR(b))


def _twos(base: Column, bits: Column) -> Column:
    pairs = F.transform(bits, lambda b, k: F.transform(F.slice(bits, k + 2, F.greatest(F.size(bits) - k - 1, F.lit(0))), lambda c: base.bitwiseXOR(b).bitwiseXOR(c)))
    return F.flatten(pairs)


def links(marks: DataFrame) -> DataFrame:
    """(a, b): all pairs of the distinct fingerprints in marks (fp) that differ in one or two bits."""
    by_high, by_low = _table(marks, _high, _low), _table(marks, _low, _high)
    # the ball around the high half: itself, and each unset bit set; the other half of a pair sets the bit
    flips = F.array(F.lit(0), *[F.lit(1 << i) for i in range(32)])
    looked = marks.select("fp", F.explode(flips).alias("flip")).where(_high(F.col("fp")).bitwiseAND(F.col("flip")) == 0)
    looked = looked.select("fp", "flip", _high(F.col("fp")).bitwiseOR(F.col("flip")).alias("key"))
    met = looked.join(by_high.hint("merge"), "key")
    fp, flip = F.col("fp"), F.col("flip")
    once = lambda m: (flip != 0) | (m > fp)  # noqa: E731  both ends look up a high half that they share
    near = met.where("members IS NOT NULL").select("fp", F.explode(F.filter("members", lambda m: (_apart(m, fp) <= 2) & once(m))).alias("b"))
    # a large bucket: what is forced, and then as many more bits as the ball allows
    forced = _low(fp).bitwiseXOR(F.col("same")).bitwiseAND(F.bitwise_not(F.col("differ")))
    room = F.when(flip == 0, 2).otherwise(1) - F.bit_count(forced)
    wide = met.where("members IS NULL").select("fp", "flip", "key", _low(fp).bitwiseXOR(forced).alias("base"), _bits(F.col("differ")).alias("bits"), room.alias("room")).where("room >= 0")
    none = F.array().cast("array<bigint>")
    rest = F.concat(F.array("base"), F.when(F.col("room") >= 1, _ones(F.col("base"), F.col("bits"))).otherwise(none), F.when(F.col("room") >= 2, _twos(F.col("base"), F.col("bits"))).otherwise(none))
    wide = wide.select("fp", "flip", "key", F.explode(rest).alias("rest")).select("fp", "flip", _whole(F.col("key"), F.col("rest")).alias("b")).where(once(F.col("b"))).select("fp", "b")
    # equal low halves: the high halves differ in two bits
    own = by_low.where("members IS NOT NULL").select(F.explode("members").alias("fp"), "members")
    own = own.select("fp", F.explode(F.filter("members", lambda m: (_apart(m, fp) == 2) & (m > fp))).alias("b"))
    crowd = marks.join(by_low.where("members IS NULL").hint("merge"), _low(fp) == F.col("key"))
    crowd = crowd.select("fp", "key", F.explode(_twos(_high(fp), _bits(F.col("differ")))).alias("high")).select("fp", _whole(F.col("high"), F.col("key")).alias("b")).where("b > fp")
    found = wide.union(crowd).join(marks.select(F.col("fp").alias("_there")).hint("merge"), F.col("b") == F.col("_there"), "left_semi")
    return near.union(own).union(found).select(F.col("fp").alias("a"), "b")


@tidy
def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of docs; fp is a signed 64-bit number."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = cut(docs.mapInArrow(_signed, "doc_id long, fp long"))
    classes = cut(signed.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(cut(links(classes.select("fp"))))
    least = roots.join(classes, roots["node"] == classes["fp"]).groupBy("root").agg(F.min("first").alias("component"))
    named = cut(roots.join(least, "root").select(F.col("node").alias("fp"), "component"))
    of_class = classes.join(named, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    return signed.join(of_class, "fp", "left").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
