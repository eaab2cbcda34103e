"""Operator 8: hierarchical Pitman-Yor language model, and the log10 probability of every text.

Restaurants: one for each pair of words before a token, whose parent is that of the last word, whose
parent is the unigram restaurant over a diffuse base: what no training token used is one unknown word.
Contexts are whole words, and their number grows with the texts. Seating is kept as customers and
tables of each (restaurant, word) cell. Gibbs sampling draws the tables of each cell from their
conditional given the rest: generalised Stirling numbers weigh the seatings, and cells of more than
EXACT customers are seated one after another, those of very many in blocks of a BLOCK-th of the seated.
A cell's tables are the customers of its parent. After BURN sweeps, SAMPLES more give probabilities
that are averaged. Between rounds the restaurants above get the sampled customers; they are held
during a round, as the totals of a restaurant are during a sweep.

How it is spread out: tokens go, packed, to parts dealt by the word before them, so that a word's
restaurant and those of all pairs that end with it are in one part, with their totals. Parts have about
PART_BYTES of text: they grow in number, not in size. Contexts with more than about half a part's share
of all tokens are hot, at most MAX_HOT by their share; every one is found, as one of a quarter of that
share in some slice. Pairs that end with a hot word are dealt by both words, and tokens after a hot pair
by slices. The cells that then lack their restaurant, and all unigrams, live in parts by word: a part
asks these for the probabilities of its distinct items and sends its customers. Only the totals of
hot contexts and of the unigrams meet on the driver. Sums for texts come back by slice.
Nothing is sampled or pruned: counts are of all training tokens.

Defined results: null and empty texts consist of the end token; a null doc_id is a training text;
repeated rows each count and get their row; other columns are ignored; without training tokens both
scores are 0.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densityflow.llm.common import cut, drop, let_go, scratch_dir, small_batches
from densityflow.llm.shingles import mix

#: Discounts of single words and unigrams (that of pairs follows from the counts), and strengths.
D1, D0 = 0.6, 0.6
T2, T1, T0 = 1.0, 100.0, 1.0
PART_BYTES = 8_000_000
#: Small inputs still give every core a part of so much.
LEAST_BYTES = 2_000_000
SLICE_BYTES = 12_000_000
MAX_HOT = 65_536
MAX_BUCKETS = 50_000
EXACT, BLOCK = 64, 64
#: Cells of so few customers are drawn by sums of powers; larger ones by logarithms.
FEW = 16
ROUNDS, BURN, SAMPLES = 2, 2, 4
#: No word has a space.
START, END = b" s", b" e"
SEPARATORS = " \t\n\v\f\r"
#: Kinds of cells: both levels in the part; only the pair's; none.
BOTH, PAIR, NONE = 0, 1, 2
A = np.uint64(0x9E3779B97F4A7C15)


def discount(once: float, twice: float) -> float:
    """Of pairs' cells, by how many have one customer and two, within bounds."""
    return min(max(once / (once + 2 * twice), 0.1), 0.99) if once + twice else 0.8


def is_held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def word_hashes(words: list[bytes] | np.ndarray) -> np.ndarray:
    flat = np.empty(len(words), dtype=object)
    flat[:] = words
    return pd.util.hash_array(flat, categorize=False) if len(words) else np.empty(0, dtype=np.uint64)


def pair_hash(u2: np.ndarray, u1: np.ndarray) -> np.ndarray:
    return mix(mix(u2) + u1 * A)


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values; a sort takes a fraction of np.unique's time, which hashes."""
    values = np.sort(values)
    return values[groups(values)[0]]


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of values in the sorted array known, or -1."""
    if not len(known):
        return np.full(len(values), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def small(a: np.ndarray) -> np.ndarray:
    """a in the least unsigned type that holds it."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers or doubles, byte planes apart, compressed."""
    kinds = [x for a in arrays for x in (len(a), "BHILd".index("L" if a.dtype == np.uint64 else a.dtype.char))]
    head = np.array([len(arrays), *kinds], dtype=np.int64)
    planes = []
    for a in arrays:
        each = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize)
        planes += [each[:, k].tobytes() for k in range(a.itemsize)]
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + b"".join(planes))


def load(body: bytes | pa.Buffer) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    out, at = [], 8 + 16 * k
    for n, kind in np.frombuffer(raw, np.int64, 2 * k, 8).reshape(k, 2):
        dtype = np.dtype([np.uint8, np.uint16, np.uint32, np.uint64, np.float64][kind])
        planes = np.frombuffer(raw, np.uint8, int(n) * dtype.itemsize, at).reshape(dtype.itemsize, int(n))
        out.append(np.empty(int(n), dtype=dtype))
        each = out[-1].view(np.uint8).reshape(int(n), dtype.itemsize)
        for k, plane in enumerate(planes):
            each[:, k] = plane
        at += int(n) * dtype.itemsize
    return out


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted rows: the first of each group of equal keys, and each row's group."""
    if not len(keys[0]):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    new = np.zeros(len(keys[0]), dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def order_of(*keys: np.ndarray) -> np.ndarray:
    """Places of rows in the order of the keys, the first counting most; numbers of few bits are sorted as one."""
    bits = [int(k.max()).bit_length() if len(k) else 0 for k in keys]
    if sum(bits) > 63:
        return np.lexsort(keys[::-1])
    one = np.zeros(len(keys[0]), dtype=np.int64)  # in place, as these are the longest arrays there are
    for k, b in zip(keys, bits, strict=True):
        one <<= b
        one |= k
    return np.argsort(one)


def sizes_of(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.r_[first, n])


class Slice:
    """Tokens of some texts by numbers of their words (ranks, if ordered), with the two words before each."""

    def __init__(self, texts: pa.Array | list[str | None], ordered: bool = True):
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        # A-Z lower-cased, between just the six separators; without a word, a text has no list
        texts = pc.ascii_trim(pc.ascii_lower(texts), SEPARATORS)
        lists = pc.ascii_split_whitespace(pc.if_else(pc.equal(texts, ""), None, texts))
        self.lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        coded = lists.flatten().dictionary_encode()
        del texts, lists
        # each word's number stands for it from here on
        found = coded.dictionary.cast(pa.large_binary())
        end, start = len(found), len(found) + 1
        found = pa.concat_arrays([found, pa.array([END, START], pa.large_binary())])
        self.w = np.full(int(self.lengths.sum()), end, dtype=np.int32)
        inside = np.ones(len(self.w), dtype=bool)
        inside[np.cumsum(self.lengths) - 1] = False
        self.w[inside] = coded.indices.to_numpy()
        del coded, inside
        if ordered:
            # like beginnings stand together, which compresses
            order = np.argsort(np.array(found.to_pylist(), dtype="S8").view(">u8"))
            found = found.take(pa.array(order))
            rank = np.empty(len(order), dtype=np.int32)
            rank[order] = np.arange(len(order))
            self.w, start = rank[self.w], rank[start]
        self.found = found
        first = np.cumsum(self.lengths) - self.lengths
        self.u1 = np.r_[np.int32(start), self.w[:-1]]
        self.u1[first] = start
        self.u2 = np.r_[np.int32(start), self.u1[:-1]]
        self.u2[first] = start
        self.hash = word_hashes(self.words)
        pa.default_memory_pool().release_unused()

    @property
    def words(self) -> np.ndarray:
        return self.found.to_numpy(zero_copy_only=False)

    def lines(self, at: np.ndarray) -> bytes:
        """The words at these places, a line each."""
        one = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), self.found.take(pa.array(at)))
        return pc.binary_join(one, pa.scalar(b"\n", pa.large_binary()))[0].as_py()


def slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """(doc_ids, texts) of about SLICE_BYTES."""
    ids, texts, size = [], [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        first = 0
        while first < len(ends):
            before = int(ends[first - 1]) if first else 0
            # up to the row that fills the slice
            stop = min(int(np.searchsorted(ends, before + SLICE_BYTES - size)) + 1, len(ends))
            ids += batch.column(0)[first:stop].to_pylist()
            texts.append(batch.column(1)[first:stop].cast(pa.large_string()))
            size += int(ends[stop - 1]) - before
            first = stop
            if size >= SLICE_BYTES:
                out = ids, pa.concat_arrays(texts)
                ids, texts, size = [], [], 0
                yield out
    if ids:
        yield ids, pa.concat_arrays(texts)


def _heavy(share: float):
    """Rows (level, key, last, n): contexts with at least a quarter of the share of a slice's tokens, and
    their last words; level 0 counts all."""

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices_of(batches):
            s = Slice(texts, False)
            least = share / 4 * len(s.w)
            n1 = np.bincount(s.u1, minlength=len(s.hash))
            u1 = np.flatnonzero(n1 >= least)
            # a pair has no more than either of its words, of which few have so many; they are numbered from 1
            rank = np.zeros(len(s.hash), dtype=np.int32)
            rank[u1] = np.arange(1, len(u1) + 1)
            near = np.flatnonzero(rank[s.u1] > 0)
            pairs = rank[s.u2[near]].astype(np.int64) << 32 | rank[s.u1[near]]
            pairs = np.sort(pairs[pairs >> 32 > 0])
            first, _ = groups(pairs)
            n2 = sizes_of(first, len(pairs))
            pairs, n2 = pairs[first][n2 >= least], n2[n2 >= least]
            last = s.hash[u1[(pairs & 0xFFFFFFFF) - 1]]
            found = [(np.zeros(1), np.zeros(1), np.zeros(1), [len(s.w)])]
            found += [(np.full(len(u1), 1), s.hash[u1].view(np.int64), s.hash[u1].view(np.int64), n1[u1])]
            found += [(np.full(len(pairs), 2), pair_hash(s.hash[u1[(pairs >> 32) - 1]], last).view(np.int64), last.view(np.int64), n2)]
            level, key, last, n = (np.concatenate([np.asarray(y, dtype=np.int64) for y in x]) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(level.astype(np.int32)), pa.array(key), pa.array(last), pa.array(n)], names=["level", "key", "last", "n"])

    return heavy


class Hot:
    """Hot words and pairs. A word has the code 1 + its place, a pair one after all words'; 0 is none.

    A hot pair's last word is hot as well: it has the share wherever the pair has it."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, last: np.ndarray):
        self.words = np.unique(words)
        self.pairs, at = np.unique(pairs, return_index=True)
        self.last = among(last[at], self.words)

    def __len__(self) -> int:
        return 1 + len(self.words) + len(self.pairs)


def hot_contexts(docs: DataFrame, share: float) -> Hot:
    found = docs.mapInArrow(_heavy(share), "level int, key long, last long, n long").groupBy("level", "key").agg(F.sum("n").alias("n"), F.first("last").alias("last"))
    rows = cut(found)
    total = (rows.where("level = 0").first() or {"n": 0})["n"]
    # a context of the share has three quarters of it in slices where it has a quarter; so at most 4 / 3 of 1 / share
    much = rows.where((F.col("level") > 0) & (F.col("n") >= 0.75 * share * total)).select("level", "key", "last").toPandas()
    drop(rows)
    of = lambda level, name: much.loc[much.level == level, name].to_numpy(dtype=np.int64).view(np.uint64)
    return Hot(of(1, "key"), of(2, "key"), of(2, "last"))


def deal_ids(spark: SparkSession, n: int) -> np.ndarray:
    """n numbers that Spark's hash spreads over n partitions, one for each."""
    k = F.pmod(F.hash("id"), F.lit(n))
    rows = spark.range(0, 32 * n + 64).groupBy(k.alias("k")).agg(F.min("id").alias("id")).toPandas()
    out = np.arange(n, dtype=np.int64)
    out[rows["k"].to_numpy()] = rows["id"].to_numpy()
    return out


def _packer(part_ids: np.ndarray, hot: Hot):
    """Rows (part, slice, n_docs, body): a slice's tokens for a part; n_docs is -1 where body has the
    slice's texts themselves."""
    parts = np.uint64(len(part_ids))

    def rows_of(slice_id: int, ids: list, texts: pa.Array):
        s = Slice(texts)
        held = np.array([is_held_out(d) for d in ids], dtype=np.int64)
        known = np.array([d is not None for d in ids])
        yield int(part_ids[slice_id % len(part_ids)]), -1, dump(np.array([d or 0 for d in ids], dtype=np.int64).view(np.uint64), known.astype(np.uint8), held.astype(np.uint8))
        doc = np.repeat((np.arange(len(ids)) * 2 + held).astype(np.int32), s.lengths)
        # 3 * part + kind: a word's, but after hot words the pair's
        part = small((mix(s.hash) % parts).astype(np.int64) * 3 + 2)[s.u1]
        part -= part.dtype.type(2 - BOTH)
        after = np.flatnonzero((among(s.hash, hot.words) >= 0)[s.u1])
        pair = pair_hash(s.hash[s.u2[after]], s.hash[s.u1[after]])
        part[after] = (pair % parts).astype(np.int64) * 3 + PAIR
        none = after[among(pair, hot.pairs) >= 0]
        part[none] = (mix(s.hash[s.w[none]] + np.array([slice_id], dtype=np.uint64) * A) % parts).astype(np.int64) * 3 + NONE
        del pair, after, none
        order = order_of(s.u1, s.w, s.u2)
        order = order[np.argsort(part[order], kind="stable")]
        part, u1, w, u2, doc = part[order], s.u1[order], s.w[order], s.u2[order], doc[order]
        s.u1 = s.w = s.u2 = None
        del order
        cuts, _ = groups(part // 3)
        n_words = len(s.hash)
        place = np.empty(n_words, dtype=np.int32)
        for a, b in zip(cuts, np.r_[cuts[1:], len(part)], strict=True):
            first, _ = groups(part[a:b], u1[a:b], w[a:b], u2[a:b])
            runs, _ = groups(part[a:b][first], u1[a:b][first])
            own = u1[a:b][first][runs], w[a:b][first], u2[a:b][first]
            if n_words < 256 * (b - a):
                seen = np.zeros(n_words, dtype=bool)
                for x in own:
                    seen[x] = True
                used = np.flatnonzero(seen)
            else:
                used = distinct(np.concatenate(own))
            place[used] = np.arange(len(used))
            text = np.frombuffer(s.lines(used), dtype=np.uint8)
            lead, *cells = (small(place[x]) for x in own)
            yield int(part_ids[part[a] // 3]), len(ids), dump(text, small(part[a:b][first][runs] % 3), lead, small(sizes_of(runs, len(first))), *cells, small(sizes_of(first, b - a)), small(doc[a:b]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        slice_id = (context.partitionId() if context else 0) << 20
        for ids, texts in slices_of(batches):
            rows = list(rows_of(slice_id, ids, texts))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([slice_id] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "slice", "n_docs", "body"])
            slice_id += 1

    return pack


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """Neighbouring rows of one first column: its value, and the other columns."""
    key, rows = None, []
    for batch in batches:
        for k, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and k != key:
                yield key, rows
                rows = []
            key = k
            rows.append(rest)
    if rows:
        yield key, rows


def merged(pieces: list[tuple[int, int, bytes]], hot: Hot, askers: int) -> tuple[bytes, bytes, int, int]:
    """Cells of a part, the texts of its tokens, and how many pairs' cells have one customer and two. pieces: (slice, its number of texts, packed tokens)."""
    loaded = [load(b) for _, _, b in pieces]
    hashes = [word_hashes(x[0].tobytes().split(b"\n")) for x in loaded]
    known, rank = np.unique(np.concatenate(hashes), return_inverse=True)
    rank = rank.astype(np.int32)
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]
    at = first_doc = 0
    for (_, kinds, u1, cells, w, u2, per_cell, doc), h, (_, n, _) in zip(loaded, hashes, pieces, strict=True):
        own = rank[at : at + len(h)]
        at += len(h)
        for c, x in zip(cols, (np.repeat(kinds, cells), np.repeat(own[u1], cells), own[w], own[u2], per_cell.astype(np.int64), doc.astype(np.int64) + 2 * first_doc), strict=True):
            c.append(x)
        first_doc += n
    kind, u1, w, u2, per_cell, doc = map(np.concatenate, cols)
    del cols, loaded, hashes, rank
    order = order_of(kind, u1, w, u2)
    # tokens follow their cells
    start = np.cumsum(per_cell) - per_cell
    per = per_cell[order]
    doc = doc[np.repeat(start[order] - (np.cumsum(per) - per), per) + np.arange(len(doc))]
    kind, u1, w, u2 = kind[order], u1[order], w[order], u2[order]
    first, _ = groups(kind, u1, w, u2)
    tokens = np.add.reduceat(per, first) if len(first) else per
    learned = np.add.reduceat(1 - (doc & 1), np.cumsum(tokens) - tokens)
    kind, u1, w, u2 = kind[first], u1[first], w[first], u2[first]
    # pairs of a word before and a word; where no restaurant is here, a pair is a cell
    lead, pair = groups(kind, u1, w, np.where(kind == NONE, u2, 0))
    rests = np.unique(u2[kind != NONE].astype(np.int64) << 30 | u1[kind != NONE], return_inverse=True)[1]
    k1, w1 = kind[lead], known[w[lead]]
    code = np.zeros(len(lead), dtype=np.int64)
    code[k1 == PAIR] = 1 + among(known[u1[lead][k1 == PAIR]], hot.words)
    code[k1 == NONE] = 1 + len(hot.words) + among(pair_hash(known[u2[lead][k1 == NONE]], known[u1[lead][k1 == NONE]]), hot.pairs)
    to = (mix(w1) % np.uint64(askers)).astype(np.int64)
    order = order_of(to, w[lead], code)  # words are ranked by their hashes
    head, item = groups(to[order], w1[order], code[order])
    item_of = np.empty(len(lead), dtype=np.int64)
    item_of[order] = item
    runs, _ = groups(u1[lead[k1 == BOTH]])
    counts = np.array([(kind == k).sum() for k in range(3)] + [(k1 == k).sum() for k in range(3)], dtype=np.uint64)
    slices = np.array([s for s, _, _ in pieces], dtype=np.int64).view(np.uint64)
    texts = np.array([n for _, n, _ in pieces], dtype=np.uint64)
    cells = dump(counts, small(sizes_of(lead, len(kind))), small(rests), small(tokens), small(learned), small(sizes_of(runs, int(counts[3]))), small(item_of), w1[order][head], small(code[order][head]), small(sizes_of(groups(to[order][head])[0], len(head))), small(to[order][head][groups(to[order][head])[0]]))
    own = learned[kind != NONE]
    return cells, dump(small(doc), slices, texts), int((own == 1).sum()), int((own == 2).sum())


def _merge(hot: Hot, askers: int):
    """Rows (part, slice, body, docs, once, twice): a part's cells (slice -1), and the slices' texts."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in by_key(batches):
            own = [(s, n, b) for s, n, b in rows if n >= 0]
            out = [(part, s, b, b"", 0, 0) for s, n, b in rows if n < 0]
            rows.clear()
            if own:
                out.append((part, -1, *merged(own, hot, askers)))
            for row in out:
                types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["part", "slice", "body", "docs", "once", "twice"])

    return merge


@lru_cache(maxsize=4)
def log_stirling(d: float) -> np.ndarray:
    """log S[c, t], generalised Stirling numbers of discount d up to EXACT."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(EXACT):
            t = np.arange(EXACT + 1)
            stay = out[c] + np.log(np.maximum(c - d * t, 0))
            out[c + 1] = np.logaddexp(stay, np.r_[-np.inf, out[c, :-1]])
    return out


def draw_tables(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of cells of c customers, a new table having the weight a."""
    t = np.minimum(c, 1)
    many = np.flatnonzero(c > 1)
    if not len(many):
        return t
    table = log_stirling(d)
    many = many[np.argsort(c[many], kind="stable")]
    first, _ = groups(c[many])
    for i, j in zip(first, np.r_[first[1:], len(many)], strict=True):
        at, n = many[i:j], int(c[many[i]])
        if n > EXACT:
            at = many[i:]
            break
        if n <= FEW:
            ways, weight, power = np.exp(table[n, 1 : n + 1]), a[at], 1.0
            upto = [ways[0]]
            for x in ways[1:]:
                power = power * weight
                upto.append(upto[-1] + x * power)
            drawn = rng.random(len(at)) * upto[-1]
            t[at] = 1 + sum((x < drawn).astype(t.dtype) for x in upto[:-1])
            continue
        k = np.arange(1, n + 1)
        logs = table[n, 1 : n + 1] + np.log(np.maximum(a[at], 1e-300))[:, None] * k
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        upto = np.cumsum(p, axis=1)
        t[at] = 1 + (upto < rng.random(len(at))[:, None] * upto[:, -1:]).sum(axis=1)
    if n > EXACT:
        whole, weight = c[at].astype(np.float64), a[at]
        seated, tables = np.ones(len(at)), np.ones(len(at))
        while (seated < whole).any():
            grow = np.minimum(np.maximum(1.0, np.floor(seated / BLOCK)), whole - seated)
            rate = weight / np.maximum(weight + seated - d * tables, 1e-9)
            new = np.where(grow <= 1, rng.random(len(at)) < rate, rng.binomial(grow.astype(np.int64), np.minimum(rate, 1.0)))
            tables, seated = tables + np.where(grow > 0, new, 0), seated + grow
        t[at] = np.minimum(tables, whole).astype(t.dtype)
    return t


def tables_of(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator | None) -> np.ndarray:
    """Drawn tables, or, without a generator, one for each cell that has customers."""
    return np.minimum(c, 1) if rng is None else draw_tables(c, a, d, rng)


def predictive(c, t, d: float, strength: float, all_c, all_t, parent):
    """Probability of a word in a restaurant."""
    return (np.maximum(c - d * t, 0) + (strength + d * all_t) * parent) / (strength + all_c)


class Part:
    """Cells of a part, and the seating at the levels that it has."""

    def __init__(self, body: bytes, d2: float):
        self.d2 = d2
        counts, cells, rest, tokens, learned, pairs, item, self.words, code, asked, to = load(body)
        counts = counts.astype(np.int64)
        self.own = n = int(counts[0] + counts[1])  # cells whose pair's restaurant is here; they come first
        self.both = int(counts[3])  # pairs whose word's restaurant is here
        self.cells = cells.astype(np.int64)
        self.begin = np.cumsum(self.cells) - self.cells
        self.rest, self.tokens, self.c = rest.astype(np.int32), tokens, learned.astype(np.int32)
        self.word = np.repeat(np.arange(len(pairs)), pairs)
        self.item, self.code = item.astype(np.int64), code
        self.asked, self.to = asked.astype(np.int64), to.astype(np.int64)
        self.c2 = np.bincount(self.rest, weights=self.c[:n])
        self.t2 = np.minimum(self.c, 1)
        # only cells of several customers are drawn again; what the others add to their restaurants stays
        many = np.flatnonzero(self.c[:n] > 1)
        self.many = many[np.argsort(self.c[many], kind="stable")]
        self.many_pair, self.many_rest = self.pair[self.many], self.rest[self.many].astype(np.int64)
        single = self.t2.copy()
        single[self.many] = 0
        self.single_rest = np.bincount(self.rest, weights=single[:n], minlength=len(self.c2))
        self.single_pair = self.by_pair(single)[: self.both]
        # of pairs above likewise
        self.more = np.flatnonzero(self.by_pair(self.c)[: self.both] > 1)
        self.more_word = self.word[self.more]
        self.t1 = None
        self._up()
        single = np.minimum(self.c1, 1)
        single[self.more] = 0
        self.single_word = np.bincount(self.word, weights=single, minlength=len(pairs))
        self.t1 = np.minimum(self.c1, 1)

    @property
    def pair(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.cells)), self.cells)

    def by_pair(self, of_cells: np.ndarray) -> np.ndarray:
        return np.add.reduceat(of_cells, self.begin, dtype=np.int64)

    def _up(self) -> None:
        t = self.t2[self.many]
        self.rest_t = self.single_rest + np.bincount(self.many_rest, weights=t, minlength=len(self.c2))
        self.c1 = (self.single_pair + np.bincount(self.many_pair, weights=t, minlength=len(self.item))[: self.both]).astype(np.int64)

    def _totals(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of words' restaurants."""
        c, t = (self.single_word + np.bincount(self.more_word, weights=x[self.more], minlength=len(self.single_word)) for x in (self.c1, self.t1))
        return c, t

    def first_guess(self) -> np.ndarray:
        """Of items, by this part's own tokens."""
        n = self.by_item(self.by_pair(self.c))
        return (n + 0.5) / (n.sum() + 0.5 * (len(n) + 1))

    def by_item(self, of_pairs: np.ndarray) -> np.ndarray:
        return np.bincount(self.item, weights=of_pairs, minlength=len(self.words))

    def sweep(self, p: np.ndarray, rng: np.random.Generator | None) -> None:
        if rng is None:  # every cell that has customers keeps its one table
            return
        of_pair = self.of_pairs(p, self.many_pair)
        self.t2[self.many] = draw_tables(self.c[self.many], (T2 + self.d2 * self.rest_t[self.many_rest]) * of_pair, self.d2, rng)
        t1 = self._totals()[1]
        self._up()
        self.t1[self.more] = draw_tables(self.c1[self.more], (T1 + D1 * t1[self.more_word]) * p[self.item[self.more]], D1, rng)

    def of_pairs(self, p: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Probabilities in the restaurants above the pairs', of all pairs or of those at some places."""
        of_pair = p[self.item if at is None else self.item[at]]
        here = slice(0, self.both) if at is None else np.flatnonzero(at < self.both)
        pair = here if at is None else at[here]
        c1, t1 = self._totals()
        word = self.word[pair]
        of_pair[here] = predictive(self.c1[pair], self.t1[pair], D1, T1, c1[word], t1[word], of_pair[here])
        return of_pair

    def of_cells(self, p: np.ndarray) -> np.ndarray:
        return self._of_cells(self._from_above(p), self.t2[: self.own])

    def mean_of_cells(self, p: np.ndarray, rng: np.random.Generator | None, samples: int) -> np.ndarray:
        """The mean of of_cells after each of some sweeps."""
        above, t2 = np.zeros(len(self.c)), self.t2[: self.own].astype(np.float64)
        t2[self.many] = 0
        for _ in range(samples):
            self.sweep(p, rng)
            above += self._from_above(p)
            t2[self.many] += self.t2[self.many]
        t2[self.many] /= samples
        return self._of_cells(above / samples, t2)

    def _from_above(self, p: np.ndarray) -> np.ndarray:
        """What cells get from their parents, by the weight of a new table where the pair's restaurant is here."""
        out = np.repeat(self.of_pairs(p), self.cells)
        out[: self.own] *= (T2 + self.d2 * self.rest_t)[self.rest]
        return out

    def _of_cells(self, above: np.ndarray, t2: np.ndarray) -> np.ndarray:
        n = self.own
        above[:n] = (self.c[:n] - self.d2 * t2 + above[:n]) / (T2 + self.c2)[self.rest]
        return above

    def customers(self) -> tuple[np.ndarray, np.ndarray]:
        """That the items get, and their training tokens."""
        n = self.by_pair(np.r_[self.t2[: self.own], self.c[self.own :]])
        n[: self.both] = self.t1
        return self.by_item(n).astype(np.int64), self.by_item(self.by_pair(self.c)).astype(np.int64)


def generator(gibbs: bool, *seed: int) -> np.random.Generator | None:
    return np.random.default_rng([abs(s) for s in seed]) if gibbs else None


def _replies(rows: list[dict], asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities and training tokens of a part's items, in the order in which it asked."""
    bodies = {r["to"]: r["body"] for r in rows}
    loaded = [load(bodies[to]) for to in asked.tolist()]
    return np.concatenate([x[0] for x in loaded]), np.concatenate([x[1] for x in loaded]).astype(np.int64)


def _ask(ask_ids: np.ndarray, round_: int, gibbs: bool, d2: float):
    """Rows (to, part, body): a part's items, their customers and training tokens."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, p = batch.column(0)[row].as_py(), Part(batch.column(1)[row].as_buffer(), d2)
                chance = _replies(batch.column(2)[row].as_py(), ask_ids[p.to])[0] if batch.num_columns > 2 else p.first_guess()
                rng = generator(gibbs, part, round_)
                for _ in range(BURN):
                    p.sweep(chance, rng)
                customers, learned = p.customers()
                ends = np.cumsum(p.asked)
                bodies = [dump(p.words[a:b], small(p.code[a:b]), small(customers[a:b]), small(learned[a:b])) for a, b in zip(ends - p.asked, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ask_ids[p.to]), pa.array([part] * len(bodies), pa.int64()), pa.array(bodies, pa.binary())], names=["to", "part", "body"])
                del p, chance, bodies
                pa.default_memory_pool().release_unused()

    return ask


def _asked(hot: Hot):
    """Rows (to, body): the items of a part by word, and who asked for which."""
    words = len(hot.words)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for to, rows in by_key(batches):
            loaded = [load(b) for _, b in rows]
            w = np.concatenate([x[0] for x in loaded])
            known, rank = np.unique(w, return_inverse=True)
            asked = rank.astype(np.int64) << 32 | np.concatenate([x[1] for x in loaded]).astype(np.int64)
            # every item's parents are items
            items = distinct(np.r_[asked, (asked >> 32) << 32])
            pairs = items[(items & 0xFFFFFFFF) > words]
            items = distinct(np.r_[items, (pairs >> 32) << 32 | parents(hot)[pairs & 0xFFFFFFFF]])
            at = np.searchsorted(items, asked)
            sums = [np.bincount(at, weights=np.concatenate([x[k] for x in loaded]), minlength=len(items)).astype(np.int64) for k in (2, 3)]
            sizes = np.array([len(x[0]) for x in loaded], dtype=np.int64)
            delta = np.diff(at, prepend=0)
            delta[np.cumsum(sizes) - sizes] = at[np.cumsum(sizes) - sizes]
            body = dump(small(items >> 32), small(items & 0xFFFFFFFF), small(sums[0]), small(sums[1]), np.array([p for p, _ in rows], dtype=np.int64).view(np.uint64), small(sizes), small(delta))
            yield pa.RecordBatch.from_arrays([pa.array([to], pa.int64()), pa.array([body], pa.binary())], names=["to", "body"])

    return gather


def parents(hot: Hot) -> np.ndarray:
    """Each code's parent: a hot pair's is its last word, which is hot as well."""
    out = np.zeros(len(hot), dtype=np.int64)
    out[1 + len(hot.words) :] = 1 + hot.last
    return out


class Upper:
    """Items of a part by word: unigrams, cells of hot words and of hot pairs."""

    def __init__(self, body: bytes, hot: Hot, d2: float):
        self.d2 = d2
        word, code, sent, learned, self.parts, self.sizes, delta = load(body)
        self.word, self.code, self.sent, learned = (x.astype(np.int64) for x in (word, code, sent, learned))
        delta = delta.astype(np.int64)
        ends = np.cumsum(self.sizes.astype(np.int64))
        upto = np.cumsum(delta)
        begin = ends - self.sizes.astype(np.int64)
        self.at = upto - np.repeat(upto[begin] - delta[begin], self.sizes.astype(np.int64))
        n_words = len(hot.words)
        self.pair, self.hot = self.code > n_words, (self.code > 0) & (self.code <= n_words)
        key = self.word << 32
        items = key | self.code
        self.up = np.searchsorted(items, np.where(self.pair, key | parents(hot)[self.code], key))
        self.one = np.flatnonzero(self.code == 0)
        self.learned = np.bincount(self.word, weights=learned, minlength=len(self.one))
        self.c, self.t = self.sent.copy(), np.zeros(len(self.sent), dtype=np.int64)

    def seat(self, totals: dict, rng: np.random.Generator | None) -> None:
        """Tables from the pairs' cells upwards, given the totals; without totals, one a cell."""
        p = self.probabilities(totals) if totals else np.ones(len(self.c))
        c = self.sent.copy()
        for which, d, strength in ((self.pair, self.d2, T2), (self.hot, D1, T1)):
            at = np.flatnonzero(which)
            weight = (strength + d * totals["t"][self.code[at]]) * p[self.up[at]] if totals else np.ones(len(at))
            self.t[at] = tables_of(c[at], weight, d, rng if totals else None)
            c += np.bincount(self.up[at], weights=self.t[at], minlength=len(c)).astype(np.int64)
        self.c = c

    def probabilities(self, totals: dict) -> np.ndarray:
        c, t = totals["c"], totals["t"]
        p = np.empty(len(self.c))
        unknown = (T0 + D0 * totals["words"]) / (T0 + c[0])
        p[self.one] = np.where(self.c[self.one] > 0, (self.c[self.one] - D0) / (T0 + c[0]), unknown)
        for which, d, strength in ((self.hot, D1, T1), (self.pair, self.d2, T2)):
            k = self.code[which]
            p[which] = predictive(self.c[which], self.t[which], d, strength, c[k], t[k], p[self.up[which]])
        return p

    def sums(self, size: int) -> list[tuple[str, np.ndarray]]:
        used = self.c[self.one] > 0
        of_pairs = self.sent[self.pair]
        few = [("once", np.array([(of_pairs == 1).sum()])), ("twice", np.array([(of_pairs == 2).sum()]))]
        return [*few, ("c", np.bincount(self.code, weights=self.c, minlength=size)), ("t", np.bincount(self.code, weights=self.t, minlength=size)), ("words", np.array([used.sum()])), ("vocabulary", np.array([(self.learned > 0).sum()])), ("tokens", np.array([self.learned.sum()]))]


def _seats(body: bytes, to: int, hot: Hot, past: list[dict], round_: int, gibbs: bool, d2: float) -> Upper:
    """The seating after a sweep for each of the past totals: drawn again, as the seeds are the same."""
    u = Upper(body, hot, d2)
    u.seat({}, None)
    for k, totals in enumerate(past):
        u.seat(totals, generator(gibbs, to, round_, k, 1))
    return u


def _totals(hot: Hot, past: list[dict], round_: int, gibbs: bool, d2: float):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for to, rows in by_key(batches):
            found = _seats(rows[0][0], to, hot, past, round_, gibbs, d2).sums(len(hot))
            found = [(k, i, x[i]) for k, x in found for i in np.flatnonzero(x)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([int(f[1]) for f in found], pa.int64()), pa.array([float(f[2]) for f in found], pa.float64())], names=["kind", "at", "n"])

    return sums


def _reply(hot: Hot, past: list[dict], round_: int, gibbs: bool, d2: float):
    """Rows (part, to, body): probabilities and training tokens of the items that a part asked for."""

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for to, rows in by_key(batches):
            u = _seats(rows[0][0], to, hot, past[:-1], round_, gibbs, d2)
            p, learned = u.probabilities(past[-1]), u.learned.astype(np.int64)[u.word]
            ends = np.cumsum(u.sizes.astype(np.int64))
            bodies = [dump(p[u.at[a:b]], small(learned[u.at[a:b]])) for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(u.parts.view(np.int64)), pa.array([to] * len(bodies), pa.int64()), pa.array(bodies, pa.binary())], names=["part", "to", "body"])

    return reply


def _scores(ask_ids: np.ndarray, tokens: float, vocabulary: float, gibbs: bool, d2: float):
    """Rows (slice, kind 1, body): tokens, known tokens, base and model score that a part adds to texts."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, p = batch.column(0)[row].as_py(), Part(batch.column(1)[row].as_buffer(), d2)
                chance, learned = _replies(batch.column(3)[row].as_py(), ask_ids[p.to])
                rng = generator(gibbs, part, 99)
                for _ in range(BURN):
                    p.sweep(chance, rng)
                mean = p.mean_of_cells(chance, rng, SAMPLES)
                base = np.log10((learned + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
                logs = np.log10(np.maximum(mean, 1e-300, out=mean), out=mean)
                item, per, cells = p.item, p.tokens.astype(np.int64), p.cells
                del p, mean
                doc, slices, texts = load(batch.column(2)[row].as_buffer())
                seen = np.bincount(doc >> 1, minlength=1)  # of these texts, those without a token here are left out
                docs = np.flatnonzero(seen)
                n = len(docs)
                doc = (np.cumsum(seen > 0) - 1)[doc >> 1]
                of_pairs = (x[item] for x in ((learned > 0).astype(np.float64), base))
                sums = [np.bincount(doc, weights=np.repeat(x, per), minlength=n) for x in (*(np.repeat(x, cells) for x in of_pairs), logs)]
                every = np.bincount(doc, minlength=n)
                offset = np.r_[0, np.cumsum(texts.astype(np.int64))]
                at = np.searchsorted(docs, offset)
                bodies = [dump(small(np.diff(docs[a:b].astype(np.int64) - o, prepend=0)), small(every[a:b]), small(sums[0][a:b].astype(np.int64)), sums[1][a:b], sums[2][a:b]) for o, a, b in zip(offset, at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(slices.view(np.int64)), pa.array([1] * len(bodies), pa.int32()), pa.array(bodies, pa.binary())], names=["slice", "kind", "body"])
                del doc, logs, base, bodies
                pa.default_memory_pool().release_unused()

    return score


def _gather(tokens: int):
    """Rows by slice, its texts' row (kind 0) first: their sums over all parts."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches):
            ids, known, held = load(rows[0][1])
            n = len(held)
            sums = [np.zeros(n) for _ in range(4)]
            for _, body in rows[1:]:
                step, *values = load(body)
                at = np.cumsum(step.astype(np.int64))
                for s, v in zip(sums, values, strict=True):
                    s[at] += v
            scale = 1.0 if tokens else 0.0
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64), pa.int64(), mask=known == 0), pa.array(held == 1), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(np.full(n, tokens, dtype=np.int64)), pa.array(sums[2] * scale), pa.array(sums[3] * scale)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return gather


class Dealt:
    """A table stored in the shared folder in one bucket a part, so that joins by part move only the other side."""

    def __init__(self, df: DataFrame, buckets: int):
        self.spark, self.buckets = df.sparkSession, buckets
        self.name, path = f"lm_{uuid.uuid4().hex}", scratch_dir(df.sparkSession)
        with let_go(self.spark):
            # bodies are compressed already
            df.write.format("parquet").option("compression", "none").option("path", path).bucketBy(buckets, "part").saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def with_replies(self, replies: DataFrame | None, *more: str) -> DataFrame:
        """(part, body, more[, replies]) of the parts' cells."""
        cells = self.rows.where("slice < 0").select("part", "body", *more)
        if replies is None:
            return cells
        found = replies.repartition(self.buckets, "part").groupBy("part").agg(F.collect_list(F.struct("to", "body")).alias("replies"))
        return cells.join(found.hint("merge"), "part")

    def drop(self) -> None:
        drop(self.rows)
        self.spark.sql(f"DROP TABLE {self.name}")


def _collected(rows: DataFrame, size: int) -> dict:
    """Totals of the hot contexts and the unigrams."""
    out = {"c": np.zeros(size), "t": np.zeros(size)} | dict.fromkeys(("words", "vocabulary", "tokens", "once", "twice"), 0.0)
    for r in rows.groupBy("kind", "at").agg(F.sum("n").alias("n")).toPandas().itertuples():
        if r.kind in ("c", "t"):
            out[r.kind][r.at] = r.n
        else:
            out[r.kind] = r.n
    return out


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gibbs: bool = True, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each text.

    Without gibbs each cell has one table, which makes the scores a function of the counts."""
    with small_batches(docs.sparkSession):
        return _scored(docs, doc_id, text, gibbs, part_bytes)


def _scored(docs: DataFrame, doc_id: str, text: str, gibbs: bool, part_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / part_bytes), min(spark.sparkContext.defaultParallelism, size // LEAST_BYTES))
    hot = hot_contexts(docs, 1 / min(max(2 * n, 256), MAX_HOT))
    part_ids, askers = deal_ids(spark, n), max(1, n // 4)
    ask_ids = deal_ids(spark, askers)
    packed = docs.mapInArrow(_packer(part_ids, hot), "part long, slice long, n_docs int, body binary")
    dealt = packed.repartition(n, "part").sortWithinPartitions("part", "slice", "n_docs")
    parts = Dealt(dealt.mapInArrow(_merge(hot, askers), "part long, slice long, body binary, docs binary, once long, twice long"), min(n, MAX_BUCKETS))
    replies, totals = None, {"tokens": 0.0, "vocabulary": 0.0}
    once, twice = parts.rows.agg(F.coalesce(F.sum("once"), F.lit(0)), F.coalesce(F.sum("twice"), F.lit(0))).first()
    d2 = discount(once, twice)
    for k in range(ROUNDS):
        asks = parts.with_replies(replies).mapInArrow(_ask(ask_ids, k, gibbs, d2), "to long, part long, body binary")
        upper = cut(asks.repartition(askers, "to").sortWithinPartitions("to", "part").mapInArrow(_asked(hot), "to long, body binary"), "none")
        past: list[dict] = []
        for _ in range(BURN + 1):
            past.append(_collected(upper.mapInArrow(_totals(hot, past, k, gibbs, d2), "kind string, at long, n double"), len(hot)))
            d2 = discount(once + past[-1]["once"], twice + past[-1]["twice"])  # with the cells of hot pairs
        totals = past[-1]
        done = replies
        replies = cut(upper.mapInArrow(_reply(hot, past, k, gibbs, d2), "part long, to long, body binary"), "none")
        drop(upper, *([done] if done is not None else []))
    sums = parts.with_replies(replies, "docs").mapInArrow(_scores(ask_ids, totals["tokens"], totals["vocabulary"], gibbs, d2), "slice long, kind int, body binary")
    info = parts.rows.where("slice >= 0").select("slice", F.lit(0).alias("kind"), "body")
    # slices are numbered within the texts' partitions: neighbours go to neighbouring tasks
    tasks = 1 + (info.agg(F.max(F.shiftright("slice", 20))).first()[0] or 0)
    at = F.shiftright("slice", 20) * max(1, n // tasks) + F.col("slice").bitwiseAND(0xFFFFF)
    rows = info.unionByName(sums).repartitionById(max(n, 2), F.pmod(at, F.lit(max(n, 2))).cast("int")).sortWithinPartitions("slice", "kind")
    out = cut(rows.mapInArrow(_gather(int(totals["tokens"])), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    drop(replies)
    parts.drop()
    return out
