"""The language model against a model in memory that is given the same seating, and what it learns."""

import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from densityflow.llm import language_model as lm
from densityflow.llm.common import BATCH, small_batches
from densityflow.llm.shingles import split_words

ROWS = "doc_id long, text string, lang string, body string, part int, slice long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash", 1, 2) for i, t in rows], ROWS)


def tokens(text):
    return [*(text or "").encode().lower().split(), lm.END]


def brute(rows):
    """Scores where each cell has one table."""
    c2, c1, c0, words = (defaultdict(Counter) for _ in range(4))
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 == 1:
            continue
        u2 = u1 = lm.START
        for w in tokens(t):
            c2[u2, u1][w] += 1
            words[0][w] += 1
            u2, u1 = u1, w
    for (_, u1), cells in c2.items():
        for w in cells:
            c1[u1][w] += 1
    for cells in c1.values():
        for w in cells:
            c0[0][w] += 1
    all0, n, v = c0[0].total(), words[0].total(), len(words[0])

    d2 = lm.discount(*(sum(n == k for cells in c2.values() for n in cells.values()) for k in (1, 2)))

    def cell(c, d, strength, w, parent):
        return (max(c[w] - d, 0) + (strength + d * len(c)) * parent) / (strength + c.total())

    out = Counter()
    for i, t in rows:
        base = score = 0.0
        known = 0
        u2 = u1 = lm.START
        for w in tokens(t):
            base += math.log10((words[0][w] + 0.5) / (n + 0.5 * (v + 1))) if n else 0
            known += words[0][w] > 0
            p = (c0[0][w] - lm.D0) / (lm.T0 + all0) if c0[0][w] else (lm.T0 + lm.D0 * len(c0[0])) / (lm.T0 + all0)
            p = cell(c1[u1], lm.D1, lm.T1, w, p) if u1 in c1 else p
            p = cell(c2[u2, u1], d2, lm.T2, w, p) if (u2, u1) in c2 else p
            score += math.log10(p) if n else 0
            u2, u1 = u1, w
        out[i, len(tokens(t)), known, n, round(base, 6), round(score, 6)] += 1
    return out


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = " ".join(r.choice(vocabulary) for _ in range(30))
    rows = []
    for i in range(n):
        text = " ".join(vocabulary[int(300 * r.random() ** 3)] for _ in range(r.randrange(0, 80)))
        rows.append((i, text + (" " + passage if r.random() < 0.3 else "")))
    return rows


ODD = [(None, "no id here"), (None, None), (7001, None), (7002, ""), (7003, " \t\n\x0b "), (7004, "ÜNÏ cödé Aa AA aA"), (7005, "x " * 5000), (7006, "dup dup"), (7006, "dup dup"), (7006, "other text")]


@pytest.mark.parametrize("part_bytes", [700, 5_000, 10**9])
def test_scores_equal_a_model_in_memory(spark, part_bytes):
    rows = corpus(3, 150) + ODD
    out = lm.scored(table(spark, rows).repartition(5), gibbs=False, part_bytes=part_bytes).collect()
    got = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in out)
    want = brute(rows)
    assert sum(got.values()) == len(rows)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    for g, w in zip(sorted(got.elements(), key=key), sorted(want.elements(), key=key), strict=True):
        assert g[:4] == w[:4]
        assert g[4:] == pytest.approx(w[4:], abs=1e-5)


def test_every_hot_context_is_found(spark):
    rows = [(i, "a b " * 50 + " ".join(f"r{i}x{k}" for k in range(300))) for i in range(40)]
    hot = lm.hot_contexts(table(spark, rows).repartition(7).select("doc_id", "text"), 1 / 50)
    ab = lm.word_hashes([b"a", b"b"])
    assert set(ab.tolist()) == set(hot.words.tolist())
    assert set(hot.pairs.tolist()) == set(lm.pair_hash(ab, ab[::-1]).tolist())
    assert (hot.last >= 0).all()


def test_no_training_text_and_empty_table(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:4]
    out = lm.scored(table(spark, [(i, "some words") for i in held])).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out] == [(True, 3, 0, 0, 0.0, 0.0)] * 4
    assert lm.scored(table(spark, [(1, "x")]).where("false")).collect() == []


def test_tables_are_drawn_by_their_weights():
    rng = np.random.default_rng(1)
    d, a = 0.5, 0.7
    s = np.zeros((6, 6))
    s[0, 0] = 1
    for c in range(5):
        for t in range(6):
            s[c + 1, t] = max(c - d * t, 0) * s[c, t] + (s[c, t - 1] if t else 0)
    p = np.array([s[5, t] * a**t for t in range(1, 6)])
    drawn = lm.draw_tables(np.full(200_000, 5), np.full(200_000, a), d, rng)
    assert np.bincount(drawn, minlength=6)[1:] / len(drawn) == pytest.approx(p / p.sum(), abs=0.01)
    many = lm.draw_tables(np.array([1, 0, 5000, 200]), np.full(4, 0.5), d, rng)
    assert many[0] == 1
    assert many[1] == 0
    assert 1 <= many[2] <= 5000


def test_context_is_learned(spark):
    """Texts in which two words decide the next: the model beats the base by far."""
    r = random.Random(8)
    follow = {}
    rows = []
    for i in range(200):
        u2, u1, out = "s", "t", []
        for _ in range(60):
            w = r.choice(follow.setdefault((u2, u1), [f"v{r.randrange(50)}" for _ in range(2)]))
            out.append(w)
            u2, u1 = u1, w
        rows.append((i, " ".join(out)))
    got = lm.scored(table(spark, rows), part_bytes=20_000).where("held_out").collect()
    per_token = [sum(getattr(r, c) for r in got) / sum(r.n_tokens for r in got) for c in ("score", "base_score")]
    assert per_token[0] > per_token[1] / 2


def test_a_slice_holds_numbers_not_words():
    # as words, the tokens would take about a hundred bytes each
    texts = [" ".join(f"word{(7 * i + k) % 5000}" for k in range(400)) for i in range(500)] + [None, ""]
    lm.Slice(texts[:5])
    for ordered in (False, True):
        tracemalloc.start()
        s = lm.Slice(texts, ordered)
        _, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert peak < 50 * len(s.w)
        assert [s.words[k] for k in s.w] == [w for t in texts for w in tokens(t)]
        assert s.words[s.u2[0]] == s.words[s.u1[0]] == s.words[s.u2[1]] == lm.START and s.u1[1] == s.w[0]


def a_part(texts):
    hot = lm.Hot(*[np.empty(0, dtype=np.uint64)] * 3)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    rows = [r for b in lm._packer(np.array([0]), hot)(iter([batch])) for r in b.to_pylist()]
    body, _, once, twice = lm.merged([(r["slice"], r["n_docs"], r["body"]) for r in rows if r["n_docs"] >= 0], hot, 3)
    return lm.Part(body, lm.discount(once, twice))


def test_only_cells_of_several_customers_are_drawn(monkeypatch):
    part = a_part([t for _, t in corpus(5, 60)])
    drawn = []
    draw = lm.draw_tables
    monkeypatch.setattr(lm, "draw_tables", lambda c, *rest: drawn.append(c) or draw(c, *rest))
    part.sweep(part.first_guess(), np.random.default_rng(2))
    assert len(drawn[0]) == (part.c > 1).sum() < len(part.c) / 2
    assert (drawn[0] > 1).all()
    assert len(drawn[1]) == (part.by_pair(part.c)[: part.both] > 1).sum() < len(part.c1)
    # and the sums that are kept are those of the whole seating
    assert (part.c1 == np.bincount(part.pair, weights=part.t2)).all()
    assert (part.rest_t == np.bincount(part.rest, weights=part.t2)).all()
    assert (part._totals()[1] == np.bincount(part.word, weights=part.t1)).all()


def test_mean_of_sweeps_is_the_mean_of_their_probabilities():
    one, other = (a_part([t for _, t in corpus(6, 60)]) for _ in range(2))
    p, rng = one.first_guess(), np.random.default_rng(4)
    got = one.mean_of_cells(p, np.random.default_rng(4), 3)
    want = np.zeros(len(got))
    for _ in range(3):
        other.sweep(p, rng)
        want += other.of_cells(p) / 3
    assert got == pytest.approx(want)


def test_words_of_arrow_texts():
    texts = ["".join(map(chr, range(256))) * 2, " \x1c ", "\x85x\xa0Y z\x0bq", "\n a\r\n\tB ", "", " \t\x0c", None, "Ü İ K"]
    s = lm.Slice(pa.array(["other", *texts])[1:])
    at = np.cumsum(s.lengths) - s.lengths
    for t, first, n in zip(texts, at, s.lengths, strict=True):
        assert [s.words[k] for k in s.w[first : first + n]] == [*split_words(t), lm.END]
    assert s.lines(np.array([0, 2, 1])) == b"\n".join(s.words[[0, 2, 1]])


def test_slices_are_cut_at_texts(monkeypatch):
    monkeypatch.setattr(lm, "SLICE_BYTES", 20)
    texts = ["x" * 30, None, "ü" * 9, "y" * 9, "", "z" * 60, "a", "b"]
    whole = pa.RecordBatch.from_pydict({"doc_id": list(range(8)), "text": texts})
    for cuts in ([0, 8], [0, 1, 4, 5, 8], list(range(9))):
        found = list(lm.slices_of(iter([whole.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)])))
        assert [i for i, _ in found] == [[0], [1, 2, 3], [4, 5], [6, 7]]
        assert [t for _, ts in found for t in ts.to_pylist()] == texts


def test_settings_are_put_back(spark):
    before = spark.conf.get(BATCH)
    with small_batches(spark):
        assert int(spark.conf.get(BATCH)) <= 1000
        with small_batches(spark):
            pass
        assert int(spark.conf.get(BATCH)) <= 1000
    assert spark.conf.get(BATCH) == before
