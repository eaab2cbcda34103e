"""Operators 11 to 13 against brute force on small tables."""

import hashlib
import random
from collections import Counter

import pytest
import xxhash
from matching import assert_same, rows

from densityflow.llm import phrases, queries, runs, simhash

SCHEMA = "doc_id long, text string, lang string, n string, key string, score string, fp string, runs string"


def docs_of(spark, texts, langs=None):
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, g, "x", "y", "z", "f", "r") for i, (t, g) in enumerate(zip(texts, langs, strict=True))], SCHEMA)


# ---- operator 11 --------------------------------------------------------------------------------


def brute_collocations(texts, langs, least, top):
    import re

    totals, f = Counter(), Counter()
    for text, lang in zip(texts, langs, strict=True):
        lang = "und" if lang is None else lang
        totals[lang] += 0
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    cand = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = []
    for (lang, ws), a in cand.items():
        inside = any(g == lang and len(long) > len(ws) and 100 * c >= 80 * a and any(long[i : i + len(ws)] == ws for i in range(len(long))) for (g, long), c in cand.items())
        if not inside:
            score, _, left, right = min((2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
            out.append((lang, " ".join(ws), a, left, right, totals[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranked, seen = [], Counter()
    for lang, phrase, a, left, right, n, score in out:
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase, a, left, right, n, score))
    return ranked


@pytest.mark.parametrize("parts", [1, 7])
def test_collocations_against_brute_force(spark, parts):
    rng = random.Random(3)
    vocabulary = ["a", "b", "c", "d", "é", "a\x01", "Über", "　x", "\U0001f600"]
    texts, langs = [], []
    for _ in range(60):
        ws = [rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "\n", "\x0b"]) for _ in range(rng.randrange(0, 90))]
        texts.append(rng.choice([" ", "\t", "  "]).join(ws))
        langs.append(rng.choice(["en", "en", "de", None, "und"]))
    texts += [None, "", "...", "a b c d " * 400, "A B c D. " * 50]
    langs += ["en", None, "fr", "en", "en"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(4 * parts))
    try:
        got = phrases.collocations(docs_of(spark, texts, langs).repartition(parts), 8, 25)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == sorted(brute_collocations(texts, langs, 8, 25))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(docs_of(spark, [])).count() == 0
    assert phrases.collocations(docs_of(spark, [None, "", "one two"])).count() == 0


def test_counts_leave_a_full_task(monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 50)
    import numpy as np

    pieces = [np.arange(k, k + 40, dtype=np.uint64) for k in range(0, 400, 20)]
    got = Counter()
    for keys, counts in phrases._counted(iter(pieces)):
        got.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    assert got == Counter(x for p in pieces for x in p.tolist())


def test_phrases_leave_a_full_task(monkeypatch):
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(phrases, "HELD_PHRASES", 20)
    every = SimpleNamespace(value=np.full(2, 2**64 - 1, np.uint64))
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "b", "c.", "d", "é,"]) for _ in range(30)) for _ in range(40)]
    langs = [rng.choice(["en", "de"]) for _ in texts]
    batches = [pa.RecordBatch.from_arrays([pa.array(langs[k : k + 4]), pa.array(texts[k : k + 4])], names=["lang", "text"]) for k in range(0, 40, 4)]
    got, sent = Counter(), 0
    for b in phrases._phrases(every)(iter(batches)):
        sent += b.num_rows
        for lang, phrase, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
            got[lang, phrase] += n
    want = Counter()
    for lang, text in zip(langs, texts, strict=True):
        for piece in text.replace(",", ".").split("."):
            ws = piece.split()
            want.update((lang, " ".join(ws[i : i + k])) for k in range(1, 5) for i in range(len(ws) - k + 1))
    assert got == want
    assert sent > len(want)


def test_held_phrases_with_one_first_hash():
    import numpy as np

    held = phrases._Held()
    names = [b"x", b"y", b"x", b"z", b"y"]
    for _ in range(2):
        held.add(np.array([5, 5, 5, 9, 5], np.uint64), np.array([1, 2, 1, 1, 2], np.uint64), lambda k: names[k])
    got = Counter()
    for p, n in zip(held.phrases, held.counts, strict=True):
        got[p] += int(n)
    assert got == {b"x": 4, b"y": 4, b"z": 2}


def test_filter_keeps_all(spark):
    import numpy as np

    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    known = phrases.Filter(phrases.filter_of(spark.createDataFrame([(int(k),) for k in keys], "h long")).value)
    assert known(keys.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 5000).view(np.uint64)
    assert known(others).mean() < 0.05


def test_collocations_equal_sql(spark, sf, duck):
    assert_same(queries.QUERIES["op11_phrase_collocations"](spark, sf), duck, queries.ORACLES["op11_phrase_collocations"])


# ---- operator 12 --------------------------------------------------------------------------------


def brute_fingerprint(text):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    sh = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else ([b" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(marks):
    least = list(range(len(marks)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(marks):
            for j, y in enumerate(marks):
                if (x ^ y).bit_count() <= 2 and least[j] < least[i]:
                    least[i], changed = least[j], True
    return least


def test_simhash_against_brute_force(spark):
    rng = random.Random(5)
    base = [rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(90)]
    texts = [None, "", " \t", "One", "one two", "ONE two three", "one two three", "x " * 700]
    for _ in range(60):
        ws = list(base)
        ws[rng.randrange(len(ws))] = "changed"
        texts.append(" ".join(ws))
    texts += [" ".join(rng.choice("abcdefghijklmnop") for _ in range(50)) for _ in range(20)] + texts[8:12]
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.simhash_components(docs_of(spark, texts)).collect()}
    marks = [brute_fingerprint(t) for t in texts]
    assert [got[i][0] for i in range(len(texts))] == marks
    assert [got[i][1] for i in range(len(texts))] == brute_classes(marks)
    assert len(set(brute_classes(marks))) < len(set(marks))


@pytest.mark.parametrize("small", [64, 2])
def test_links_of_fingerprints(spark, monkeypatch, small):
    """All pairs within two bits, from small buckets and from large ones."""
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(9)
    marks = {0, 1, 2, 1 << 63, 3 << 62, (1 << 64) - 1}
    for _ in range(6):
        root = rng.getrandbits(64)
        for _ in range(40):
            x = root
            for _ in range(rng.randrange(0, 5)):
                x ^= 1 << rng.choice([0, 1, 5, 31, 32, 33, 40, 63])
            marks.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in marks]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = Counter(frozenset((r.a % 2**64, r.b % 2**64)) for r in found.collect())
    want = {frozenset((x, y)) for x in marks for y in marks if x != y and (x ^ y).bit_count() <= 2}
    assert set(got) == want
    assert max(got.values()) == 1


def test_simhash_of_nothing_and_of_missing_ids(spark):
    assert simhash.simhash_components(docs_of(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, None), (None, "zz yy xx")], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in simhash.simhash_components(df).collect())
    assert got == Counter([(None, 7), (7, 7), (7, 7), (None, None)])


def test_simhash_of_long_texts():
    import numpy as np

    rng = random.Random(1)
    lists = [[rng.getrandbits(64) for _ in range(n)] for n in (0, 1, 2, 254, 255, 256, 1000, 0, 3)]
    got = simhash.fingerprints(lists)
    for hs, fp in zip(lists, got.tolist(), strict=True):
        assert fp == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprints([[]]).tolist() == [0] and simhash.fingerprints([]).dtype == np.uint64


# ---- operator 13 --------------------------------------------------------------------------------


def brute_runs(ws, least=12):
    n, out, taken = len(ws), [], set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if ws[i] != ws[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and (i, j + q) not in taken:
                taken.add((i, j + q))  # a smaller period of the same words came before
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(ws, found):
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    return [w for k, w in enumerate(ws) if k not in gone]


def random_texts():
    rng = random.Random(11)
    out = []
    for size in (1, 2, 3, 3, 4):
        for n in (0, 5, 11, 12, 13, 30, 80, 200):
            for _ in range(4):
                ws = [rng.choice("abcdefgh"[:size]) for _ in range(n)]
                if n > 20 and rng.random() < 0.6:
                    at, p = rng.randrange(n // 2), rng.randrange(1, n // 3)
                    ws = [w if i < at else ws[at + (i - at) % p] for i, w in enumerate(ws)]
                out.append(ws)
    fib = ["a", "a b"]
    for _ in range(8):
        fib.append(f"{fib[-1]} {fib[-2]}")
    return [*out, fib[-1].split(), ["x"] * 3000, [str(i % 700) for i in range(3000)], [str(i) for i in range(500)]]


@pytest.mark.parametrize("least", [12, 2, 5])
def test_runs_against_brute_force(least):
    import numpy as np

    from densityflow.llm.shingles import word_hashes

    for ws in random_texts():
        words = [w.encode() for w in ws]
        hashes = word_hashes([None], [words])[0] if words else np.empty(0, np.uint64)
        assert runs.runs_of(words, hashes, least) == brute_runs(words, least), ws


def brute_row(doc_id, text):
    import zlib

    ws = (text or "").encode().split()
    n = len(ws)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    found = brute_runs(ws)
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    milli = 1000 * top[1] // top[2] if found else None
    return (doc_id, len(found), *top, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(brute_collapsed(ws, found))).hexdigest())


def found_runs(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string")
    found = runs.digests(runs.periodic_runs(df.select("doc_id", runs.looped(df["doc_id"], df["text"]).alias("text"))))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return [tuple(r) for r in found.collect()]


def test_runs_query_against_brute_force(spark):
    rng = random.Random(2)
    data = [(i, rng.choice([" ", "\t", "\r\n"]).join(ws)) for i, ws in enumerate(random_texts()[:160])]
    data += [(i, " ".join(str(rng.randrange(400)) for _ in range(rng.randrange(1, 150)))) for i in range(1000, 1120)]
    data += [(None, "a " * 20), (5, None), (5, ""), (5, " \n "), (17, "é ü " * 9), (17, "é ü " * 9)]
    assert rows([str(k) for k in range(8)], found_runs(spark, data)) == rows([str(k) for k in range(8)], [brute_row(*d) for d in data])
    assert found_runs(spark, []) == []


def test_runs_of_given_documents(spark, sf):
    got = {r[0]: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, sf).collect()}
    short = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len((r.text or "").split()) < 400]
    assert len(short) > 50
    for r in short:
        assert got[r.doc_id] == brute_row(r.doc_id, r.text)
