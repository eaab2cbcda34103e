"""Operators against brute force on small tables, with nulls, empty and long texts, ties and repeats."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from densityflow.llm import classifier, decontamination, html_text, language_model, license_scan, near_dedup, packing, quality_rules, sharding, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, h long"


def docs(spark, texts, ids=None):
    ids = ids or range(len(texts))
    rows = [(i, t, None if k % 5 == 4 else "en", None if k % 7 == 6 else f"s{k % 2}", 0, "clash", 1, 2) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "nu", "xi", "pi", "rho", "tau", "phi"]) + str(r.randrange(40)) for _ in range(n))


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


LONG = prose(99, 30_000)
ODD = [None, "", " \t\n ", "one", "One  TWO", "a\nb\na\n", "x " * 40, LONG, prose(1, 60), prose(1, 60), "\x0b\x0c\r", "ünï cödé ÀÉ 字", "###" * 30 + " a b c d e f g h i j"]


# --- 1


def test_warc_round_trip_and_revisits(spark):
    html = ["<p>" + "x" * 200, "short", None, "<p>" + "x" * 200, "short", "é" * 60, "é" * 60, "<p>" + "x" * 200]
    ids = [5, 1, 2, 3, 4, None, 9, 3]
    pages = spark.createDataFrame([(i, f"http://h/{k} ü\r\n", h, "clash") for k, (i, h) in enumerate(zip(ids, html, strict=True))], "page_id long, url string, html string, digest string")
    got = Counter(map(tuple, warc.round_trip(pages).collect()))
    want = Counter()
    for i, h in zip(ids, html, strict=True):
        b = (h or "").encode()
        same = [j for j, g in zip(ids, html, strict=True) if (g or "") == (h or "") and j is not None]
        first = min(same) if len(b) >= 100 and same else None
        again = len(b) >= 100 and i != first and first is not None
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert got == want
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_errors():
    good = warc._record("response", 1, "u", None, b"payload", hashlib.sha256(b"payload").hexdigest())
    assert warc.parse_record(good)[-1] == b"payload"
    for bad in (good[:-1], good.replace(b"Content-Length: 7", b"Content-Length: 6"), good.replace(b"payload", b"paylord"), b"WARC/9\r\n\r\n", good.replace(b"WARC-Date", b"WARC Date:")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    import zstandard

    dictionary = warc.train([good] * 3)
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    archive = warc.skippable(dictionary) + pack.compress(good) + pack.compress(good)
    assert [r[-1] for r in warc.parse_archive(archive)] == [None, None]
    assert [r[-1] is None for r in warc.parse_archive(archive[:-3])] == [True, False]
    broken = bytearray(archive)
    broken[-6] ^= 255
    assert any(r[-1] for r in warc.parse_archive(bytes(broken)))


# --- 2


def test_quality_rules(spark):
    texts = ODD + [prose(k, 80) for k in range(60)] + [prose(7, 80).replace(" ", "### ") for _ in range(3)] + [prose(8, 80).upper()]
    d = docs(spark, texts)
    out = {r.doc_id: r.quality for r in quality_rules.quality_rules(d).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeat = len({p for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)})
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 10 or 100 * repeat > 20 * len(w)
        q = out[i]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), repeat, failed), t and t[:50]
    n = len(ODD)
    assert all(out[i].kept for i in range(n, n + 60))
    assert not any(out[i].kept for i in range(n + 60, n + 64))
    kept = quality_rules.quality_rules(d, out="verdict").where("verdict.kept").select(*d.columns)
    assert kept.columns == d.columns and kept.count() == sum(q.kept for q in out.values())
    assert quality_rules.quality_rules(d.where("false")).count() == 0


# --- 3


def test_main_text(spark):
    page = "<html><head><title>T</title></head><body><nav><a>Home</a></nav><div class='ad'>Buy<article><h1>A &amp; B</h1><p>one<b>two</b>  three<br>four<script>x</script><div class=comments>c</div></article><aside>s</aside><footer>f</footer>"
    bare = lambda k: f"<div>we set these words on all pages here</div><p>{k}a {k}b, {k}c</p><form>f</form>"
    rows = [(1, "http://h/1", page), (2, "http://h/2", None), (3, None, ""), (1, "http://h/1", page)] + [(10 + k, f"http://b/{k}", bare(k)) for k in range(4)] + [(20, "http://other/", bare(9))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = html_text.main_texts(pages).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows)
    assert got[1] == "A & B onetwo three four" and got[2] == "" and got[3] == ""
    assert [got[10 + k] for k in range(4)] == [f"{k}a {k}b, {k}c" for k in range(4)]
    assert got[20] == "we set these words on all pages here 9a 9b, 9c"
    assert all(r.n_chars == len(r.text) for r in out)


def test_unique_text_beside_an_article_stays(spark):
    page = "<nav>n</nav><div>standfirst {0}x {0}y</div><article><p>{0}a we say these words in all articles here {0}b</p></article><div>we set these words on all pages here</div><div>{0}v {0}z</div><footer>f{0}</footer>"
    rows = [(k, "http://h/", page.format(k)) for k in range(4)]
    got = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"standfirst {k}x {k}y {k}a we say these words in all articles here {k}b {k}v {k}z" for k in range(4)}


# --- 4


def smallest_capacity(sizes, shards):
    """The least capacity by trying: greedy cuts of sizes in order."""

    def suffices(c):
        used, room = 1, c
        for x in sizes:
            if x > room:
                used, room = used + 1, c
            room -= x
        return used <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if suffices(mid) else (mid + 1, high)
    return low


def test_smallest_capacity_by_brute_force():
    for seed in range(150):
        r = random.Random(seed)
        sizes, k = [r.randint(1, 30) for _ in range(r.randint(1, 9))], r.randint(1, 4)
        ends = list(itertools.accumulate(sizes))
        best = min(max(b - a for a, b in zip([0, *c], [*c, ends[-1]], strict=True)) for n in range(min(k, len(sizes))) for c in itertools.combinations(ends[:-1], n))
        assert smallest_capacity(sizes, k) == best


@pytest.mark.parametrize("most", [0, 8, 10_000])
@pytest.mark.parametrize("case", ["even", "copies hold the bytes", "one holds a third", "few"])
def test_cuts_of_blocks_within_blocks(spark, monkeypatch, case, most):
    for name, value in (("PER_BLOCK", 2), ("DIGITS", 1), ("MOST_BLOCKS", most), ("HEAVY", 40)):
        monkeypatch.setattr(sharding, name, value)
    r = random.Random(7)
    sizes = [r.randint(1, 60) for _ in range(6 if case == "few" else 300)]
    if case == "copies hold the bytes":
        sizes += [sum(sizes[:300]) // 5 + k for k in range(20)]
    if case == "one holds a third":
        sizes.append(sum(sizes) // 2)
    rows = [(hashlib.md5(str(k).encode()).hexdigest(), s) for k, s in enumerate(sizes)]
    capacity, starts, heavy = sharding.minimax_cuts(spark.createDataFrame(rows, "gid string, size long"), 16)
    assert set(heavy) == {g for g, s in rows if s * 40 >= sum(sizes)}
    order = sorted((("0" if g in heavy else "1") + g, s) for g, s in rows)
    assert capacity == smallest_capacity([s for _, s in order], 16)
    assert len(starts) < 16
    of = [0] * 16
    for g, s in order:
        of[sum(g >= k for k in starts)] += s
    assert max(of) <= capacity


@pytest.mark.parametrize("copies", [1, 400])
def test_shards(spark, copies):
    r = random.Random(3)
    texts = ODD + [prose(k, r.randint(1, 300)) for k in range(700)] + [prose(5000, 50)] * copies
    out = sharding.shard_by_bytes(docs(spark, texts), 16).toPandas()
    assert len(out) == len(texts) and (out["size"] == [len((texts[i] or "").encode()) + 1 for i in out.doc_id]).all()
    assert (out.text_crc32 == [zlib.crc32((texts[i] or "").encode()) for i in out.doc_id]).all()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    body = out.doc_id.map(lambda i: texts[i] or "")
    assert (out.groupby(body).shard.nunique() == 1).all()
    groups = out.groupby(body)["size"].sum()
    heavy = {hashlib.md5(t.encode()).hexdigest() for t, s in groups.items() if s * sharding.HEAVY >= groups.sum()}
    order = sorted((("0" if (g := hashlib.md5(t.encode()).hexdigest()) in heavy else "1") + g, s) for t, s in groups.items())
    want = smallest_capacity([int(s) for _, s in order], 16)
    assert set(out.capacity) == {want} and out.groupby("shard")["size"].sum().max() <= want


def test_shards_of_nothing(spark):
    assert sharding.shard_by_bytes(docs(spark, ODD).where("false")).count() == 0


# --- 5


def test_licences(spark):
    body = prose(4, 40)
    rows = [
        (1, "a/b/c/x.py", body + "\nLicensed under the Apache License, Version 2.0."),
        (2, "a/b/c/y.py", body),
        (3, "a/LICENSE", "Released under the MIT License."),
        (4, "a/b/z.py", body),
        (5, "q/z.py", None),
        (6, None, body),
        (7, "a/b/c/d/e.py", ""),
        (8, "a/b/c/d/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
        (9, "top.py", body),
        (2, "a/b/c/y.py", body),
    ] + [(100 + k, f"f/{k}", prose(k, 30)) for k in range(40)]
    out = license_scan.licences(spark.createDataFrame(rows, "doc_id long, path string, text string"))
    got = {r.doc_id: (r.licence, r.found, r.from_dir) for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1] == ("Apache-2.0", "header", None) and got[2] == ("MIT", "inherited", "a") and got[4] == ("MIT", "inherited", "a")
    assert got[3][:2] == ("MIT", "file") and got[7] == ("GPL-3.0", "inherited", "a/b/c/d")
    assert got[5] == got[6] == got[9] == (None, "none", None)


def test_licences_beside_other_words_and_over_lines(spark):
    body = prose(4, 60)
    notices = {
        "MIT": ["Copyright 2020 Foo Authors. Released under the MIT License.", "This file is part of Foo and is released under the MIT License, see LICENSE.", "# Permission is hereby granted, free of\n# charge, to any person obtaining a copy\n# of this software and associated\n# documentation files (the Software)"],
        "Apache-2.0": ["Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with it.", " * Licensed under the Apache\n * License, Version 2.0"],
    }
    told = [(f"d{k}/x{i}.py", body + "\n" + t, name) for k, (name, ts) in enumerate(notices.items()) for i, t in enumerate(ts)]
    told += [("n/COPYING", body + "\n" + notices["MIT"][0] + "\n" + body, "MIT"), ("n/y.py", body, "MIT")]
    rows = [(i, p, t) for i, (p, t, _) in enumerate(told)] + [(100 + k, f"f/{k}", prose(k, 30) + " license under version") for k in range(400)]
    got = {r.doc_id: (r.licence, r.found) for r in license_scan.licences(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[i][0] for i in range(len(told))] == [x for *_, x in told]
    assert got[len(told) - 2][1] == "file" and got[len(told) - 1][1] == "inherited"
    assert all(got[100 + k] == (None, "none") for k in range(400))


def test_anchors_miss_no_line():
    m = license_scan.Matcher({"": 1000, "the": 900, "license": 30, "under": 400, "version": 20})
    r = random.Random(1)
    terms = sorted(license_scan.VOCABULARY) + ["zebra", "cloud"]
    for _ in range(3000):
        name = r.choice(sorted(license_scan.TEMPLATES))
        line = [t for t in license_scan.TERM.findall(r.choice(license_scan.TEMPLATES[name]).lower()) if r.random() < 0.6] + r.choices(terms, k=r.randrange(4))
        line = " ".join(line)
        if m.line(line):
            assert m.anchor.search(line), line


# --- 6


def test_containment(spark):
    items = [prose(100 + k, n) for k, n in enumerate((3, 6, 20, 40, 57, 400))] + [None, "", "IT is   a test"]
    r = random.Random(5)
    texts = list(ODD)
    for t in items:
        w = words(t)
        texts += [prose(r.random(), 50) + " " + " ".join(w).upper() + "\n" + prose(r.random(), 3000), " ".join(w[: int(0.75 * len(w))])]
        broken = list(w)
        if len(w) > 12:
            broken[len(w) // 2] = "changed"
            texts.append(prose(r.random(), 20) + " " + " ".join(broken))
    texts += [items[-1]]
    bench = spark.createDataFrame([(k, t, "c") for k, t in enumerate(items)] + [(3, items[3], "c")], "item_id long, text string, doc_id string")
    got = {(x.doc_id, x.item_id): (x.n_shingles, x.n_shared) for x in decontamination.contained(docs(spark, texts), bench).collect()}
    want = {}
    for i, t in enumerate(texts):
        for j, u in enumerate(items):
            s = shingles(u)
            both = len(s & shingles(t))
            if s and both >= 0.8 * len(s) - 1e-9:
                want[i, j] = (len(s), both)
    assert got == want and len(want) == 9
    left = decontamination.without_contaminated(docs(spark, texts), bench)
    assert left.columns == docs(spark, texts).columns
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - {i for i, _ in want}


# --- 7


def test_classifier(spark):
    good, bad = [prose(k, 60) for k in range(150)], [prose(1000 + k, 60).replace(" ", "### ") for k in range(150)]
    texts = [t for pair in zip(good, bad, strict=True) for t in pair] + ODD
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)] + [(3, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    out = classifier.quality_scores(d, labels).toPandas()
    assert len(out) == len(texts)
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    told = out[(out.doc_id < 300) & out.held_out]
    assert (told.predicted == 1 - told.doc_id % 2).mean() > 0.98
    assert ((out.score >= 0) & (out.score <= 1)).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()
    empty = out[out.doc_id.isin([300, 301, 302])].score
    assert empty.nunique() == 1
    none = classifier.quality_scores(docs(spark, ["a b"]), labels.where("false")).first()
    assert none.score == 0.5
    assert classifier.accepted(d, labels).columns == d.columns
    assert classifier.quality_scores(d.where("false"), labels).count() == 0


# --- 8


def spoken(seed, n, ending):
    """Words of one of two languages that differ by their endings, some much more frequent."""
    r = random.Random(seed)
    return " ".join(f"w{int(400 * r.random() ** 3)}{ending}" for _ in range(n))


def test_language_model(spark):
    texts = ODD + [spoken(k, 300, "ab"[k % 2]) for k in range(60)]
    out = language_model.scored(docs(spark, texts)).toPandas()
    tokens = [[*words(t), None] for t in texts]
    train = Counter(w for i, ws in enumerate(tokens) if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(train.values()), len(train)
    assert len(out) == len(texts) and set(out.train_tokens) == {n}
    for r in out.itertuples():
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known) == (len(ws), sum(train[w] > 0 for w in ws))
        assert math.isclose(r.base_score, sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
    held = out[out.held_out & (out.doc_id >= len(ODD))]
    assert held.score.sum() > held.base_score.sum() and (out.score < 0).all()
    assert language_model.scored(docs(spark, ODD).where("false")).count() == 0


def test_hot_words_are_counted_over_all_texts(spark):
    texts = ["early words"] * 2100 + ["few " * 6000 + "behind " * 3000, "late " * 3000]
    hot = language_model.hot_contexts(docs(spark, texts + [prose(1, 50), None]).select("doc_id", "text"), 1 / 1024)
    assert set(hot.words) == set(language_model.word_hashes([b"early", b"words", b"few", b"behind", b"late", language_model.START]))
    assert len(language_model.hot_contexts(docs(spark, texts).where("false").select("doc_id", "text"), 1 / 1024)) == 1


def test_scores_are_the_same_in_many_parts(spark):
    texts = ODD + [spoken(k, 300, "ab"[k % 2]) for k in range(40)]
    one = language_model.scored(docs(spark, texts)).toPandas().set_index("doc_id")
    many = language_model.scored(docs(spark, texts), part_bytes=30_000).toPandas().set_index("doc_id").loc[one.index]
    assert (one.n_known == many.n_known).all() and np.allclose(one.base_score, many.base_score)
    assert np.allclose(one.score, many.score, rtol=0.05)


def test_seating_is_a_distribution():
    """In every restaurant the words that it has, and what it leaves to its parent, make one."""
    lm = language_model
    hot = lm.Hot(*[np.empty(0, dtype=np.uint64)] * 3)
    texts = [spoken(k, 400, "ab"[k % 2]) for k in range(6)]
    rows = [r for batch in lm._packer(np.array([0]), hot)(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(6)), "text": texts})])) for r in batch.to_pylist()]
    body, _, once, twice = lm.merged([(r["slice"], r["n_docs"], r["body"]) for r in rows if r["n_docs"] >= 0], hot, 3)
    part, rng = lm.Part(body, lm.discount(once, twice)), np.random.default_rng(5)
    p = part.first_guess()
    for _ in range(4):
        part.sweep(p, rng)
        assert ((part.t2 <= part.c) & ((part.t2 > 0) == (part.c > 0))).all()
        assert ((part.t1 <= part.c1) & ((part.t1 > 0) == (part.c1 > 0))).all()
    of_pair, of_cell = part.of_pairs(p), part.of_cells(p)
    for own, group, c, t, parent, d, strength in ((of_cell, part.rest, part.c, part.t2, of_pair[part.pair], part.d2, lm.T2), (of_pair, part.word, part.c1, part.t1, p[part.item], lm.D1, lm.T1)):
        customers, tables = np.bincount(group, weights=c), np.bincount(group, weights=t)
        left = (strength + d * tables) / (strength + customers)
        assert np.allclose(np.bincount(group, weights=own) + left * (1 - np.bincount(group, weights=parent)), 1)


def test_table_numbers_follow_their_law():
    """Of four customers: shares of 1 to 4 tables, by all seatings."""
    d, a = 0.5, 1.7
    table = np.exp(language_model.log_stirling(d)[4, 1:5]) * a ** np.arange(1, 5)
    t = language_model.draw_tables(np.full(20_000, 4), np.full(20_000, a), d, np.random.default_rng(0))
    assert np.allclose(np.bincount(t, minlength=5)[1:] / 20_000, table / table.sum(), atol=0.015)


# --- 9


def test_bounds_by_brute_force():
    for seed in range(200):
        r = random.Random(seed)
        m = r.randint(1, 9)
        x, n, k = sorted(r.sample(range(1, 40), m)), [r.randint(1, 9) for _ in range(m)], r.randint(1, 5)
        pad = lambda b, x=x, n=n: sum(c * (min(y for y in b if y >= v) - v) for v, c in zip(x, n, strict=True))
        best = min(pad([*c, x[-1]]) for i in range(min(k, m)) for c in itertools.combinations(x[:-1], i))
        assert pad(packing.optimal_bounds(x, n, k)) == best


def test_packing(spark):
    texts = ODD + [prose(k, k % 50) for k in range(300)]
    out = packing.packed(docs(spark, texts), 4, 200).toPandas()
    assert len(out) == len(texts) and (out.n_tokens == [len(words(texts[i])) + 1 for i in out.doc_id]).all()
    assert (out.n_tokens <= out.padded_to).all()
    for (_, _), g in out.groupby(["bucket", "batch"]):
        assert len(g) == 1 or len(g) * g.padded_to.iloc[0] <= 200
        assert sorted(g.place) == list(range(len(g)))
    assert packing.packed(docs(spark, ODD).where("false")).count() == 0


# --- 10


def brute_components(texts, ids, percent):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)), key=lambda k: (ids[k], k))
            root[b] = a
    return [min(ids[j] for j in range(len(texts)) if find(j) == find(i)) for i in range(len(texts))], sets


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    r = random.Random(percent)
    base = [prose(k, 120).split() for k in range(4)]
    texts = list(ODD)
    for k in range(120):
        w = list(base[k % 4])
        for _ in range(r.randrange(8)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [texts[-1], texts[-2].upper(), prose(50, 7), prose(50, 8), "a b c d e f", "a b c d e f g"]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    want, sets = brute_components(texts, ids, percent)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dedup.near_duplicates(docs(spark, texts, ids), percent).collect()}
    assert got == {i: (len(s), c, i == c) for i, c, s in zip(ids, want, sets, strict=True)}
    left = near_dedup.without_near_duplicates(docs(spark, texts, ids), percent)
    assert left.columns == docs(spark, texts).columns and sorted(x.doc_id for x in left.collect()) == sorted(set(want))


def test_near_duplicates_of_odd_tables(spark):
    assert near_dedup.near_duplicates(docs(spark, ODD).where("false")).count() == 0
    rows = docs(spark, [prose(1, 30), prose(1, 30), prose(2, 30), None], [4, 4, 4, None])
    got = sorted((x.doc_id or -1, x.component_id or -1, x.kept) for x in near_dedup.near_duplicates(rows).collect())
    assert got == [(-1, -1, True), (4, 4, True), (4, 4, True), (4, 4, True)]
    assert near_dedup.without_near_duplicates(rows).count() == 3


# --- pipeline


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    table = spark.read.parquet(f"{sf}/documents.parquet")
    before = table.withColumn("quality", F.lit("clash"))
    assert [n for n, _ in p.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "decontamination", "packing"]
    for name, stage in p.STAGES:
        after = stage(spark, before, sf)
        if name != "packing":
            assert after.columns == before.columns
            ids = {r.doc_id for r in after.select("doc_id").collect()}
            if name == "decontamination":
                items = [shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
                want = {r.doc_id for r in before.collect() if not any(len(s & shingles(r.text)) >= 0.8 * len(s) - 1e-9 for s in items)}
                assert ids == want
            if name == "near_dedup":
                rows = before.collect()
                want, _ = brute_components([r.text for r in rows], [r.doc_id for r in rows], 80)
                assert ids == set(want)
            before = spark.createDataFrame(after.collect(), after.schema)
        else:
            assert after.count() == before.count()
