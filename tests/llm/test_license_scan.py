"""Whole licence texts, prose that only sounds like a notice, and cosines against brute force."""

import math
import random
import textwrap
from collections import Counter

import pytest

from densityflow.llm import license_scan as scan


def found(spark, rows):
    table = spark.createDataFrame([(*r, "clash", 0.5, 3) for r in rows], "doc_id long, path string, text string, dir string, cosine double, n long")
    return {r.doc_id: r for r in scan.licences(table).collect()}


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(f"{r.choice(['river', 'stone', 'the', 'of', 'and', 'to', 'software', 'copy'])}{r.randrange(30)}" if r.random() < 0.6 else r.choice(["the", "of", "and", "is", "to"]) for _ in range(n))


def test_whole_licence_texts_speak_for_their_directories(spark):
    mit = "MIT License\n\nCopyright (c) 2020 Foo\n\n" + textwrap.fill(scan.TEXTS["MIT"], 70)
    apache = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n" + prose(1, 1500)
    gpl = "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n" + prose(2, 3000)
    rows = [(1, "a/terms.txt", mit), (2, "a/x/y.py", prose(3, 50)), (3, "b/text", apache), (4, "b/c/d/e.py", prose(4, 50)), (5, "c/t", gpl), (6, "c/z.py", prose(5, 80))]
    rows += [(7, "d/long.py", prose(6, 3000) + "\n" + scan.TEXTS["ISC"] + "\n" + prose(7, 3000)), (8, "d/other.py", prose(8, 40))]
    rows += [(100 + k, f"f/{k}", prose(10 + k, 60)) for k in range(60)]
    got = found(spark, rows)
    assert [(got[i].licence, got[i].found) for i in range(1, 9)] == [("MIT", "file"), ("MIT", "inherited"), ("Apache-2.0", "file"), ("Apache-2.0", "inherited"), ("GPL-3.0", "file"), ("GPL-3.0", "inherited"), ("ISC", "header"), (None, "none")]
    assert all(got[100 + k].found == "none" for k in range(60))


def test_prose_about_rights_is_no_notice(spark):
    rows = [(1, "a/1", "and so all human rights are reserved for all people of the world"), (2, "b/2", "All rights reserved."), (3, "c/3", prose(1, 30))]
    rows += [(10 + k, f"c/{k}", prose(k, 40)) for k in range(50)]
    got = found(spark, rows)
    assert [got[i].licence for i in (1, 2, 3)] == [None, "Proprietary", None]


def test_cosines_equal_brute_force(spark):
    r = random.Random(3)
    notices = [(name, n) for name, ns in scan.TEMPLATES.items() for n in ns if len(scan.TERM.findall(n.lower())) >= scan.SHORT]
    texts = []
    for _ in range(120):
        _, n = r.choice(notices)
        words = [w for w in n.split() if r.random() < 0.9] + prose(r.random(), r.randrange(0, 5)).split()
        texts.append(" ".join(words))
    texts += [prose(k, 12) for k in range(80)]
    got = found(spark, [(i, f"q{i}/f", t) for i, t in enumerate(texts)])
    docs = [scan.TERM.findall(t.lower()) for t in texts]
    df = Counter(t for d in docs for t in set(d))
    idf = lambda t: math.log((1 + len(docs)) / (1 + df[t])) + 1

    def cosine(a, b):
        a, b = ({t: c * idf(t) for t, c in Counter(x).items()} for x in (a, b))
        return sum(x * b.get(t, 0) for t, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    for i, d in enumerate(docs):
        best = 0.0
        for _, n in notices:
            terms = scan.TERM.findall(n.lower())
            if cosine(d, terms) >= scan.THRESHOLD:
                best = max(best, cosine(d, terms))
            for k in range(len(d) - len(terms) + 1):
                c = cosine(d[k : k + len(terms)], terms)
                if c >= scan.WINDOW_THRESHOLD and d[k] in terms and d[k + len(terms) - 1] in terms:
                    best = max(best, c)
        if got[i].licence is not None and got[i].cosine > best + 1e-9:  # a short notice, a title or a whole text
            others = [scan.TERM.findall(t.lower()) for t in (*scan.TITLES.values(), *scan.TEXTS.values(), *(n for ns in scan.TEMPLATES.values() for n in ns))]
            best = max(c for o in others for c in [cosine(d, o), *(cosine(d[k : k + len(o)], o) for k in range(len(d)) if len(d[k : k + len(o)]))])
        assert (got[i].licence is not None) == (best > 0), texts[i]
        if best:
            assert got[i].cosine == pytest.approx(best, abs=1e-9)


def test_odd_files(spark):
    rows = [(1, None, None), (2, "", ""), (3, "/", "x"), (4, "a//b", "Released under the MIT License"), (4, "a//b", "Released under the MIT License"), (5, "a/LICENSE", "word " * 300_000 + "Released under the MIT License"), (None, "a/x", "y")]
    got = scan.licences(spark.createDataFrame(rows, "doc_id long, path string, text string"))
    assert got.count() == len(rows)
    by = {r.doc_id: (r.licence, r.found) for r in got.collect()}
    assert by[5] == ("MIT", "file")
    assert by[None] == ("MIT", "inherited")
    assert by[1] == (None, "none")
    assert scan.licences(spark.createDataFrame(rows, "doc_id long, path string, text string").where("false")).collect() == []


def rest(n=60):
    return [(1000 + k, f"zz/{k}/f", prose(k, 40)) for k in range(n)]


def test_identifiers_are_whole_tokens(spark):
    cases = {
        "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
        "// SPDX-License-Identifier: gpl-3.0-or-later": "GPL-3.0",
        "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause",
        "# SPDX-License-Identifier: BSL-1.0": "BSL-1.0",
        "/* SPDX-License-Identifier: (MIT OR Apache-2.0) */": "MIT",
        "SPDX-License-Identifier: Zlib": "Zlib",
        "SPDX-License-Identifier: CC0-1.0.": "CC0-1.0",
        "SPDX-License-Identifier:": None,
        "the spdx license identifier of gpl 3 0 is long": None,
    }
    got = found(spark, [(i, f"d{i}/a.c", f"{line}\nint x;\n{prose(i, 20)}") for i, line in enumerate(cases)] + rest())
    assert [got[i].licence for i in range(len(cases))] == list(cases.values())
    assert all(got[i].cosine == 1.0 for i, want in enumerate(cases.values()) if want)


def test_versions_and_headers(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,"
    lgpl = gpl.replace("GNU General", "GNU Lesser General").replace("This program is free", "This library is free")
    cases = [
        (gpl.format(3), "GPL-3.0"), (gpl.format(2), "GPL-2.0"), (lgpl.format(3), "LGPL-3.0"), (lgpl.format("2.1"), "LGPL-2.1"),
        (gpl.replace("GNU General", "GNU Affero General").format(3), "AGPL-3.0"),
        ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at", "Apache-2.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"), ("Licensed under the BSD 3-Clause License.", "BSD-3-Clause"),
        ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
        (textwrap.fill(scan.TEXTS["BSD-2-Clause"], 60), "BSD-2-Clause"), (textwrap.fill(scan.TEXTS["BSD-3-Clause"], 60), "BSD-3-Clause"),
        ("Copyright 2020 Foo. Released under the MIT License.", "MIT"),
    ]
    got = found(spark, [(i, f"d{i}/a.c", f"/*\n{text}\n*/\n{prose(i, 20)}") for i, (text, _) in enumerate(cases)] + rest())
    assert [got[i].licence for i in range(len(cases))] == [want for _, want in cases]


def test_bodies_of_long_licences_open_as_files(spark):
    rows = [(i, f"d{i}/terms", prose(i, 25) + "\n" + opening + "\n" + prose(i + 9, 900)) for i, opening in enumerate(scan.OPENINGS.values())]
    got = found(spark, rows + rest())
    assert [(got[i].licence, got[i].found) for i in range(len(rows))] == [(name, "file") for name in scan.OPENINGS]


def test_long_texts_of_notices_take_time_in_proportion():
    import time

    matcher = scan.Matcher({"": 1000, "the": 900, "under": 300, "license": 50, "released": 40, "mit": 5})
    mixed = ("Released under the MIT License " * 3 + "or the GNU General Public License, version 2.\nPermission to use it is granted. ") * 33_000
    for text, most in (("Released under the MIT License " * 160_000, 20), (mixed, 20)):
        assert len(text) > 4_900_000
        began = time.perf_counter()
        found = matcher.statements(text)
        assert time.perf_counter() - began < most
        assert {"MIT"} <= {f["licence"] for f in found}
    # what merges covers what it covered
    short = matcher.statements("Released under the MIT License " * 40)
    assert min(f["first"] for f in short) == 0
    assert max(f["last"] for f in short) == 200


def test_merged_windows_state_the_same_words():
    """Windows with a neighbour's words only lengthen it: first, last and cosine as without merging."""
    r = random.Random(8)
    matcher = scan.Matcher({"": 100, "the": 90, "under": 30})
    for _ in range(30):
        text = " ".join(r.choice(["Released under the MIT License", "word", "under the", "License Released"]) for _ in range(25))
        terms = scan.TERM.findall(text.lower())
        v = matcher.vector("Released under the MIT License")
        covered = set()
        for i in range(len(terms) - 4):
            if terms[i] in v and terms[i + 4] in v and matcher.statement(terms[i : i + 5], [("MIT", v)], scan.WINDOW_THRESHOLD):
                covered |= set(range(i, i + 5))
        got = {k for f in matcher.statements(text) if f["licence"] == "MIT" and f["least"] == scan.WINDOW_THRESHOLD for k in range(f["first"], f["last"])}
        assert got == covered
