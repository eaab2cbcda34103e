"""Operator 5: licences of files, by TF-IDF cosine to templates and by directory.

Statements (lines of a text, and windows as long as a template, over the ends of lines) are compared
with notices, titles and whole licence texts as sparse TF-IDF vectors; whole texts are compared with
licence texts, too, and a title near its beginning makes a text a licence file. Document frequencies of all terms are counted over
all texts. What has none of a template's heaviest terms can't reach the threshold, by the
Cauchy-Schwarz inequality on the rest of its weights, so that only lines and windows with such an
anchor are compared, wherever they stand in the text. Terms of no template add to a statement's norm
only; they are joined with their frequencies.

An SPDX identifier is no bag of its parts: the whole token counts, as it stands, and one that no
template has is reported as written (without -only, -or-later or +). Of two versions of a licence,
which may differ in a number alone, the one with the statement's numbers counts: a statement that lacks
a template's number and has another of at most two digits is of the version that has it, or of none. The opening that the
BSD licences share is BSD-3-Clause if the clause on names follows, else BSD-2-Clause.

A file with a statement has that licence (``header``, or ``file`` if it is a licence file by the share
of its words in statements or by its name). Others
inherit from the licence file in the nearest ancestor directory: distinct directories are joined
with their ancestors' licence files, then files with their directory. The licence file of the
highest cosine speaks for a directory, the first path on ties.

Defined results: null and empty texts have no statement, but may inherit; a null path has no
directory and inherits nothing; ties between templates go to the first name; repeated rows each get
a row; an empty table gives an empty result; other columns are ignored. Texts of any length are read
whole, in time in proportion to their length: windows are ruled out by running sums, and a window that
holds the words of the one before it is the same statement, a word longer.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densityflow.llm.common import cut, if_small, tidy

THRESHOLD = 0.6
#: For windows, of which a text has many: parts of notices of other licences are to stay below.
WINDOW_THRESHOLD = 0.8
#: A text of which statements are so large a share of the words is a licence file.
FILE_SHARE = 0.2
FILE_NAME = r"(?i)(^|/)(un)?(licen[cs]e|copying|copyright)([._-][^/]*)?$"
TERM = re.compile(r"[a-z0-9]+")
#: Terms that a task counts before it sends them on.
HELD_TERMS = 200_000
# Notices by which licences are named.
TEMPLATES = {
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "MIT": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "Proprietary": ["All rights reserved", "Copyright. All rights reserved."],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
#: The opening that all BSD licences share, and the clause that only some have.
SHARED_OPENING = TEMPLATES["BSD-3-Clause"][0]
NAMES_CLAUSE = ["neither", "the", "name"]
#: The token after an SPDX tag; these endings don't make another licence.
SPDX = re.compile(r"spdx-license-identifier:[ \t]*\(*([a-z0-9][a-z0-9.+-]*)", re.IGNORECASE)
SPDX_ENDING = re.compile(r"(-only|-or-later|\+)$", re.IGNORECASE)
# Titles by which long licence texts begin.
TITLES = {
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Apache-2.0": "Apache License Version 2.0, January 2004",
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International Public License",
    "CC0-1.0": "Creative Commons Legal Code CC0 1.0 Universal",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "MPL-2.0": "Mozilla Public License Version 2.0",
}
# Sentences with which the bodies of long licence texts open.
OPENINGS = {
    "Apache-2.0": "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    "GPL-2.0": "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "GPL-3.0": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "MPL-2.0": "\"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
}
# Short licence texts as they stand in licence files.
TEXTS = {
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
VOCABULARY = frozenset(t for texts in ([n for ns in TEMPLATES.values() for n in ns], TITLES.values(), OPENINGS.values(), TEXTS.values()) for n in texts for t in TERM.findall(n.lower()))
#: Notices of fewer terms, and titles, count only as they stand, in order.
SHORT = 5
#: A title so near the beginning makes a text a licence file.
TITLE_WITHIN = 30
#: And the opening of its body so near.
OPENING_WITHIN = 200


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term, n): in how many texts a term occurs; '' counts texts."""
    found: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    for batch in batches:
        for text in batch.column(0):
            found[""] += 1
            found.update(set(TERM.findall((text.as_py() or "").lower())))
            if len(found) > HELD_TERMS:
                yield out()
                found.clear()
    yield out()


def _numbers(terms) -> frozenset[str]:
    return frozenset(t for t in terms if t.isdigit() and len(t) <= 2)


#: What a licence's name is without its version, and the numbers of its templates.
FAMILY = {name: re.sub(r"-[0-9][0-9.]*(-Clause)?$", "", name) for name in sorted({*TEMPLATES, *TITLES, *TEXTS})}
VERSIONS = {name: {_numbers(TERM.findall(n.lower())) for n in TEMPLATES.get(name, [])} - {frozenset()} for name in FAMILY}


def in_version(name: str, template, numbers: frozenset[str]) -> str | None:
    """The licence of a statement with these numbers that is near to a template: its own, that of its family
    whose numbers the statement has, or None for a version without a template."""
    own = _numbers(template)
    if own <= numbers or numbers <= own:
        return name
    return next((k for k, family in FAMILY.items() if family == FAMILY[name] and any(v <= numbers for v in VERSIONS[k])), None)


class Matcher:
    """Templates as weighted vectors."""

    def __init__(self, frequencies: dict[str, int], threshold: float = THRESHOLD):
        n = frequencies.get("", 0)
        self.idf = {t: math.log((1 + n) / (1 + frequencies.get(t, 0))) + 1 for t in VOCABULARY}
        self.other = math.log(1 + n) + 1  # terms of no template
        self.threshold = threshold
        self.vectors: list[tuple[str, dict[str, float]]] = []
        self.windows: list[tuple[str, dict[str, float], list[str], int, bool]] = []  # terms, from where it makes a file, whether it opens BSD licences
        self.texts = [(name, self.vector(text), TERM.findall(text.lower())) for name, text in sorted(TEXTS.items())]
        anchors: set[str] = set()
        notices = [(name, n, 0) for name, ns in sorted(TEMPLATES.items()) for n in ns] + [(name, n, TITLE_WITHIN) for name, n in sorted(TITLES.items())] + [(name, n, OPENING_WITHIN) for name, n in sorted(OPENINGS.items())]
        for name, notice, title in notices:
            v, terms = self.vector(notice), TERM.findall(notice.lower())
            self.windows.append((name, v, terms, title, notice == SHARED_OPENING))
            if len(terms) >= SHORT and not title:
                self.vectors.append((name, v))
            left = 1.0
            for t in sorted(v, key=lambda t: (-v[t], t)):
                if left < threshold * threshold - 1e-9:
                    break
                anchors.add(t)
                left -= v[t] ** 2
        self.anchors = anchors
        self.anchor = re.compile(r"(?<![a-z0-9])(?:" + "|".join(sorted(anchors)) + r")(?![a-z0-9])")

    def vector(self, line: str) -> dict[str, float]:
        counts = Counter(TERM.findall(line.lower()))
        v = {t: c * self.idf.get(t, self.other) for t, c in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    def line(self, line: str) -> tuple[float, str] | None:
        """(cosine, licence) of the nearest template, if it is near enough."""
        v = self.vector(line)
        best = None
        for name, t in self.vectors:
            cosine = sum(x * t.get(k, 0.0) for k, x in v.items())
            if cosine >= self.threshold - 1e-12 and (best is None or cosine > best[0] + 1e-12):
                best = (cosine, name)
        return best

    def statement(self, terms: list[str], templates: list[tuple[str, dict[str, float]]], threshold: float) -> dict | None:
        """The nearest template, unless terms are too far from it whatever the others' frequencies."""
        own, others = {}, {}
        for t, c in Counter(terms).items():
            if t in self.idf:
                own[t] = c * self.idf[t]
            else:
                others[t] = c
        norm = sum(x * x for x in own.values())
        least = math.sqrt(norm + sum(c * c for c in others.values()))  # no term weighs less than 1
        numbers = _numbers((*own, *others))
        best = None
        for name, t in templates:
            dot = sum(x * t.get(k, 0.0) for k, x in own.items())
            if dot >= (threshold - 1e-12) * least and (best is None or dot > best["dot"] + 1e-12):
                version = in_version(name, t, numbers)
                if version is not None:
                    best = {"dot": dot, "norm": norm, "licence": version, "least": threshold}
        return best and best | {"others": [{"term": t, "c": c} for t, c in others.items()]}

    def starts(self, terms: list[str], weights: np.ndarray, v: dict[str, float], n: int) -> np.ndarray:
        """Where windows of n terms begin that running sums don't rule out: the product with v is a sum over
        the window, and the norm is no less than the root of the sum of squared weights."""
        dots = np.fromiter((v.get(t, 0.0) for t in terms), float, len(terms))
        upto, norms = (np.concatenate([[0.0], np.cumsum(x)]) for x in (dots * weights, weights * weights))
        size = len(terms) - n + 1
        if size <= 0:
            return np.empty(0, dtype=np.int64)
        near = upto[n:] - upto[:size] >= WINDOW_THRESHOLD * np.sqrt(norms[n:] - norms[:size]) - 1e-6
        return np.flatnonzero(near & (dots[:size] > 0) & (dots[n - 1 :] > 0))

    def statements(self, text: str) -> list[dict]:
        """Lines and windows that may be statements, with the words at which they begin and end."""
        low = text.lower()
        tagged = [(m.group(1), m.start(), m.end()) for m in SPDX.finditer(text)] if len(low) == len(text) else [(m.group(1), m.start(), m.end()) for m in SPDX.finditer(low)]
        if not tagged and not self.anchor.search(low):
            return []
        found = [(m.group(), m.start(), m.end()) for m in TERM.finditer(low)]
        terms = [t for t, _, _ in found]
        begins = [m.start() for m in re.finditer(r"\S+", low)]
        at = [i for i, t in enumerate(terms) if t in self.anchors]
        names_at = max((i for i, t in enumerate(terms) if t == NAMES_CLAUSE[0] and terms[i : i + 3] == NAMES_CLAUSE), default=-1)
        out = []

        def span(a: int, b: int) -> dict:
            """The words from character a, which is no space, to b."""
            first = bisect_left(begins, a)
            return {"first": first, "last": first + 1 + bisect_left(begins, b) - bisect_right(begins, a)}

        def add(i: int, j: int, templates, threshold: float, whole: bool = False, opens: bool = False) -> dict | None:
            best = self.statement(terms[i:j], templates, threshold)
            if best:
                best |= {"first": 0, "last": len(begins)} if whole else span(found[i][1], found[j - 1][2])
                if opens and names_at < i:
                    best["licence"] = "BSD-2-Clause"
                out.append(best)
            return best

        for name, a, b in tagged:
            out.append({"dot": 1.0, "norm": 1.0, "licence": spdx_licence(name), "least": 0.0, "others": []} | span(a, b))
        lines = [c for c, ch in enumerate(low) if ch == "\n"] if at else []
        end = 0
        for i in at:
            if i >= end:
                k = bisect_left(lines, found[i][1])
                start, stop = lines[k - 1] + 1 if k else 0, lines[k] if k < len(lines) else len(low)
                first, end = i, i + 1
                while first and found[first - 1][1] >= start:
                    first -= 1
                while end < len(found) and found[end][2] <= stop:
                    end += 1
                best = self.statement(terms[first:end], self.vectors, self.threshold)
                if best:
                    opening = best["licence"] == "BSD-3-Clause" and not {"3", "clause"} <= set(terms[first:end])
                    add(first, end, self.vectors, self.threshold, opens=opening)
        weights = np.fromiter((self.idf.get(t, 1.0) for t in terms), float, len(terms))
        for name, v, notice, title, opens in self.windows:
            n, last, kept = len(notice), -2, None
            for i in self.starts(terms, weights, v, n).tolist():
                if (n < SHORT or title == TITLE_WITHIN) and terms[i : i + n] != notice:
                    continue
                if n >= SHORT and kept and i == last + 1 and terms[last] == terms[i + n - 1]:
                    kept["last"] = max(kept["last"], span(found[i][1], found[i + n - 1][2])["last"])  # the same words, one further
                else:
                    kept = add(i, i + n, [(name, v)], WINDOW_THRESHOLD, i < title, opens)
                last = i
        for name, v, licence in self.texts:
            if len(terms) <= 2 * len(licence):
                add(0, len(terms), [(name, v)], WINDOW_THRESHOLD, True)
            for i, t in enumerate(terms):
                if t == licence[0] and terms[i : i + 4] == licence[:4]:
                    add(i, min(len(terms), i + len(licence)), [(name, v)], WINDOW_THRESHOLD)
        return out


#: Identifiers of templates, by their lower case.
KNOWN = {name.lower(): name for name in (*TEMPLATES, *TITLES, *TEXTS)}


def spdx_licence(token: str) -> str:
    """The licence of an SPDX identifier; one without a template as it is written."""
    plain = SPDX_ENDING.sub("", token.rstrip("."))
    return KNOWN.get(plain.lower(), plain)


STATEMENT = "struct<dot: double, norm: double, licence: string, least: double, others: array<struct<term: string, c: long>>, first: long, last: long>"
ARROW_STATEMENT = pa.struct([("dot", pa.float64()), ("norm", pa.float64()), ("licence", pa.string()), ("least", pa.float64()), ("others", pa.list_(pa.struct([("term", pa.string()), ("c", pa.int64())]))), ("first", pa.int64()), ("last", pa.int64())])


def _matched(frequencies: dict[str, int]):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(frequencies)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(2)]
            found = pa.array([matcher.statements(t) for t in texts], pa.list_(ARROW_STATEMENT))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t.split()) for t in texts], pa.int64()), found], names=["doc_id", "path", "n_words", "found"])

    return match


def _stated(rows: DataFrame, frequencies: DataFrame, n_texts: int) -> DataFrame:
    """(row, licence, cosine, stated) of the rows with a statement; stated words count once."""
    found = rows.select("row", F.posexplode("found").alias("k", "s")).select("row", "k", "s.*")
    others = found.select("row", "k", F.explode("others").alias("o")).select("row", "k", F.col("o.term").alias("term"), F.col("o.c").alias("c"))
    weight = F.col("c") * (F.log((1.0 + F.lit(n_texts)) / (1 + F.col("n"))) + 1)
    others = others.join(frequencies, "term").groupBy("row", "k").agg(F.sum(weight * weight).alias("rest"))
    cosine = F.col("dot") / F.sqrt(F.col("norm") + F.coalesce("rest", F.lit(0.0)))
    near = found.drop("others").join(others, ["row", "k"], "left").withColumn("cosine", cosine).where(F.col("cosine") >= F.col("least") - 1e-12)
    best = F.min(F.struct((-F.round("cosine", 12)).alias("c"), "first", "licence")).alias("best")
    spans = F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans")  # no more than a text has
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    union = F.aggregate("spans", none, lambda a, x: F.struct((a["n"] + F.greatest(x["last"] - F.greatest(a["end"], x["first"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["last"]).alias("end")), lambda a: a["n"])
    return near.groupBy("row").agg(best, spans).select("row", F.col("best.licence").alias("licence"), F.least(-F.col("best.c"), F.lit(1.0)).alias("cosine"), union.alias("stated"))


def directory(path: Column) -> Column:
    """Path without its last name; the root is the empty string."""
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


@tidy
def licences(files: DataFrame) -> DataFrame:
    """files: (doc_id, path, text). (doc_id, path, licence, found, cosine, from_dir); found is
    header, file, inherited or none."""
    files = files.select("doc_id", "path", "text")
    counts = files.select("text").mapInArrow(_term_counts, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    frequencies = {r[0]: r[1] for r in counts.where(F.col("term").isin(["", *VOCABULARY])).collect()}  # no more than the templates' terms
    rows = cut(files.mapInArrow(_matched(frequencies), f"doc_id long, path string, n_words long, found array<{STATEMENT}>").withColumn("row", F.monotonically_increasing_id()))
    stated = if_small(cut(_stated(rows.where(F.size("found") > 0), counts, frequencies.get("", 0))))
    rows = rows.drop("found").join(stated, "row", "left")
    rows = rows.withColumn("share", F.coalesce(F.col("stated"), F.lit(0)) / F.greatest(F.col("n_words"), F.lit(1)))
    named = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    rows = rows.withColumn("dir", directory(F.col("path"))).withColumn("is_file", (F.col("share") >= FILE_SHARE) | named)
    speaking = rows.where("is_file AND licence IS NOT NULL AND path IS NOT NULL").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "licence")).alias("s"))
    speaking = cut(speaking.select(F.col("dir").alias("ancestor"), F.col("s.licence").alias("dir_licence")))
    dirs = rows.where("licence IS NULL AND path IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    upwards = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    above = dirs.select("dir", F.posexplode(upwards).alias("depth", "ancestor"))
    nearest = above.join(if_small(speaking), "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "dir_licence")).alias("n"))
    nearest = cut(nearest.select("dir", F.col("n.ancestor").alias("from_dir"), "n.dir_licence"))
    out = rows.join(if_small(nearest), "dir", "left")
    own = F.col("licence").isNotNull()
    found = F.when(own & F.col("is_file"), "file").when(own, "header").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("licence", "dir_licence").alias("licence"), found.alias("found"), "cosine", F.when(~own, F.col("from_dir")).alias("from_dir"))
