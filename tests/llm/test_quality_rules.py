"""Thresholds that follow sources."""

import math
import random

import pytest

from densityflow.llm import quality_rules as q


def text(r, marks, n=80):
    return " ".join(f"word{r.randrange(10**4)}" + ("###" if r.random() < marks else "") for _ in range(n))


def test_one_row_passes_in_one_source_and_fails_in_another(spark):
    r = random.Random(2)
    rows = [(i, text(r, 0.5 if i % 2 else 0.02), "en", "code" if i % 2 else "news") for i in range(400)]
    same = text(r, 0.5)
    rows += [(1000, same, "en", "code"), (1001, same, "en", "news"), (1002, same, "en", None), (1003, same, None, "news")]
    got = {x.doc_id: x.quality for x in q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[1000].kept
    assert not got[1001].kept
    assert got[1000].limits.punctuation.most > got[1001].limits.punctuation.most
    assert sum(got[i].kept for i in range(400)) >= 396


def test_given_rows_meet_other_limits_in_other_sources(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [x.quality for x in q.quality_rules(docs).collect() if x.quality.n_words >= 10]
    limits = {x.limits for x in got}
    assert len(limits) > 60

    def passes(x, lim):
        return all(lim[k].least - v * lim[k].mid / math.sqrt(x.n_words) <= x[k] <= lim[k].most + v * lim[k].mid / math.sqrt(x.n_words) for k, v in q.RULES.items())

    assert all(passes(x, x.limits) == x.kept for x in got if not x.base_failed)
    assert any(len({passes(x, lim) for lim in limits}) == 2 for x in got if x.kept)
    assert any(len({passes(x, lim) for lim in limits}) == 2 for x in got if not x.kept and not x.base_failed)


def test_sketches_merge_and_hold_their_error(spark):
    r = random.Random(3)
    rows = [(i, text(r, 0.1, r.randrange(10, 60)), "en", f"s{i % 3}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sketch = q.sketches(docs)
    parts = [q.sketches(docs.where(f"doc_id % 2 = {k}")) for k in range(2)]
    for group in ([], ["lang"], ["lang", "source"]):
        whole = sorted(map(tuple, q.quartiles(sketch, group).collect()))
        assert whole == sorted(map(tuple, q.quartiles(parts[0].unionByName(parts[1]), group).collect()))
    exact = sorted(sum(map(len, t.split())) / len(t.split()) for _, t, _, _ in rows)
    found = q.quartiles(sketch, []).where("rule = 'mean_word'").first()
    for k, name in enumerate(q.QUARTILES, 1):
        assert found[name] == pytest.approx(exact[math.ceil(k * 300 / 4) - 1], rel=0.003)
