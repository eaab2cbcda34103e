"""Scratch tables of operators that run at the same time."""

from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

import pytest

from densityflow.llm import common, decontamination, quality_rules
from densityflow.llm.common import cut, table, tidy


def test_each_thread_keeps_its_own(spark):
    meet = Barrier(2, timeout=60)
    kept = {}

    @tidy
    def operator(name, n):
        mine = cut(spark.range(n))
        kept[name] = mine
        meet.wait()
        out = cut(mine.where("id % 2 = 0"))
        meet.wait()
        return out

    with ThreadPoolExecutor(2) as pool:
        first, second = pool.submit(operator, "a", 10), pool.submit(operator, "b", 20)
        assert (first.result().count(), second.result().count()) == (5, 10)
    assert spark.conf.get(common.LET_GO, None) != "true"
    for t in kept.values():
        with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
            spark.read.schema("id long").parquet(*{f.rsplit("/", 1)[0] for f in t.inputFiles()}).count()


def test_what_a_failed_operator_made_goes(spark):
    made = []

    @tidy
    def operator():
        made.append(cut(spark.range(3)))
        raise KeyError("no")

    with pytest.raises(KeyError):
        operator()
    assert common._made.get() is None
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        made[0].count()


def test_nested_operators_keep_what_the_outer_one_needs(spark):
    @tidy
    def inner(n):
        return cut(spark.range(n)).where("id > 0")

    @tidy
    def outer():
        one = inner(5)
        two = inner(7)
        return one.union(two)

    assert outer().count() == 10


def test_two_queries_at_once(spark, sf):
    docs = table(spark, sf, "documents")
    with ThreadPoolExecutor(2) as pool:
        a = pool.submit(decontamination.contained, docs, table(spark, sf, "benchmark"), 0.8)
        b = pool.submit(quality_rules.quality_rules, docs.select("doc_id", "text", "lang", "source"), out="q")
        assert b.result().count() == docs.count()
        assert a.result().count() >= 0
