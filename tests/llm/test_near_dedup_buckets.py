"""Buckets whose members are all alike and yet not linked, and links that no star finds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from densityflow.llm import near_dedup
from densityflow.llm.shingles import fingerprint


def sets_table(spark, sets):
    rows = [(fingerprint(np.array(sorted(s), dtype=np.uint64)), len(s), [int(v) for v in sorted(s)]) for s in sets]
    return spark.createDataFrame(rows, "fp binary, n long, hs array<bigint>").withColumn("root", F.col("fp")), [r[0] for r in rows]


def test_sets_of_one_root_make_no_pair(spark):
    r = random.Random(1)
    base = set(range(1, 60))
    sets = [base - {k} for k in range(1, 30)] + [{k + 1000 for k in base} - {1000 + r.randrange(1, 60)} for _ in range(3)]
    sets = [s for i, s in enumerate(sets) if s not in sets[:i]]
    table, names = sets_table(spark, sets)
    one = table.withColumn("root", F.when(F.element_at("hs", 1) < 1000, F.lit("a")).otherwise(F.lit("b")).cast("binary"))
    assert near_dedup._prefix_pairs(one, 85).count() == 0
    two = table.withColumn("root", F.when(F.col("fp") == names[0], F.lit("z")).otherwise(F.lit("a")).cast("binary"))
    assert {frozenset((bytes(x.x), bytes(x.y))) for x in near_dedup._prefix_pairs(two, 85).collect()} >= {frozenset((names[0], n)) for n, s in zip(names[1:], sets[1:], strict=True) if min(s) < 1000}


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_prefixes_lose_no_pair(spark, percent):
    r = random.Random(percent)
    sets = []
    for _ in range(25):
        base = {r.randrange(1, 400) for _ in range(r.randrange(1, 60))}
        for _ in range(5):
            s = {v for v in base if r.random() < 1 - (100 - percent) / 300} | {r.randrange(1, 400) for _ in range(r.randrange(0, 2 + (100 - percent) // 8))}
            if s and s not in sets:
                sets.append(s)
    table, names = sets_table(spark, sets)
    got = {frozenset((bytes(x.x), bytes(x.y))) for x in near_dedup._prefix_pairs(table, percent).collect()}
    near = {frozenset((names[i], names[j])) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    assert near <= got
    assert len(near) > 10
    assert len(got) < len(sets) * (len(sets) - 1) // 4


def test_a_bucket_of_thousands_just_below_the_threshold(spark):
    """Each of 5,000 sets shares 100 shingles with all others and has 9 of its own: 100 / 118 < 0.85."""
    n = 5000
    hs = F.concat(F.sequence(F.lit(1).cast("long"), F.lit(100).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.lit(1000) + F.col("id") * 9 + k))
    table = spark.range(n).select(F.encode(F.col("id").cast("string"), "utf-8").alias("fp"), F.lit(109).cast("long").alias("n"), hs.alias("hs")).withColumn("root", F.col("fp"))
    assert near_dedup._prefix_pairs(table, 85).count() == 0
    linked = near_dedup._prefix_pairs(table.limit(40), 80).count()
    assert linked == 40 * 39 // 2  # at 0.8 they are pairs


def test_texts_just_below_the_threshold_stay_apart(spark):
    """300 texts of one core with tails of their own meet in buckets; two of them are near to each other only."""
    core = " ".join(f"c{k}" for k in range(104))
    texts = [f"{core} " + " ".join(f"t{i}x{k}" for k in range(9)) for i in range(300)]
    texts.append(texts[7].replace("t7x8", "other"))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(df, 85).collect()}
    assert got[300] == 7
    assert all(got[i] == i for i in range(300))


def test_components_of_few_links_shuffle_for_sums_alone(spark, monkeypatch):
    # a chain, a star and pairs
    links = [(k, k + 1) for k in range(1, 9)] + [(500, k) for k in range(501, 530)] + [(k, k + 1000) for k in range(600, 610)]
    plans = []
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    cut = near_dedup.cut
    monkeypatch.setattr(near_dedup, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    try:
        found = dict(near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found == {k: 1 for k in range(1, 10)} | {k: 500 for k in range(500, 530)} | {k: k % 1000 for p in links[-10:] for k in p}
    assert not [p for p in plans if "SortMergeJoin" in p] and max(p.count("Exchange hashpartitioning") for p in plans) == 1
