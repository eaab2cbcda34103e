"""Recall of large benchmark items, and the pipeline from end to end against its stages composed by brute force."""

import random

from pyspark.sql import functions as F
from test_llm_small import brute_components, prose, shingles

from densityflow.llm import classifier, decontamination, packing, quality_rules
from densityflow.llm.common import table


def test_recall_of_items_of_many_shingles(spark):
    """Items of 64 to 600 shingles, of which a sketch is kept, at containments from 0.8 to 1, in long texts."""
    r = random.Random(12)
    items, texts, want = [], [], {}
    for k in range(150):
        w = [f"{r.choice('abcdefgh')}{r.randrange(5000)}" for _ in range(r.randrange(68, 605))]
        items.append(" ".join(w))
        broken = list(w)
        for _ in range(r.randrange(0, max(1, len(w) // 15))):
            broken[r.randrange(len(w))] = f"changed{r.randrange(1000)}"
        texts.append(f"{prose(k, r.randrange(5, 900))} {' '.join(broken)} {prose(k + 1, r.randrange(5, 900))}")
    sets = [shingles(t) for t in texts]
    for j, item in enumerate(items):
        s = shingles(item)
        for i in range(len(texts)):
            both = len(s & sets[i])
            if both >= 0.8 * len(s) - 1e-9:
                want[i, j] = (len(s), both)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontamination.contained(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench)
    got = {(x.doc_id, x.item_id): (x.n_shingles, x.n_shared) for x in found.collect()}
    assert 100 < len(want) < 150  # some items are changed too much
    assert got == want
    assert decontamination.sketches(bench.select(F.col("item_id").alias("item"), F.split("text", " ").alias("ws")), 0.8).groupBy("item").count().agg(F.max("count")).first()[0] == decontamination.SKETCH


def corpus(spark, path):
    """Good and bad texts, copies, near copies, one that holds a benchmark item."""
    r = random.Random(3)
    item = "this is a test item of some words that are here to be found in a text"
    good = [" ".join(f"{r.choice(['the', 'river', 'of', 'stone', 'and', 'light', 'under', 'green'])}" if r.random() < 0.5 else f"word{r.randrange(400)}" for _ in range(r.randrange(40, 120))) + "." for _ in range(60)]
    bad = [" ".join(f"BUY{r.randrange(9)} ### $$$ click{r.randrange(30)}" for _ in range(r.randrange(5, 30))) for _ in range(40)]
    texts = good + bad + [good[0], good[1] + " more", f"{good[2]} {item} {good[3]}", None, "", "short one"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(100) if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return {i: t for i, t in enumerate(texts)}, item


def test_pipeline_from_end_to_end(spark, tmp_path):
    import corpus_pipeline as p

    path = str(tmp_path)
    texts, item = corpus(spark, path)
    docs, labels = table(spark, path, "documents"), table(spark, path, "labels")
    scores = {r.doc_id: r.score for r in classifier.quality_scores(docs, labels).collect()}
    left = sorted(i for i, s in scores.items() if s >= 0.5)
    verdicts = {r.doc_id: r.q.kept for r in quality_rules.quality_rules(docs.where(F.col("doc_id").isin(left)), out="q").collect()}
    left = sorted(i for i in left if verdicts[i])
    classes, _ = brute_components([texts[i] for i in left], left, 80)
    left = sorted(set(classes))
    s = shingles(item)
    left = [i for i in left if len(s & shingles(texts[i])) < 0.8 * len(s) - 1e-9]
    want = packing.packed(docs.where(F.col("doc_id").isin(left))).collect()
    got = p.run(spark, path).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    kept = {r.doc_id for r in got}
    assert 30 < len(kept) < 61
    assert not kept & set(range(60, 100)) and 100 not in kept and 102 not in kept
