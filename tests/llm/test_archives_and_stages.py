"""Archives of bounded size, the classifier against plain loops, and the stages of the pipeline."""

import random

import numpy as np
from pyspark.sql import functions as F

from densityflow.llm import classifier, packing, quality_rules, warc
from densityflow.llm.common import table


def test_archives_are_bounded_and_each_has_the_dictionary(spark, tmp_path):
    r = random.Random(1)
    rows = [(k, f"http://h/{k}", "".join(r.choice("abcdefgh <>&") for _ in range(3000))) for k in range(60)] + [(100, "http://h/long", "x" * 2_000_000), (101, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    path = str(tmp_path / "archives")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "3")
    try:
        warc.write_archives(pages, path, most=20_000)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").collect()
    assert len(files) > 4
    for f in files:
        data = bytes(f.content)
        first = next(warc.split_frames(data))
        assert first[0] == warc.DICTIONARY_MAGIC
        assert len(data) - len(first[1]) < 20_000 + 10_000
    got = {x.page_id: x for x in warc.read_archives(spark, path).collect()}
    assert all(x.error is None for x in got.values())
    assert {k: (bytes(x.payload).decode(), x.url) for k, x in got.items()} == {k: (h or "", u) for k, u, h in rows}


def sample(spark, n=90):
    r = random.Random(4)
    rows = []
    for i in range(n):
        good = i % 3 != 0
        text = " ".join((f"word{r.randrange(200)}" if good else f"junk{r.randrange(9)}###") for _ in range(r.randrange(5, 60)))
        rows.append((i, text, "en", "s", len(text)))
    docs = spark.createDataFrame([*rows, (None, "no id", "en", "s", 5), (500, None, None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(n) if i % 5] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_classifier_equals_plain_loops(spark):
    docs, labels = sample(spark)
    got = {r.doc_id: r.score for r in classifier.quality_scores(docs, labels).collect()}
    rows = docs.join(labels.where("quality IS NOT NULL"), "doc_id").where(~classifier.held_out())
    rows = rows.select("doc_id", "text", F.col("quality").cast("double").alias("label"), F.pmod(F.xxhash64("doc_id"), F.lit(classifier.SHARDS)).alias("shard"))
    rows = rows.orderBy("shard", F.xxhash64("doc_id", "label"), "doc_id").collect()

    def features(text):
        return [(int(i), float(v)) for i, v in zip(*next(iter(classifier.batch_features([text]))), strict=True)]

    def weight(z, n):
        return 0.0 if abs(z) <= classifier.L1 else -(z - np.sign(z) * classifier.L1) / ((classifier.BETA + n**0.5) / classifier.ALPHA + classifier.L2)

    z, n = {}, {}
    for _ in range(classifier.PASSES):
        states = []
        for shard in sorted({r.shard for r in rows}):
            zs, ns = dict(z), dict(n)
            for r in (r for r in rows if r.shard == shard):
                x = features(r.text)
                w = {i: weight(zs.get(i, 0.0), ns.get(i, 0.0)) for i, _ in x}
                p = 1 / (1 + np.exp(-np.clip(sum(w[i] * v for i, v in x), -35, 35)))
                for i, v in x:
                    g = (p - r.label) * v
                    sigma = ((ns.get(i, 0.0) + g * g) ** 0.5 - ns.get(i, 0.0) ** 0.5) / classifier.ALPHA
                    zs[i] = zs.get(i, 0.0) + g - sigma * w[i]
                    ns[i] = ns.get(i, 0.0) + g * g
            states.append((zs, ns))
        keys = {i for zs, _ in states for i in zs}
        z, n = ({i: old.get(i, 0.0) + sum(s[k].get(i, 0.0) - old.get(i, 0.0) for s in states) / len(states) for i in keys} for k, old in enumerate((z, n)))
    for r in docs.where("doc_id IS NOT NULL").collect():
        dot = sum(weight(z.get(i, 0.0), n.get(i, 0.0)) * v for i, v in features(r.text or ""))
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-np.clip(dot, -35, 35)))) < 1e-5


def write(spark, path, docs, labels):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "a test item of some words that are here")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_decide_as_their_operators(spark, tmp_path):
    import corpus_pipeline as p

    docs, labels = sample(spark)
    write(spark, str(tmp_path), docs, labels)
    docs = table(spark, str(tmp_path), "documents")
    stage = dict(p.STAGES)
    scores = {r.doc_id: r.score for r in classifier.quality_scores(docs, labels).collect()}
    kept = stage["quality_classifier"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i or -1 for i, s in scores.items() if s >= 0.5)
    verdicts = {r.doc_id: r.quality.kept for r in quality_rules.quality_rules(docs).collect()}
    kept = stage["quality_rules"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i or -1 for i, ok in verdicts.items() if ok)
    packed = stage["packing"](spark, docs, str(tmp_path))
    assert sorted(map(repr, packed.collect())) == sorted(map(repr, packing.packed(docs).collect()))
    assert packed.count() == docs.count()


def test_pipeline_of_empty_and_null_corpora(spark, tmp_path):
    import corpus_pipeline as p

    docs, labels = sample(spark)
    write(spark, str(tmp_path / "empty"), docs.where("false"), labels.where("false"))
    assert p.run(spark, str(tmp_path / "empty")).collect() == []
    nulls = docs.select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]).limit(5)
    write(spark, str(tmp_path / "nulls"), nulls, labels)
    assert p.run(spark, str(tmp_path / "nulls")).count() <= 5
