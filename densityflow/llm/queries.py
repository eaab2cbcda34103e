"""A query for each operator, over its whole table with production parameters, and SQL to check it by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densityflow.llm import classifier, decontamination, html_text, language_model, license_scan, near_dedup, packing, phrases, quality_rules, runs, sharding, simhash, warc
from densityflow.llm.common import table


def op1_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules.quality_rules(docs, out="q").select("doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "q.base_failed", "q.kept")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 16)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: they stand in source/lang/block directories by their columns, one in
    ten a level higher and one in a hundred two."""
    i = F.col("doc_id")
    block = F.floor(i / 1000).cast("string")
    name = F.concat(i.cast("string"), F.lit(".txt"))
    path = F.when(i % 100 == 0, F.concat_ws("/", "source", name)).when(i % 10 == 0, F.concat_ws("/", "source", "lang", name)).otherwise(F.concat_ws("/", "source", "lang", block, name))
    out = license_scan.licences(table(spark, sf_dir, "documents").withColumn("path", path))
    return out.withColumn("cosine", F.round("cosine", 6))


def op6_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 0.8)
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", F.round("containment", 6).alias("containment"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pitman_yor_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents"))


def op9_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return runs.digests(runs.periodic_runs(docs.select("doc_id", runs.looped(F.col("doc_id"), F.col("text")).alias("text"))))


#: Rules of operator 2, and how much they vary by chance.
RULES = {"mean_word": 2, "punctuation": 8, "capitals": 8, "distinct": 1}

QUERIES = {
    "op1_warc_zstd": op1_warc_zstd,
    "op2_quality_rules": op2_quality_rules,
    "op3_main_text": op3_main_text,
    "op4_minimax_shards": op4_minimax_shards,
    "op5_license_scan": op5_license_scan,
    "op6_benchmark_containment": op6_benchmark_containment,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_pitman_yor_lm": op8_pitman_yor_lm,
    "op9_length_packing": op9_length_packing,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_simhash_near_dedup": op12_simhash_near_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}

WORDS = "list_filter(regexp_split_to_array(coalesce({0}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

ORACLES = {
    "op2_quality_rules": """
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, """ + WORDS.format("text") + """ AS ws FROM documents
), lines AS (
  SELECT doc_id, lang, source, t, ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
    CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) ELSE [] END AS g
  FROM w
), reps AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM (
        SELECT doc_id, unnest(g) AS s, unnest(range(1, len(g) + 1)) AS i FROM lines)) WHERE c >= 2) GROUP BY doc_id
), base AS (
  SELECT l.doc_id, lang, source, len(ws)::BIGINT AS n_words, array_to_string(ws, '') AS sq, len(list_distinct(ws)) AS n_distinct,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM lines l LEFT JOIN reps r USING (doc_id)
), shape AS (
  SELECT *, length(sq)::BIGINT AS word_chars,
    CASE WHEN n_words > 0 THEN length(sq)::DOUBLE / n_words ELSE 0 END AS mean_word,
    CASE WHEN length(sq) > 0 THEN length(regexp_replace(sq, '[\\p{L}\\p{N}]+', '', 'g'))::DOUBLE / length(sq) ELSE 0 END AS punctuation,
    CASE WHEN length(sq) > 0 THEN length(regexp_replace(sq, '[^A-ZÀ-ÖØ-Þ]+', '', 'g'))::DOUBLE / length(sq) ELSE 0 END AS capitals,
    CASE WHEN n_words > 0 THEN n_distinct::DOUBLE / n_words ELSE 0 END AS "distinct" FROM base
), long AS (
  SELECT lang, source, rule, CASE WHEN x > 0 THEN ceil(ln(x) / ln(1.005))::BIGINT ELSE -100000 END AS bucket
  FROM (UNPIVOT (SELECT doc_id, lang, source, mean_word, punctuation, capitals, "distinct" FROM shape WHERE n_words >= 10)
    ON mean_word, punctuation, capitals, "distinct" INTO NAME rule VALUE x)
), sk AS (
  SELECT 2 AS level, lang, source, rule, bucket, count(*) AS n FROM long GROUP BY ALL UNION ALL
  SELECT 1, lang, NULL, rule, bucket, count(*) FROM long GROUP BY ALL UNION ALL
  SELECT 0, NULL, NULL, rule, bucket, count(*) FROM long GROUP BY ALL
), cum AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rule) AS total,
    CASE WHEN bucket = -100000 THEN 0 ELSE 2 * pow(1.005, bucket) / 2.005 END AS value FROM sk
), q AS (
  SELECT level, lang, source, rule, total::DOUBLE AS total, min(value) FILTER (upto * 4 >= total) AS low, min(value) FILTER (upto * 4 >= total * 2) AS mid,
    min(value) FILTER (upto * 4 >= total * 3) AS high FROM cum GROUP BY ALL
), ql AS (
  SELECT l.lang, l.rule, (l.total * l.low + 50e0 * a.low) / (l.total + 50e0) AS low, (l.total * l.mid + 50e0 * a.mid) / (l.total + 50e0) AS mid,
    (l.total * l.high + 50e0 * a.high) / (l.total + 50e0) AS high FROM q l JOIN q a ON a.level = 0 AND a.rule = l.rule WHERE l.level = 1
), qs AS (
  SELECT s.lang, s.source, s.rule, (s.total * s.low + 50e0 * l.low) / (s.total + 50e0) AS low, (s.total * s.mid + 50e0 * l.mid) / (s.total + 50e0) AS mid,
    (s.total * s.high + 50e0 * l.high) / (s.total + 50e0) AS high FROM q s JOIN ql l ON s.lang IS NOT DISTINCT FROM l.lang AND s.rule = l.rule WHERE s.level = 2
), wide AS (
  SELECT lang, source, """ + ", ".join(f"max(mid - 6e0 * (mid - low)) FILTER (rule = '{k}') AS {k}_least, max(mid) FILTER (rule = '{k}') AS {k}_mid, max(mid + 6e0 * (high - mid)) FILTER (rule = '{k}') AS {k}_most" for k in RULES) + """
  FROM qs GROUP BY ALL
), judged AS (
  SELECT r.*, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, w.* EXCLUDE (lang, source)
  FROM shape r LEFT JOIN wide w ON r.lang IS NOT DISTINCT FROM w.lang AND r.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(
  """ + " AND ".join(f'"{k}" <= {k}_most + {v}e0 * {k}_mid / sqrt(n_words) AND "{k}" >= {k}_least - {v}e0 * {k}_mid / sqrt(n_words)' for k, v in RULES.items()) + """, false) AS kept FROM judged""",
    "op6_benchmark_containment": """
WITH d AS (
  SELECT doc_id, """ + WORDS.format("lower(text)") + """ AS ws FROM documents
), i AS (
  SELECT item_id, """ + WORDS.format("lower(text)") + """ AS ws FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k+4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM d
), sh AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k+4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM i
), n AS (SELECT item_id, count(*) AS n_shingles FROM sh GROUP BY 1
), hit AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN sh USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, round(n_shared / n_shingles, 6) AS containment
FROM hit JOIN n USING (item_id) WHERE n_shared >= 0.8e0 * n_shingles - 1e-9""",
    "op1_warc_zstd": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
), r AS (SELECT *, payload_bytes >= 100 AND page_id IS DISTINCT FROM first AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to FROM r""",
    "op10_minhash_near_dedup": """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k+4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(node, other) AS (
  SELECT x, y FROM ways UNION SELECT r.node, b.y FROM reach r JOIN ways b ON r.other = b.x
), comp AS (SELECT node, min(other) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.node = d.doc_id""",
    "op11_phrase_collocations": """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p
), total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1
), g AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i+k-1], ' '))) AS phrase
    FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)) GROUP BY ALL HAVING count(*) >= 30
), parts AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS ws FROM g
), inner_of AS (
  SELECT lang, f, array_to_string(ws[i:i+m-1], ' ') AS phrase FROM (
    SELECT lang, f, ws, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM parts WHERE k >= 3))
), most AS (SELECT lang, phrase, max(f) AS longer FROM inner_of GROUP BY ALL
), kept AS (
  SELECT lang, k, phrase, ws, f AS a FROM parts LEFT JOIN most USING (lang, phrase) WHERE k >= 2 AND (longer IS NULL OR 100 * longer < 80 * f)
), cuts AS (
  SELECT lang, k, phrase, a, c, array_to_string(ws[1:c], ' ') AS head, array_to_string(ws[c+1:k], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, c, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
  FROM cuts JOIN g x ON x.lang = cuts.lang AND x.phrase = head JOIN g y ON y.lang = cuts.lang AND y.phrase = tail
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
}
