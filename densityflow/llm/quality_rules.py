"""Operator 2: quality rules whose thresholds follow the data.

Each (language, source) has quantile sketches of what its documents of LEAST_WORDS words or more look
like: mean word length, and the shares of punctuation and symbols, of capitals and of distinct words.
A sketch is a table of log-spaced bucket counts (relative error a quarter of a percent): sketches merge
by adding counts, so that partial aggregation does the work and coarser sketches (language, all) come
from the fine ones. A group's quartiles are blended with its language's as if PRIOR of its documents
came from there, and a language's with those of all, so that small groups need no case of their own.

A document passes a rule if its value lies within SPREAD times the distance from the median to the
lower and upper quartile, plus what a text so short varies by chance: a multiple of the median over the
square root of its words. All of it follows from the sketches: there is no fixed cutoff. Thresholds are
joined back to the documents, which are filtered by them. DataFrame functions only; texts are never
shuffled.

Defined results: a null text has no words and fails the base rules; null lang or source form groups
of their own; an empty table gives an empty result; repeated rows each get their verdict; other
columns of the input are carried along untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densityflow.llm.common import cut, fresh, if_small, let, words

GAMMA = 1.005
ZERO_BUCKET = -100_000
SPREAD = 6.0
PRIOR = 50.0
LEAST_WORDS = 10
#: Rules, and how much their values vary by chance in a text of one word, by their median.
RULES = {"mean_word": 2.0, "punctuation": 8.0, "capitals": 8.0, "distinct": 1.0}
QUARTILES = ("low", "mid", "high")


def _per(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def _shape(ws: Column) -> Column:
    """Struct of the counts and rules that words alone give."""

    def of(s: Column) -> Column:
        n, chars = F.size(ws), F.char_length(s)
        marks = F.char_length(F.regexp_replace(s, r"[\p{L}\p{N}]+", ""))
        capitals = chars - F.char_length(F.regexp_replace(s, r"[A-ZÀ-ÖØ-Þ]+", ""))
        return F.struct(
            n.cast("long").alias("n_words"),
            chars.cast("long").alias("word_chars"),
            (chars - F.char_length(F.translate(s, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            _per(chars, n).alias("mean_word"),
            _per(marks, chars).alias("punctuation"),
            _per(capitals, chars).alias("capitals"),
            _per(F.size(F.array_distinct(ws)), n).alias("distinct"),
        )

    return let(F.array_join(ws, ""), of)


def _repeats(ws: Column) -> Column:
    """How many words stand in five-word windows that the text has twice or more."""

    def of_sorted(s: Column) -> Column:
        twice = F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
        none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(starts, none, lambda a, p: F.struct((a["n"] + p + 5 - F.greatest(a["end"], p)).alias("n"), (p + 5).alias("end")), lambda a: a["n"])

    def of_hashes(h: Column) -> Column:
        # only texts with a repeated window pay for sorting (hash, position) pairs
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(pairs, of_sorted)).otherwise(F.lit(0))

    windows = F.transform(F.sequence(F.lit(0), F.size(ws) - 5), lambda i: F.xxhash64(*[ws[i + k] for k in range(5)]))
    return F.when(F.size(ws) >= 5, let(windows, of_hashes)).otherwise(F.lit(0))


def _repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def sketches(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, rule, bucket, n): a row for each bucket in use, stored."""
    shaped = docs.select(F.col(lang).alias("lang"), F.col(source).alias("source"), let(words(F.col(text)), _shape).alias("s"))
    shaped = shaped.where(F.col("s.n_words") >= LEAST_WORDS)
    rules = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"s.{k}").alias("x")) for k in RULES]))
    rows = shaped.select("lang", "source", rules.alias("r"))
    bucket = F.when(F.col("r.x") > 0, F.ceil(F.log(F.col("r.x")) / F.lit(math.log(GAMMA)))).otherwise(F.lit(ZERO_BUCKET))
    return cut(rows.groupBy("lang", "source", F.col("r.rule").alias("rule"), bucket.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n")))


def quartiles(sketch: DataFrame, group: list[str]) -> DataFrame:
    """(group, rule, total, low, mid, high) from sketches merged by group."""
    key = [*group, "rule"]
    sums = sketch.groupBy(*key, "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*key)
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sums.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(whole))
    value = F.when(F.col("bucket") == ZERO_BUCKET, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (1 + GAMMA))
    at = [F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, value)).alias(q) for k, q in enumerate(QUARTILES, 1)]
    return ranked.groupBy(*key).agg(F.max("total").cast("double").alias("total"), *at)


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, limits): a row for each group; limits has a struct (least, mid, most) by rule."""

    def blended(own: DataFrame, upper: DataFrame, on: list[str]) -> DataFrame:
        upper = upper.select(*[F.col(c).alias(f"_{c}") for c in (*on, "rule", *QUARTILES)])
        cond = own["rule"] == upper["_rule"]
        for c in on:
            cond = cond & own[c].eqNullSafe(upper[f"_{c}"])
        values = [((F.col("total") * F.col(q) + PRIOR * F.col(f"_{q}")) / (F.col("total") + PRIOR)).alias(q) for q in QUARTILES]
        return own.join(upper, cond).select(*[c for c in own.columns if c not in QUARTILES], *values)

    every = F.broadcast(quartiles(sketch, []))  # a row for each rule
    by_lang = blended(quartiles(sketch, ["lang"]), every, [])
    by_source = blended(quartiles(sketch, ["lang", "source"]), by_lang, ["lang"])
    low, mid, high = (F.col(q) for q in QUARTILES)
    limit = F.struct((mid - SPREAD * (mid - low)).alias("least"), mid.alias("mid"), (mid + SPREAD * (high - mid)).alias("most"))
    wide = by_source.groupBy("lang", "source").agg(*[F.first(F.when(F.col("rule") == k, limit), ignorenulls=True).alias(k) for k in RULES])
    return wide.select("lang", "source", F.struct(*RULES).alias("limits"))


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", out: str = "quality") -> DataFrame:
    """docs with one more column, a struct: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, and each rule's value and limits."""
    taken = list(docs.columns)
    lang_key, source_key, limits_key = (fresh(f"_q_{k}", taken) for k in ("lang", "source", "limits"))
    limits = thresholds(sketches(docs, text, lang, source))
    # a row for each (language, source): few beside the documents
    limits = if_small(cut(limits.select(F.col("lang").alias(lang_key), F.col("source").alias(source_key), F.col("limits").alias(limits_key))))
    full = docs.join(limits, docs[lang].eqNullSafe(limits[lang_key]) & docs[source].eqNullSafe(limits[source_key]), "left")

    def within(s: Column) -> Column:
        ok = F.lit(True)
        for k, varies in RULES.items():
            limit = F.col(limits_key)[k]
            chance = varies * limit["mid"] / F.sqrt(s["n_words"].cast("double"))
            ok = ok & (s[k] <= limit["most"] + chance) & (s[k] >= limit["least"] - chance)
        return F.coalesce(ok, F.lit(False))

    def verdict(s: Column, repeats: Column, lines: Column) -> Column:
        failed = (s["n_words"] < LEAST_WORDS) | (100 * repeats > 20 * s["n_words"])
        fields = [s[k].alias(k) for k in ("n_words", "word_chars", "n_symbols")] + [lines.cast("long").alias("n_dup_lines"), repeats.cast("long").alias("n_repeat_words")]
        fields += [failed.alias("base_failed"), (~failed & within(s)).alias("kept"), *[s[k].alias(k) for k in RULES], F.col(limits_key).alias("limits")]
        return F.struct(*fields)

    # one expression with its parts bound inside: a filter on it, which Spark moves down and puts in place
    # of the column, still works it out once
    parts = let(words(F.col(text)), lambda ws: F.struct(_shape(ws).alias("s"), _repeats(ws).alias("r")))
    judged = let(parts, lambda p: verdict(p["s"], p["r"], _repeated_lines(F.col(text))))
    return full.select(*[docs[c] for c in docs.columns], judged.alias(fresh(out, taken)))
