"""Quality rules (7): a hashed n-gram log-likelihood ratio between trusted and raw text, in DataFrame functions only.

Two passes over the texts. The first counts hashed word n-grams (one and two words, ``BUCKETS`` buckets) of all
documents and of the trusted ones, with a partial sum in each task; both multinomials have ``BUCKETS`` cells, so the
table of weights has a fixed size. The trusted multinomial is drawn towards the raw one by a Dirichlet prior of
``PRIOR`` n-grams, so that cells which few trusted texts reach count little. The second pass averages the weights over
each document's n-grams and compares with a fixed threshold.

Defined results: a null or blank text has no words, all counts 0, base_failed and not kept. Rows are judged one by one,
so repeated rows get equal answers. Without trusted documents all weights are 0 and the base rules alone decide. A null
doc_id is trusted by no label. Of columns besides doc_id and text nothing is read; ``keep`` returns them unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import WORDS_SQL, checked_broadcast, lookup_array, without_space, words_of

BUCKETS = 65_536
PRIOR = 4 * BUCKETS
THRESHOLD = -0.1
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"


def ngram_hashes(df: DataFrame, text: str) -> DataFrame:
    """df with words, one (hashes of single words), two (of pairs of neighbours) and three (of three-word windows).

    Each step is a projection of its own: several later expressions read it, so Catalyst computes it once a row.
    """
    df = df.withColumn("words", words_of(F.col(text)))
    df = df.withColumn("one", F.transform("words", lambda w: F.xxhash64(w)))

    def windows(k: int) -> Column:
        starts = F.slice("one", 1, F.greatest(F.size("one") - (k - 1), F.lit(0)))
        return F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get("one", i + j) for j in range(1, k)]))

    return df.withColumn("two", windows(2)).withColumn("three", windows(3))


def bucket_of(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def count_columns(text: Column) -> dict[str, Column]:
    """The base counts of a text that need no windows."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: without_space(x) != "")
    return {
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(without_space(text)).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def repeated_words(windows: Column) -> Column:
    """Words that lie in a three-word window found at least twice."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i"))))

    def twice(s: Column) -> Column:
        at = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(placed, twice)).cast("long")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The documents labelled good and not toxic."""
    return labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()


def weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> list[float]:
    """log(trusted share / raw share) by bucket, over all documents. The result has ``buckets`` numbers, whatever the input."""
    # null ids are spread over salts, so that a shuffle join does not gather them
    salt = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("text"), F.lit(1023))).otherwise(0)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k_id"), salt.cast("int").alias("k_salt"), "text")
    good = trusted_ids(labels).select(F.col("doc_id").cast("long").alias("k_id"), F.lit(0).alias("k_salt"), F.lit(1).alias("trusted"))
    marked = keyed.join(checked_broadcast(good), ["k_id", "k_salt"], "left")
    hashed = ngram_hashes(marked, "text").select(F.explode(F.concat("one", "two")).alias("h"), F.coalesce("trusted", F.lit(0)).alias("trusted"))
    grams = hashed.select(bucket_of(F.col("h"), buckets).alias("bucket"), "trusted")
    raw, good = [0] * buckets, [0] * buckets
    for r in grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("trusted").alias("t")).collect():  # at most `buckets` rows
        raw[r.bucket], good[r.bucket] = r.n, r.t
    n, t = sum(raw) + 0.5 * buckets, sum(good)
    if not t:
        return [0.0] * buckets
    return [round(math.log((g + prior * p) / (t + prior) / p), 6) for g, p in zip(good, [(x + 0.5) / n for x in raw])]


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, prior: float = PRIOR, counts: bool = True) -> DataFrame:
    """The documents with llr (log-likelihood ratio an n-gram), base_failed and kept, and the base counts if asked."""
    table = lookup_array(weights(docs, labels, buckets, prior))
    names = [c for c in docs.columns]
    row = ngram_hashes(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")), "row.text")

    def total(grams: str) -> Column:
        return F.aggregate(grams, F.lit(0.0), lambda acc, h: acc + F.get(table, bucket_of(h, buckets)))

    n_grams = F.greatest(F.size("one") + F.size("two"), F.lit(1))
    row = row.select("row", *[v.alias(k) for k, v in count_columns(F.col("row.text")).items()], repeated_words(F.col("three")).alias("n_repeat_words"), ((total("one") + total("two")) / n_grams).alias("llr"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    row = row.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] * counts + ["llr", "base_failed", "kept"]
    return row.select("row", *added)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def keep(docs: DataFrame, labels: DataFrame, prior: float = PRIOR) -> DataFrame:
    """The documents that pass, with their own columns."""
    judged = judge(docs, labels, prior=prior, counts=False)
    # the row number is not deterministic for Catalyst, so the filter stays above: pushed down, it would repeat the whole computation
    return judged.withColumn("nr", F.monotonically_increasing_id()).where("kept and nr >= 0").select("row.*")


def op7_quality_llr(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def base_counts(spark, sf_dir: str) -> DataFrame:
    """The base counts of every document alone, for which there is SQL; op7 gives them beside the method's verdict."""
    row = ngram_hashes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "text")
    counted = row.select("doc_id", *[v.alias(k) for k, v in count_columns(F.col("text")).items()], repeated_words(F.col("three")).alias("n_repeat_words"))
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


SQL = f"""
with t as (select doc_id, coalesce(text, '') as text, {WORDS_SQL.format("coalesce(text, '')")} as words from documents),
w as (select doc_id, unnest(range(1, len(words) - 1)) as i, words from t), g as (select doc_id, i, count(*) over (partition by doc_id, words[i], words[i + 1], words[i + 2]) as k from w),
r as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from g where k > 1) group by doc_id),
c as (select t.doc_id, len(words) as n_words, cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars, length(text) - length(translate(text, '{SYMBOLS}', '')) as n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines, coalesce(r.n, 0) as n_repeat_words from t left join r on r.doc_id = t.doc_id)
select doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from c
"""
