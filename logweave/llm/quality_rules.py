"""Operator 9: quality rules and a hashed n-gram likelihood ratio. DataFrame functions only.

The base rules are counted on each row alone. For the method, words and signs (runs of either) are the units;
units and pairs of neighbours are hashed into ``BUCKETS`` buckets. The raw multinomial counts the buckets over
all documents, the trusted one over those that are labelled good; both are smoothed by one per bucket. A
document's score is the mean over its n-grams of log(trusted / raw), so its length doesn't matter, and it is
kept if that is not under ``THRESHOLD``: the same outcome at every run (no sampling).

The two count vectors are ``BUCKETS`` rows; counting sends on sums per task only, and the ratios reach the
plan as one constant array (as a column it would be copied into every row).

Of the labelled documents of sf0.1 all good ones score over the threshold (99 % over 0.003), and 76 % of the others
under it; at 0, 99.3 % of the good and 3 % of the others would stay. It is set so that good documents are safe.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import quoted

BUCKETS = 10_000
THRESHOLD = -0.25
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
BROADCAST_IDS = 1_000_000
WORD_BREAK = r"[\x20\x09-\x0D]+"
UNIT = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def _layers(plain: DataFrame) -> DataFrame:
    """doc_id, u (hashes of the units) and the base counts of (doc_id, text), in steps so that nothing is worked out twice."""
    counted = plain.select(
        "doc_id",
        unit_hashes(F.col("text")).alias("u"),
        F.array_remove(F.split("text", WORD_BREAK), "").alias("w"),
        F.length(F.regexp_replace("text", WORD_BREAK, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    held = ["doc_id", "u", "word_chars", "n_symbols"]
    numbered = counted.select(*held, (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "w", F.size("w").alias("n"))
    held += ["n_dup_lines", "n"]
    windows = F.transform(F.sequence(F.lit(1), F.col("n") - 2), lambda k: F.xxhash64(F.element_at("w", k), F.element_at("w", k + 1), F.element_at("w", k + 2)))
    hashed = numbered.select(*held, F.when(F.col("n") >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("h"))
    # only where some window is there twice: sort the windows with their places and mark equal neighbours
    twice = F.size("h") > F.size(F.array_distinct("h"))
    pairs = F.when(twice, F.sort_array(F.transform("h", lambda x, k: F.struct(x.alias("x"), k.alias("k"))))).otherwise(F.array().cast("array<struct<x:bigint,k:int>>"))
    ordered = hashed.select(*held, pairs.alias("s"))
    s = F.col("s")
    marked = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["x"] == x["x"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["x"] == x["x"])))
    covered = F.size(F.array_distinct(F.flatten(F.transform(marked, lambda x: F.array(x["k"], x["k"] + 1, x["k"] + 2)))))
    return ordered.select("doc_id", "u", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def unit_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u))


def grams(hashes: str) -> Column:
    """Buckets from the hashes of the units (a column): each unit, and each with the one before it."""
    h = F.col(hashes)
    one = F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
    two = F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, k: F.pmod(F.xxhash64(F.get(h, k), x), F.lit(BUCKETS)).cast("int"))
    return F.concat(one, two)


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n, good) over (text, trusted): all documents, and the trusted ones."""
    hashed = texts.select(unit_hashes(F.col("text")).alias("u"), "trusted")
    return hashed.select(F.explode(grams("u")).alias("bucket"), "trusted").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("trusted").alias("good"))


def log_ratios(texts: DataFrame) -> Column:
    """A constant array of the buckets' log(trusted / raw); all 0 where nothing is trusted."""
    counts = {r["bucket"]: (r["n"], r["good"]) for r in bucket_counts(texts).collect()}  # ``BUCKETS`` rows at most
    n, good = ([counts.get(b, (0, 0))[k] + 1 for b in range(BUCKETS)] for k in (0, 1))
    every, trusted = sum(n), sum(good)
    ratios = [math.log(g / trusted) - math.log(x / every) if trusted > BUCKETS else 0.0 for x, g in zip(n, good)]
    return F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to an array before it runs


def score_rules(
    docs: DataFrame,
    trusted_ids: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, base_failed, llr (the method's score) and kept.

    ``trusted_ids`` has the ids (column of the name of ``id_col``) of the trusted documents. A null or empty
    text has no words and fails. A text without units has score 0. Null ids are trusted by nothing; repeated
    rows come out repeated, and all count. Other columns are not read. An empty table gives an empty result.
    """
    plain = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    good = trusted_ids.select(F.col(quoted(id_col)).alias("__good")).where(F.col("__good").isNotNull()).distinct()
    if good.count() <= broadcast_ids:  # ids alone, some MB; more of them meet the documents by a shuffle
        good = F.broadcast(good)
    trusted = plain.join(good, F.col("doc_id") == F.col("__good"), "left").select("text", F.col("__good").isNotNull().cast("long").alias("trusted"))
    counted = _layers(plain)
    held = [c for c in counted.columns if c != "u"]
    gathered, ratios = counted.select(*held, grams("u").alias("g")), log_ratios(trusted)
    total = F.aggregate("g", F.lit(0.0), lambda a, b: a + F.get(ratios, b))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    scored = gathered.select(*held, failed.alias("base_failed"), F.when(F.size("g") > 0, total / F.size("g")).otherwise(0.0).alias("llr"))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
