"""Quality rules: repetition and length rules, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed word unigrams and bigrams: one counted over the trusted documents,
one over the whole corpus. A document's score is the mean log ratio of its n-grams; the verdict is a fixed threshold
on it. Everything is a DataFrame expression: a text's features come from its own array of words, without a shuffle,
and only the counts, at most `buckets` numbers, are gathered.

Defined cases: null and blank texts have no words and fail the base rules; without trusted documents or without any
words the score is 0, which passes; a score equal to the threshold passes; repeated rows count as often as they occur;
texts are read whole, however long; a document is trusted if one of its labels says so; columns of the input are kept
whatever their names, but those named like an added one (see `judged`) are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hardwood.llm.common import SPACES, broadcast_if_small, table, words

BUCKETS = 1 << 14
#: Mean log ratio per n-gram below which a document fails.
THRESHOLD = -0.1
#: Trusted ids that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
SYMBOLS = "#*$%&|<>"
WINDOW = 8

_ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def _pairs(a: Column, n: Column, step: int) -> Column:
    """Hash of a[i] and a[i + step] for every i of the n leading ones."""
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + step), n), lambda x, y: F.xxhash64(x, y))


def _hashes(docs: DataFrame, text: str) -> DataFrame:
    """Adds _w (words), _h (hash of each) and _h2 (hash of each two in a row)."""
    d = docs.withColumn("_w", words(F.col(text)))
    d = d.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    return d.withColumn("_h2", _pairs(F.col("_h"), F.greatest(F.size("_h") - 1, F.lit(0)), 1))


def _base_features(d: DataFrame, text: str) -> DataFrame:
    """n_words .. base_failed from the columns of _hashes."""
    t = F.coalesce(F.col(text), F.lit(""))
    spaceless = F.translate(t, SPACES, "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    d = d.withColumn("_lines", lines).withColumn("_n", F.size("_w"))
    d = d.withColumn("_h4", _pairs(F.col("_h2"), F.greatest(F.col("_n") - 3, F.lit(0)), 2))
    d = d.withColumn("_h8", _pairs(F.col("_h4"), F.greatest(F.col("_n") - 7, F.lit(0)), 4))
    # Only texts with a window found twice go on: their windows sorted, so that equal ones are neighbours.
    d = d.withColumn("_h8", F.when(F.size(F.array_distinct("_h8")) < F.size("_h8"), F.col("_h8")).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("_s", F.array_sort(F.transform("_h8", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    m = F.greatest(F.size("_s") - 1, F.lit(0))
    same = F.zip_with(F.slice("_s", F.lit(1), m), F.slice("_s", F.lit(2), m), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    d = d.withColumn("_at", F.array_sort(F.array_distinct(F.flatten(same))))
    k = F.greatest(F.size("_at") - 1, F.lit(0))
    steps = F.zip_with(F.slice("_at", F.lit(1), k), F.slice("_at", F.lit(2), k), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(F.size("_at") > 0, F.aggregate(steps, F.lit(WINDOW), lambda acc, x: acc + x)).otherwise(F.lit(0))
    d = d.withColumn("n_words", F.col("_n").cast("long")).withColumn("word_chars", F.length(spaceless).cast("long"))
    d = d.withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    d = d.withColumn("n_repeat_words", covered.cast("long"))
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))


def _bucket(buckets: int):
    return lambda h: F.pmod(h, F.lit(buckets)).cast("int")


def ratio_weights(docs: DataFrame, labels: DataFrame, text: str = "text", buckets: int = BUCKETS) -> list[float]:
    """Log ratio of the trusted to the raw multinomial for each bucket.

    Raw counts are smoothed by one; the trusted ones by `buckets` draws from the raw multinomial, so that few trusted
    documents say little: the fewer there are, the nearer every ratio is to 1.

    Trusted are the documents that labels marks with quality 1. Counts cover every document; each task sums its own
    n-grams by bucket before the shuffle, and the driver gets one row a bucket."""
    trusted = broadcast_if_small(labels.where("quality = 1").select(F.col("doc_id").alias("_id")).distinct(), BROADCAST_IDS)
    d = docs.select("doc_id", text).join(trusted, F.col("doc_id") == F.col("_id"), "left")
    d = _hashes(d.select(text, F.col("_id").isNotNull().cast("int").alias("_trusted")), text)
    grams = d.select("_trusted", F.explode(F.transform(F.concat("_h", "_h2"), _bucket(buckets))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("_trusted").alias("trusted")).collect()
    raw, target = sum(r.raw for r in counts), sum(r.trusted for r in counts)
    weights = [0.0] * buckets
    if target:
        weights = [math.log(buckets / (target + buckets))] * buckets
        for r in counts:
            p = (r.raw + 1) / (raw + buckets)
            weights[r.bucket] = math.log((r.trusted + buckets * p) / ((target + buckets) * p))
    return weights


def judged(docs: DataFrame, weights: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr (mean log ratio) and kept."""
    # A literal that the optimizer folds into one array, 16384 numbers of 7 characters.
    table_ = F.split(F.lit(",".join(f"{w:.4f}" for w in weights)), ",").cast("array<double>")
    bucket = _bucket(len(weights))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in _ADDED)).alias("_row"), F.col(text).alias("text"))
    d = _base_features(_hashes(rows, "text"), "text")

    def total(c: str) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda acc, h: acc + F.get(table_, bucket(h)))

    n = F.size("_h") + F.size("_h2")
    d = d.withColumn("llr", F.when(n > 0, (total("_h") + total("_h2")) / n).otherwise(F.lit(0.0)))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold)))
    return d.select("_row.*", *_ADDED)


def passing(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that pass, with the columns of docs."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    decided = judged(rows, ratio_weights(docs, labels), **options)
    # A plain filter would be pushed below the features, each of which it would then repeat for every use of it.
    once = decided.select(F.explode(F.array(F.struct("_row", "kept"))).alias("_d"))
    return once.where("_d.kept").select("_d._row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's features, base verdict and verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, ratio_weights(docs, table(spark, sf_dir, "labels"))).drop("text")


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE: dict[str, str] = {}
