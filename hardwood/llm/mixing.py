"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source the keys form one random order, cut into key ranges, whose
number follows from the number of documents; sums per range, running sums over the ranges and a running sum inside each
range give each key the number of words before it. A source's budget is then some whole epochs and a rest, and the cut
falls where the rest is used up. Documents are held against their source's cut where they are.

Defined cases: null or blank texts have size 0 and are never taken; a null source is a source of its own; documents
that share an id, or have none, get keys of their own by their texts; rows that repeat both are separate documents with
one key, in any order, as they can't be told apart: they are counted as one row before they are dealt, and numbered
part by part if the cut falls among them; sources are ordered in one task, a row each; texts are read whole; an empty table gives no rows; columns of the
input are kept, and those named like an added column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hardwood.llm.common import Scratch, broadcast_if_small, table, word_count

#: Hex digits of the key that name its range, at least: 4096 ranges a source; and documents of a range about.
RANGE_DIGITS, RANGE_ROWS = 3, 50_000
#: Sources whose cuts may be broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def with_sizes(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: str = "mix-1") -> DataFrame:
    """Adds size (words), _src (source, told apart from null) and _key (hash-random by id and text, 32 hex digits)."""
    parts = [F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("null"))]
    return (
        docs.withColumn("size", word_count(F.col(text)))
        .withColumn("_src", F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source))))
        .withColumn("_key", F.md5(F.concat_ws(":", *parts).cast("binary")))
    )


def range_digits(rows: int) -> int:
    """Digits so that a range has about RANGE_ROWS documents even where one source has them all."""
    digits = RANGE_DIGITS
    while 16**digits * RANGE_ROWS < rows:
        digits += 1
    return digits


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """From (_src, source_size), one row a source: weight, cap, target.

    Targets share the sum of all sizes by weight and stop at max_epochs times the source's size; the excess goes to
    the others by weight until none is above. That is the level L with sum(min(cap, L * weight)) = the whole, found
    by ordering sources by cap / weight and trying each number of capped sources (the highest level that fits). One row
    a source goes through here, never rows of documents.
    """
    # "s..." sorts after "n" by code point, but the null source has to be last.
    by_name = Window.orderBy(F.col("_src") == "n", "_src")
    everything = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("_src") == "n", "_src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_total", F.sum("source_size").over(everything).cast("double"))
    left = F.col("_total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("_level", left / weight_left)
    fits = F.col("_level") <= F.col("cap") / F.col("weight")
    s = s.withColumn("_found", F.max(F.when(fits, F.col("_level"))).over(everything))
    # Without any words there is no level above 0.
    return s.select("_src", "source_size", "weight", F.least("cap", F.coalesce("_found", F.lit(0.0)) * F.col("weight")).alias("target"))


def range_offsets(sized: DataFrame, digits: int) -> DataFrame:
    """(_src, _range, _offset, _all): words before each range and of its source.

    Ranges are summed in two steps, by leading digits and then within, so that no task gets more than 16**RANGE_DIGITS
    sums of a source, or the sums below one of them."""
    lead = F.substring("_range", 1, RANGE_DIGITS)
    ranges = sized.groupBy("_src", "_range").agg(F.sum("size").alias("_words")).withColumn("_lead", lead)
    tops = ranges.groupBy("_src", "_lead").agg(F.sum("_words").alias("_words"))
    before = Window.partitionBy("_src").orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_offset", F.coalesce(F.sum("_words").over(before), F.lit(0))).withColumn("_all", F.sum("_words").over(Window.partitionBy("_src")))
    if digits == RANGE_DIGITS:
        return tops.select("_src", F.col("_lead").alias("_range"), "_offset", "_all")
    inside = Window.partitionBy("_src", "_lead").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_inside", F.coalesce(F.sum("_words").over(inside), F.lit(0))).join(tops.drop("_words"), ["_src", "_lead"])
    return ranges.select("_src", "_range", (F.col("_offset") + F.col("_inside")).alias("_offset"), "_all")


def source_cuts(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, digits: int | None = None) -> DataFrame:
    """One row a source: _src, source_size, target, _epochs (how often all of it is taken), _cut (the key at which the
    rest is used up), _left (words of the rest that documents with that key get), _there (how many have it).

    Documents that share a key, which are repeats of one row, are counted before anything is dealt or ordered."""
    keys = sized.groupBy("_src", "_key").agg(F.sum("size").alias("size"), F.count("*").alias("_there"))
    digits = digits or range_digits(sized.count())
    keys = keys.withColumn("_range", F.substring("_key", 1, digits))
    ranges = range_offsets(keys, digits)
    per_source = ranges.groupBy("_src").agg(F.max("_all").alias("source_size"))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0).cast("long"))
    targets = source_targets(per_source, weights, max_epochs).withColumn("_epochs", epochs).withColumn("_rest", budget - F.col("_epochs") * F.col("source_size"))
    begun = ranges.select("_src", "_range", "_offset").join(targets, "_src").where("_offset < _rest")
    run = Window.partitionBy("_src", "_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    placed = keys.withColumn("_upto", F.sum("size").over(run)).join(begun, ["_src", "_range"])
    left = F.col("_rest") - (F.col("_offset") + F.col("_upto") - F.col("size"))
    cut = placed.where((F.col("size") > 0) & (left > 0)).groupBy("_src").agg(F.max(F.struct("_key", F.least(left, F.col("size")).alias("left"), "_there")).alias("m"))
    cut = cut.select("_src", F.col("m._key").alias("_cut"), F.col("m.left").alias("_left"), F.col("m._there").alias("_there"))
    out = targets.drop("weight", "_rest").join(cut, "_src", "left")
    return out.withColumns({"_cut": F.coalesce("_cut", F.lit("")), "_left": F.coalesce("_left", F.lit(0)).cast("long"), "_there": F.coalesce("_there", F.lit(0)).cast("long")})


def _numbered_at_cuts(rows: DataFrame, cuts: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows at the cut of a source that several rows share, with _n, their number from 0: numbers within the parts
    of the written rows, and before each part the rows of those ahead of it. So no task sees more than a part."""
    some = scratch.keep(rows.join(broadcast_if_small(cuts.where("_there > 1").select("_src", "_cut"), BROADCAST_SOURCES), "_src").where("_key = _cut").drop("_cut").withColumn("_part", F.spark_partition_id()), "at")
    parts = some.groupBy("_src", "_part").agg(F.count("*").alias("_c"))
    ahead = parts.select("_src", "_part", F.coalesce(F.sum("_c").over(Window.partitionBy("_src").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    within = F.row_number().over(Window.partitionBy("_src", "_part").orderBy("_key")) - 1
    return some.withColumn("_n", within).join(ahead, ["_src", "_part"]).withColumn("_n", F.col("_n") + F.col("_ahead")).drop("_part", "_ahead")


def _decided(rows: DataFrame, cuts: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (size, _src, _key, ...) with their source's cut and _taken, the words of the rest that each gets."""
    joined = rows.join(broadcast_if_small(cuts, BROADCAST_SOURCES), "_src")
    at = F.col("_key") == F.col("_cut")
    whole = F.when(F.col("_key") < F.col("_cut"), F.col("size")).when(at, F.least("size", "_left")).otherwise(F.lit(0))
    if cuts.where("_there > 1").isEmpty():
        return joined.withColumn("_taken", whole.cast("long"))
    alone = joined.where(~at | (F.col("_there") <= 1)).withColumn("_taken", whole.cast("long"))
    numbered = _numbered_at_cuts(rows, cuts, scratch).join(broadcast_if_small(cuts, BROADCAST_SOURCES), "_src")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - F.col("_n") * F.col("size")))
    return alone.unionByName(numbered.withColumn("_taken", part.cast("long")).drop("_n"))


def _copies() -> Column:
    return F.when(F.col("size") > 0, F.col("_epochs") + (F.col("_taken") > 0).cast("long")).otherwise(F.lit(0).cast("long"))


def mix(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, digits: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Adds source_size, target, taken and copies to rows of with_sizes, of which a written table is best given.

    taken: words that the mix takes of the document, repeats counted; each source's taken words sum to its target,
    rounded down, so that the document at the cut is taken in part. copies: how often it is taken, the part counted as
    one.
    """
    scratch = scratch or Scratch(sized.sparkSession, "mix")
    sized = sized.drop("source_size", "target", "taken", "copies")
    cuts = scratch.keep(source_cuts(sized, weights, max_epochs, digits), "cuts")
    out = _decided(sized, cuts, scratch).withColumns({"copies": _copies(), "taken": F.col("_epochs") * F.col("size") + F.col("_taken")})
    return out.drop("_epochs", "_cut", "_left", "_there", "_taken", "cap")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken; the document at a source's cut stays whole.

    Only keys and sizes are sorted and summed. They give one cut a source, and the whole rows are held against it where
    they are; rows that repeat the one at the cut are numbered, if there are any."""
    scratch = Scratch(docs.sparkSession, "mixed")
    light = scratch.keep(with_sizes(docs.select("doc_id", "source", "text")).select("size", "_src", "_key"), "sizes")
    cuts = scratch.keep(source_cuts(light, **options), "cuts")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", F.col("text").alias("_text"))
    rows = with_sizes(rows, text="_text").where("size > 0").select("_row", "size", "_src", "_key")
    taken = _decided(rows, cuts, scratch).select("_row", _copies().alias("copies")).where("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words taken of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    scratch = Scratch(spark, "mix")
    sized = scratch.keep(with_sizes(docs).select("doc_id", "size", "_src", "_key"), "sizes")
    return mix(sized, scratch=scratch).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3.0::DOUBLE * sum(size) AS cap,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left
  FROM s),
l AS (SELECT *, CAST(total - capped AS DOUBLE) / w_left AS level FROM o),
t AS (
  SELECT source, source_size,
         least(cap, w * coalesce(max(CASE WHEN level <= cap / w THEN level END) OVER (), 0)) AS target
  FROM l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END AS BIGINT) AS taken
FROM r
"""

QUERIES = {"op10_mix_sources": op10_mix_sources}
ORACLE = {"op10_mix_sources": OP10_SQL}
