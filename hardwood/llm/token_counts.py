"""Exact length histogram of encoded documents.

Texts are encoded in Arrow batches, documents are counted by encoded length, and suffix sums over the lengths answer
every context limit: how many documents are longer, how many tokens they hold, what is left when each is cut at the
limit, and which length is a given quantile. The suffix sums are formed in two levels (blocks of lengths, then within
each block), so no task gets all lengths.

Defined cases: null and empty texts have length 0; the texts of special tokens are ordinary text; texts are encoded
whole, however long; repeated rows count as often as they occur; documents of equal length share a row; no column but
the text is read; an empty table has an empty histogram, and its totals are null or 0.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hardwood.llm.common import Scratch, table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits texts before byte pairs are merged; a fixed value of this public vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths of one block of the suffix sums.
BLOCK = 256


def load_ranks(path: str) -> bytes:
    """The vocabulary file, read once on the driver; it goes to the tasks with their code."""
    with open(path, "rb") as f:
        data = f.read(64 << 20)
    if len(data) >= 64 << 20:
        raise ValueError(f"{path} is too large for a vocabulary")
    return data


_encodings: dict[int, object] = {}


def _encoding(ranks: bytes):
    """One encoder per worker process."""
    import tiktoken

    key = hash(ranks)
    if key not in _encodings:
        pairs = (line.split() for line in ranks.splitlines() if line)
        _encodings[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(t): int(n) for t, n in pairs}, special_tokens={})
    return _encodings[key]


def token_lengths(docs: DataFrame, ranks: str = RANKS, text: str = "text") -> DataFrame:
    """One row per document: n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shared.value).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t.as_py() or "")) for t in batch.column(0)], pa.int64())], ["n_tokens"])

    return docs.select(text).mapInArrow(lengths, "n_tokens long")


def histogram(lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """From n_tokens: one row per length, with n_docs and the suffix sums. The counts, which several parts of the plan
    read, are written first, so that every text is encoded once.

    docs_longer, tokens_longer: of documents longer than this; truncated_tokens: the sum of min(length, this);
    docs_upto: documents of at most this length."""
    counts = scratch.keep(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "counts")
    h = counts.withColumn("_block", F.floor(F.col("n_tokens") / BLOCK).cast("long")).withColumn("_tokens", F.col("n_docs") * F.col("n_tokens"))
    blocks = h.groupBy("_block").agg(F.sum("n_docs").alias("_bd"), F.sum("_tokens").alias("_bt"))
    # One row per block of lengths: the only rows that meet in one task.
    after = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(n) for c, n in (("_bd", "_d_after"), ("_bt", "_t_after"))), F.sum("_bd").over(Window.partitionBy(F.lit(0))).alias("_docs"))
    inside = Window.partitionBy("_block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("_d", F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).withColumn("_t", F.coalesce(F.sum("_tokens").over(inside), F.lit(0))).join(blocks, "_block")
    h = h.withColumn("docs_longer", F.col("_d") + F.col("_d_after")).withColumn("tokens_longer", F.col("_t") + F.col("_t_after"))
    h = h.withColumn("docs_upto", F.col("_docs") - F.col("docs_longer"))
    return h.select("n_tokens", "n_docs", "docs_longer", "tokens_longer", "docs_upto")


def with_truncation(h: DataFrame, total_tokens: int) -> DataFrame:
    """Adds truncated_tokens to a histogram whose tokens sum to total_tokens."""
    return h.withColumn("truncated_tokens", F.lit(total_tokens) - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens"))


def totals(h: DataFrame) -> DataFrame:
    """One row: documents, tokens, longest, mean."""
    return h.agg(F.sum("n_docs").alias("documents"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"), F.max("n_tokens").alias("longest"), (F.sum(F.col("n_docs") * F.col("n_tokens")) / F.sum("n_docs")).alias("mean"))


def quantiles(h: DataFrame, at: list[float]) -> DataFrame:
    """For each q in at: the smallest length that at least a share q of the documents doesn't exceed."""
    wanted = h.sparkSession.createDataFrame([(float(q),) for q in at], "q double")
    share = h.select("n_tokens", (F.col("docs_upto") / (F.col("docs_upto") + F.col("docs_longer"))).alias("share"))
    return share.join(F.broadcast(wanted), F.col("share") >= F.col("q")).groupBy("q").agg(F.min("n_tokens").alias("n_tokens"))


def truncated(h: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents_cut, tokens_kept (each document cut at the limit), tokens_lost."""
    n, t = F.col("n_docs"), F.col("n_tokens")
    each = h.withColumn("context", F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits)).cast("array<bigint>")))
    kept, lost = F.sum(n * F.least(t, F.col("context"))), F.sum(n * F.greatest(t - F.col("context"), F.lit(0)))
    return each.groupBy("context").agg(F.sum(F.when(t > F.col("context"), n).otherwise(0)).alias("documents_cut"), kept.alias("tokens_kept"), lost.alias("tokens_lost"))


def op1_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of the encoded lengths of all documents, with the sums that answer every context limit."""
    lengths = token_lengths(table(spark, sf_dir, "documents"))
    scratch = Scratch(spark, "lengths")
    counted = scratch.keep(histogram(lengths, scratch), "histogram")
    return with_truncation(counted, totals(counted).first().tokens or 0)


QUERIES = {"op1_token_lengths": op1_token_lengths}
ORACLE: dict[str, str] = {}
