"""Toxicity by multiple-instance learning.

A sentence scores sigmoid(bias + the weights of its words); a document is toxic if any of its sentences is, so its
score is the noisy-or 1 - prod(1 - s). Only documents carry labels: the weights are fitted so that the noisy-or agrees
with them, and the sentence scores then say where the offence is.

The fit is done on the driver on a sample of labelled documents, bounded in documents and in bytes (SAMPLE toxic and
clean ones, SAMPLE_BYTES of their texts); scoring covers every whole text in Arrow batches and needs no shuffle.

Defined cases: null and blank texts have no sentence and score 0; rows without doc_id are scored and not held out;
labels that are null are left out, a document with several labels is toxic if one says so, and of the texts that share
a labelled id the fit reads the shortest; a text that alone exceeds what is left of the bytes isn't in the sample;
without toxic labels every score is near 0; equal texts get equal scores; very long texts are scored whole; columns of
the input but doc_id and text are not read, and `clean` keeps them whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hardwood.llm import wordbytes
from hardwood.llm.common import Scratch, table, thrifty

#: Labelled documents that the fit may take, toxic and clean, by the hash of their id.
SAMPLE = (1500, 3000)
#: Bytes of the texts of these, toxic and clean; whole texts are taken while they fit.
SAMPLE_BYTES = (6 << 20, 12 << 20)
FEATURES = 1 << 19
#: Besides each word, its leading bytes of these lengths are features: inflected forms share them.
PREFIXES = (4, 5, 6, 7, 8)
#: A word needs to be in so many documents of the sample to get a weight.
MIN_DOCS = 5
FOLDS = 5
#: Features that the fit sums at a time.
BLOCK = 1 << 20

_APART = np.zeros(256, bool)
_APART[: 0x80] = True
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
_ENDS = np.zeros(256, bool)
_ENDS[[0x0A, 0x21, 0x2E, 0x3F]] = True


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


class Sentences(NamedTuple):
    """Features by sentence (0: none): feature of each word and prefix, and of each sentence the first of them, the row,
    the first and the last byte."""

    feature: np.ndarray
    first: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray


def sentences(data: np.ndarray, offsets: np.ndarray) -> Sentences:
    """Sentences end at a line break, '.', '!' or '?'; words are runs of letters and digits, A-Z as a-z."""
    w = wordbytes.words(data, offsets, _APART, PREFIXES)
    each = 1 + len(PREFIXES)
    feature = (np.stack([w.hash, *w.prefixes], 1).ravel() & np.uint64(FEATURES - 1)).astype(np.int32)
    if not len(feature):
        none = np.zeros(0, np.int64)
        return Sentences(feature, none, none, none, none)
    number = np.cumsum(_ENDS[data])[w.start]
    first = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (w.row[1:] != w.row[:-1])])
    last = np.r_[first[1:], len(w.row)] - 1
    return Sentences(feature, first * each, w.row[first], w.start[first], w.end[last])


def fit(feature: np.ndarray, sizes: np.ndarray, words: np.ndarray, spans: np.ndarray, toxic: np.ndarray, weight: np.ndarray, rounds: int = 200, rate: float = 0.15, decay: float = 0.02) -> Model:
    """Adam on the weighted log loss of the noisy-or.

    feature: of all sentences in a row, without 0; sizes: how many each sentence has; words, spans: how many features
    and sentences each document has."""
    weights = np.zeros(FEATURES)
    if not len(toxic) or not toxic.any():
        return Model(weights.astype(np.float32), -20.0)
    docs_with = np.zeros(FEATURES, np.int32)
    ends = np.cumsum(words)
    for lo, hi in zip(ends - words, ends, strict=True):
        docs_with[np.unique(feature[lo:hi])] += 1
    docs_with[0] = 0
    doc = np.repeat(np.arange(len(toxic), dtype=np.int32), spans)
    sentence = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    used = docs_with[feature] >= MIN_DOCS
    names = np.flatnonzero(docs_with >= MIN_DOCS)
    slot, sentence = (np.cumsum(docs_with >= MIN_DOCS, dtype=np.int32) - np.int32(1))[feature[used]], sentence[used]
    del used
    blocks = [slice(i, i + BLOCK) for i in range(0, len(slot), BLOCK)]
    n, total = len(names), weight.sum()
    theta = np.zeros(n + 1)
    per_doc = max(1.0, len(sizes) / len(toxic))
    theta[n] = np.log(max(1e-6, (weight * toxic).sum() / total) / per_doc)
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for i in range(1, rounds + 1):
        z = np.full(len(sizes), theta[n])
        for b in blocks:
            part = np.bincount(sentence[b] - sentence[b.start], theta[slot[b]])
            z[sentence[b.start] : sentence[b.start] + len(part)] += part
        by_sentence, _ = gradient(z, doc, toxic, weight / total)
        by_word = decay * theta[:n] / max(1, n) ** 0.5
        for b in blocks:
            by_word += np.bincount(slot[b], by_sentence[sentence[b]], n)
        g = np.r_[by_word, by_sentence.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    weights[names] = theta[:n]
    return Model(weights.astype(np.float32), float(theta[n]))


def gradient(z: np.ndarray, doc: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Of the weighted log loss of the noisy-or by the logits z of the sentences, doc being their documents; and the loss."""
    # -log of the probability that no sentence is toxic.
    s = np.bincount(doc, np.logaddexp(0, z), len(toxic)).clip(1e-9, 50)
    loss = (weight * np.where(toxic, -np.log(-np.expm1(-s)), s)).sum()
    slope = weight * np.where(toxic, -1 / np.expm1(s), 1.0)
    return slope[doc] * (0.5 + 0.5 * np.tanh(z / 2)), float(loss)


def _text_scores(model: Model, texts: pa.Array, at: float | None = None) -> tuple[np.ndarray, list[list[dict]] | None]:
    """Noisy-or of each text; with `at`, also the sentences that score that or more, by code points of the text."""
    scores, spots = np.zeros(len(texts)), [[] for _ in range(len(texts))] if at is not None else None
    for lo, data, offsets in wordbytes.slices(texts):
        s = sentences(data, offsets)
        if not len(s.first):
            continue
        z = np.add.reduceat(model.weights[s.feature].astype(np.float64), s.first) + model.bias
        n = len(offsets) - 1
        scores[lo : lo + n] = -np.expm1(-np.bincount(s.row, np.logaddexp(0, z), n))
        if at is not None:
            p = 0.5 + 0.5 * np.tanh(z / 2)
            found = np.flatnonzero(p >= at)
            if len(found):
                points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                base = points[offsets[s.row[found]]]
                for i, a, b in zip(found, points[s.start[found]] - base, points[s.end[found]] - base, strict=True):
                    spots[lo + s.row[i]].append({"begin": int(a), "end": int(b), "score": float(p[i])})
    return scores, spots


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, sample_bytes: tuple[int, int] = SAMPLE_BYTES) -> Model:
    """A model from the labels outside the held-out fold: up to so many toxic and clean documents, in the order of a hash
    of their ids, and so many bytes of their texts, weighted so that the classes keep their shares."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    shares = {r.toxic: r["count"] for r in known.groupBy((F.col("toxic") == 1).alias("toxic")).count().collect()}
    none = np.zeros(0, np.int32)
    drawn = None
    for kind in shares:
        part = known.where((F.col("toxic") == 1) == F.lit(kind)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[0 if kind else 1])
        drawn = part if drawn is None else drawn.unionByName(part)
    if drawn is None:
        return fit(none, none, none, none, np.zeros(0, bool), np.zeros(0))
    drawn = F.broadcast(drawn.select(F.col("doc_id").alias("_id"), (F.col("toxic") == 1).alias("toxic")))  # sum(sample) rows at most
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(drawn, F.col("doc_id") == F.col("_id"))
    one = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.octet_length("text").alias("size"), "text")).alias("t"))
    scratch = Scratch(docs.sparkSession, "toxic")
    one = scratch.keep(one.select("doc_id", "toxic", "t.size", "t.text"), "sample")
    # sum(sample) rows at most: which whole texts fit.
    upto = F.sum("size").over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    fitting = one.where(F.col("size") <= F.when(F.col("toxic"), sample_bytes[0]).otherwise(sample_bytes[1])).select("doc_id", "toxic", "size")
    fitting = fitting.withColumn("_upto", upto).where(F.col("_upto") <= F.when(F.col("toxic"), sample_bytes[0]).otherwise(sample_bytes[1]))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offsets in wordbytes.slices(batch.column(1)):
                s, n = sentences(data, offsets), len(offsets) - 1
                row, of = (np.repeat(x, np.diff(np.r_[s.first, len(s.feature)])) for x in (s.row, np.arange(len(s.first))))
                there = s.feature != 0
                sizes = np.bincount(of[there], minlength=len(s.first)).astype(np.int32)
                ends = (np.r_[0, np.cumsum(np.bincount(x, minlength=n))].astype(np.int32) for x in (row[there], s.row))
                lists = (pa.ListArray.from_arrays(pa.array(e), pa.array(x)) for e, x in zip(ends, (s.feature[there], sizes), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(2).slice(lo, n), *lists], ["doc_id", "toxic", "features", "sizes"])

    chosen = one.join(F.broadcast(fitting.select("doc_id")), "doc_id", "left_semi").select("doc_id", "text", "toxic")
    got = chosen.mapInArrow(features, "doc_id long, toxic boolean, features array<int>, sizes array<int>").toArrow().sort_by("doc_id").combine_chunks()
    scratch.drop(one)
    toxic = got.column("toxic").to_numpy()
    counts = {k: max(1, int((toxic == k).sum())) for k in (False, True)}
    weight = np.where(toxic, shares.get(True, 0) / counts[True], shares.get(False, 0) / counts[False])
    lists = [pa.chunked_array(got.column(c)).combine_chunks() for c in ("features", "sizes")]
    flat = [x.flatten().to_numpy() for x in lists]
    per_doc = [np.diff(np.asarray(x.offsets)) for x in lists]
    del got, lists
    model = fit(*flat, *per_doc, toxic, weight)
    del flat, per_doc
    pa.default_memory_pool().release_unused()
    return model


def scored(docs: DataFrame, model: Model, at: float = 0.5) -> DataFrame:
    """doc_id, score, offending: the sentences that score `at` or more, as begin, end (code points) and score."""
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spots = _text_scores(model, batch.column(1), at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(spots, kind)], ["doc_id", "score", "offending"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double, offending array<struct<begin:int,end:int,score:double>>")


def clean(docs: DataFrame, model: Model, at: float = 0.5) -> DataFrame:
    """The documents that score less than `at`, with the columns of docs."""
    where = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_text_scores(model, batch.column(where))[0] < at))

    return docs.mapInArrow(thrifty(keep), docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, verdict and offending sentences, by a model that has not seen the held-out labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE: dict[str, str] = {}
