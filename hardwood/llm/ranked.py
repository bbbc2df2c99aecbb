"""Ranked lexical search over documents in an order made by recursive graph bisection.

1. Recursive bisection: documents and terms form a bipartite graph. A set of documents is halved, and documents are
   swapped between the halves as long as that lowers the cost of storing the terms' gaps; then the halves are halved.
   The tree is fitted on a bounded sample of documents (SAMPLE rows of up to LONGEST bytes, SAMPLE_BYTES in all); every
   document then goes down the tree by the same costs, so that documents with like terms get neighbouring places.
2. Clustered index: the documents of a leaf are dealt into shards of about SHARD documents. A shard is one row: its
   documents by their new place, the terms with their postings, and the largest share that a term has in any of them.
3. Search: the sum of an item's weights times those largest shares bounds every score in a shard. Each item visits its
   shards by falling bound, a few at first and more in each round, and stops when the next bound lies below its
   tenth best score. Bounds that equal that score are visited, as doc_id decides between equal scores. So the results
   are exact; what the tree knows decides only how much is read.

Items are taken in blocks of about BLOCK_TERMS terms, which is all that is sent to the executors of them. Terms are told apart
by 64-bit hashes. Places, shards and rounds are never seen in the result, which maps back to doc_id.

Defined cases: null and blank texts have no terms, don't count in N and are never found; items without known terms find
nothing; rows that repeat are documents of their own, rows of items that share an item_id are one item; rows without
doc_id come last among equal scores; empty tables give no rows; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hardwood.llm import wordbytes
from hardwood.llm.common import Scratch, table

#: Bytes between terms.
SEPARATOR = np.zeros(256, bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    SEPARATOR[_lo : _hi + 1] = True

SAMPLE, SAMPLE_BYTES, LONGEST = 8192, 1 << 25, 1 << 16
DEPTH, SWAPS = 7, 12
SHARD = 256
BLOCK_TERMS = 1 << 19
#: Shards that an item visits in the first round, and how many times as many by the end of each further one.
FIRST, FURTHER = 4, 8
#: Visits up to this number are sent to all executors, more are joined by a shuffle.
FEW_VISITS = 1 << 19


# -- terms -----------------------------------------------------------------------------------------------------------


class Terms(NamedTuple):
    """Of a slice of texts: terms of each (ptr; sorted) with their counts, and the number of terms with repeats."""

    ptr: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    n: np.ndarray


def text_terms(texts: pa.Array) -> Iterator[tuple[int, Terms]]:
    for lo, data, offsets in wordbytes.slices(texts):
        rows = len(offsets) - 1
        w = wordbytes.words(data, offsets, SEPARATOR)
        h = w.hash.view(np.int64)
        order = np.lexsort((h, w.row))
        row, h = w.row[order], h[order]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
        ptr = np.r_[0, np.cumsum(np.bincount(row[first], minlength=rows))]
        yield lo, Terms(ptr, h[first], np.diff(np.r_[first, len(h)]), np.bincount(row, minlength=rows))


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions start[i] .. start[i] + length[i] - 1 of all i, one after the other."""
    total = int(length.sum())
    return np.repeat(start - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(total)


# -- recursive graph bisection ---------------------------------------------------------------------------------------


class Tree(NamedTuple):
    """Node i has the children 2i + 1 and 2i + 2; lean[i, t] > 0: term t speaks for the first."""

    vocabulary: np.ndarray
    lean: np.ndarray
    depth: int

    def leaves(self, t: Terms) -> np.ndarray:
        """The leaf of each text: at each node its terms' leanings are summed."""
        rows = len(t.n)
        row = np.repeat(np.arange(rows), np.diff(t.ptr))
        at = np.minimum(np.searchsorted(self.vocabulary, t.term), max(len(self.vocabulary) - 1, 0))
        known = self.vocabulary[at] == t.term if len(self.vocabulary) else np.zeros(len(at), bool)
        row, at, node = row[known], at[known], np.zeros(rows, np.int64)
        for _ in range(self.depth):
            side = np.bincount(row, self.lean[node[row], at], minlength=rows) < 0
            node = 2 * node + 1 + side
        return node - (2**self.depth - 1)


def _cost(degree: np.ndarray, n: int) -> np.ndarray:
    """Bits of the gaps of a term with so many of n documents, about."""
    return degree * np.log2(n / (degree + 1.0))


def _halves(ptr: np.ndarray, term: np.ndarray, docs: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray]:
    """docs in two halves such that the terms' gaps cost little."""
    left = np.arange(len(docs)) < (len(docs) + 1) // 2
    size = np.diff(ptr)[docs]
    at = term[_ragged(ptr[docs], size)]
    owner = np.repeat(np.arange(len(docs)), size)
    n = (int(left.sum()), int((~left).sum()))
    for _ in range(SWAPS):
        d = [np.bincount(at[side[owner]], minlength=v).astype(float) for side in (left, ~left)]
        gain = np.empty(len(docs))
        for a, b, side in ((0, 1, left), (1, 0, ~left)):
            moved = _cost(d[a], n[a]) + _cost(d[b], n[b]) - _cost(np.maximum(d[a] - 1, 0), n[a]) - _cost(d[b] + 1, n[b])
            gain[side] = np.bincount(owner, moved[at], minlength=len(docs))[side]
        out, back = (np.flatnonzero(side)[np.argsort(-gain[side], kind="stable")] for side in (left, ~left))
        pairs = min(len(out), len(back))
        swap = gain[out[:pairs]] + gain[back[:pairs]] > 1e-9
        if not swap.any():
            break
        left[out[:pairs][swap]], left[back[:pairs][swap]] = False, True
    return docs[left], docs[~left]


def bisect(ptr: np.ndarray, terms: np.ndarray, depth: int = DEPTH) -> Tree:
    """The tree of a sample of documents: the terms of document i are terms[ptr[i]:ptr[i + 1]]."""
    vocabulary, term, count = np.unique(terms, return_inverse=True, return_counts=True)
    shared = count > 1
    owner = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))[shared[term]]
    term = (np.cumsum(shared) - 1)[term[shared[term]]]
    vocabulary, v = vocabulary[shared], int(shared.sum())
    ptr = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(ptr) - 1))]
    lean = np.zeros((2**depth - 1, v), np.float32)
    # Documents whose least hashed terms are equal begin side by side.
    key = wordbytes.mix64(vocabulary.view(np.uint64))[term]
    least = np.full(len(ptr) - 1, np.iinfo(np.uint64).max)
    np.minimum.at(least, owner, key)
    parts = {0: np.argsort(least, kind="stable")}
    for node in range(2**depth - 1):
        docs = parts.pop(node)
        if len(docs) > 1:
            first, second = _halves(ptr, term, docs, v)
            d = [np.bincount(term[_ragged(ptr[x], np.diff(ptr)[x])], minlength=v) for x in (first, second)]
            lean[node] = np.where(d[0] + d[1] > 0, np.log2((d[0] + 1) / len(first)) - np.log2((d[1] + 1) / len(second)), 0)
        else:
            first, second = docs, docs[:0]
        parts[2 * node + 1], parts[2 * node + 2] = first, second
    return Tree(vocabulary, lean, depth)


def _sampled_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, t in text_terms(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(t.ptr.astype(np.int32)), pa.array(t.term))], ["terms"])


def fit(docs: DataFrame, depth: int = DEPTH) -> Tree:
    """The tree of docs (doc_id, text), from a sample whose bounds are SAMPLE, SAMPLE_BYTES and LONGEST."""
    short = docs.where(F.octet_length("text").between(1, LONGEST))
    rows, size = short.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    share = min(1.0, SAMPLE / max(rows, 1), SAMPLE_BYTES / max(size or 0, 1))
    chosen = short.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = chosen.select("text").distinct().mapInArrow(_sampled_terms, "terms array<long>").toArrow().column(0).combine_chunks()
    return bisect(np.asarray(found.offsets, np.int64) - found.offsets[0].as_py() if len(found) else np.zeros(1, np.int64), np.asarray(found.flatten()), depth)


# -- the clustered index ---------------------------------------------------------------------------------------------

PLACED = "doc_id long, n long, leaf int, spread long, terms array<long>, tfs array<int>"
SHARDS = "shard long, doc_ids array<long>, terms array<long>, tops array<long>, ptr array<int>, places array<int>, shares array<int>"


class Index(NamedTuple):
    shards: DataFrame
    #: Documents with terms, and their terms with repeats.
    documents: int
    total: int


def _placed(batches: Iterator[pa.RecordBatch], tree) -> Iterator[pa.RecordBatch]:
    seen = 0
    for batch in batches:
        for lo, t in text_terms(batch.column(1)):
            rows = len(t.n)
            ptr = pa.array(t.ptr.astype(np.int32))
            lists = [pa.ListArray.from_arrays(ptr, pa.array(x)) for x in (t.term, t.tf.astype(np.int32))]
            numbers = [pa.array(t.n.astype(np.int64)), pa.array(tree.value.leaves(t).astype(np.int32)), pa.array(np.arange(seen, seen + rows))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), *numbers, *lists], ["doc_id", "n", "leaf", "spread", "terms", "tfs"])
            seen += rows


def _counted(batches: Iterator[pa.RecordBatch], tree) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, t in text_terms(batch.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array(tree.value.leaves(t).astype(np.int32)), pa.array(t.n.astype(np.int64))], ["leaf", "n"])


def _shard(rows: pa.Table, documents: int, total: int) -> pa.Table:
    """One row of SHARDS of the documents of a shard."""
    rows = rows.combine_chunks().sort_by([("doc_id", "ascending"), ("n", "ascending")])
    n = rows["n"].to_numpy()
    terms, tfs = (np.asarray(rows[c].combine_chunks().flatten(), np.int64) for c in ("terms", "tfs"))
    size = np.asarray(pc.list_value_length(rows["terms"]), np.int64)
    place = np.repeat(np.arange(len(n)), size)
    m = 10 + (90 * n * documents) // total
    share = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[place])
    order = np.lexsort((place, terms))
    terms, place, share = terms[order], place[order], share[order]
    first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
    columns = [terms[first], np.maximum.reduceat(share, first), np.r_[first, len(terms)].astype(np.int32), place.astype(np.int32), share.astype(np.int32)]
    return pa.table([rows["shard"][:1], pa.array([rows["doc_id"].to_pylist()], pa.list_(pa.int64())), *(pa.array([x]) for x in columns)], ["shard", "doc_ids", "terms", "tops", "ptr", "places", "shares"])


def build(docs: DataFrame, scratch: Scratch, depth: int = DEPTH) -> Index:
    """The index of docs (doc_id, text): every document with a term is in one shard."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tree = docs.sparkSession.sparkContext.broadcast(fit(docs, depth))
    leaves = docs.mapInArrow(lambda b: _counted(b, tree), "leaf int, n long").where("n > 0").groupBy("leaf").agg(F.count("*").alias("c"), F.sum("n").alias("n")).collect()
    documents, total = sum(r.c for r in leaves), sum(r.n for r in leaves)
    begin, parts = [0] * 2**depth, [1] * 2**depth
    for r in leaves:
        parts[r.leaf] = -(-r.c // SHARD)
    for i in range(1, 2**depth):
        begin[i] = begin[i - 1] + parts[i - 1]
    begin, parts = (F.element_at(F.array(*map(F.lit, x)), F.col("leaf") + 1).cast("long") for x in (begin, parts))
    placed = docs.mapInArrow(lambda b: _placed(b, tree), PLACED).where("n > 0")
    placed = placed.select((begin + F.pmod(F.xxhash64("doc_id", "spread"), parts)).alias("shard"), "doc_id", "n", "terms", "tfs")
    shards = placed.groupBy("shard").applyInArrow(lambda t: _shard(t, documents, total), SHARDS)
    return Index(scratch.keep(shards, "shards"), documents, total)


# -- search ----------------------------------------------------------------------------------------------------------


class Items(NamedTuple):
    """A block of items: their terms by item (ptr, term as a place in `terms`), and the weights of all terms."""

    terms: np.ndarray
    weight: np.ndarray
    ptr: np.ndarray
    term: np.ndarray


def _known(terms: np.ndarray, among: np.ndarray) -> np.ndarray:
    """The place of each of `terms` in the sorted `among`, or -1."""
    if not len(among):
        return np.full(len(terms), -1)
    at = np.minimum(np.searchsorted(among, terms), len(among) - 1)
    return np.where(among[at] == terms, at, -1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each row: numbers as they are, lists as numpy arrays, but those of doc_ids, which may be null."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].values if name == "doc_ids" else np.asarray(c[i].values) if pa.types.is_list(c.type) else c[i].as_py() for name, c in zip(batch.schema.names, batch.columns, strict=True))


def _frequencies(batches: Iterator[pa.RecordBatch], asked) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(len(asked.value), np.int64)
    for terms, ptr in _rows(batches):
        at = _known(terms, asked.value)
        sums[at[at >= 0]] += np.diff(ptr)[at >= 0]
    there = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there])], ["at", "df"])


def _bounds(batches: Iterator[pa.RecordBatch], items) -> Iterator[pa.RecordBatch]:
    x: Items = items.value
    owner = np.repeat(np.arange(len(x.ptr) - 1), np.diff(x.ptr))
    for shard, terms, tops in _rows(batches):
        at = _known(x.terms, terms)
        worth = np.where(at >= 0, x.weight * tops[at], 0)
        bound = np.zeros(len(x.ptr) - 1, np.int64)
        np.add.at(bound, owner, worth[x.term])
        found = np.flatnonzero(bound)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), shard)), pa.array(bound[found])], ["item", "shard", "bound"])


def _scored(batches: Iterator[pa.RecordBatch], items, k: int) -> Iterator[pa.RecordBatch]:
    x: Items = items.value
    for doc_ids, terms, ptr, places, shares, asking in _rows(batches):
        where = _known(x.terms, terms)
        out = []
        for item in asking:
            own = x.term[x.ptr[item] : x.ptr[item + 1]]
            at = where[own]
            own, at = own[at >= 0], at[at >= 0]
            begin, size = ptr[at].astype(np.int64), np.diff(ptr)[at].astype(np.int64)
            post = _ragged(begin, size)
            score = np.zeros(len(doc_ids), np.int64)
            np.add.at(score, places[post], np.repeat(x.weight[own], size) * shares[post])
            # Places rise with doc_id, those without come last.
            best = np.lexsort((np.arange(len(score)), -score))[:k]
            best = best[score[best] > 0]
            out.append((np.full(len(best), item, np.int64), best, score[best]))
        if out:
            item, best, score = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(item), doc_ids.take(pa.array(best)), pa.array(score)], ["item", "doc_id", "score"])


def _block(index: Index, rows: list, k: int, scratch: Scratch) -> DataFrame:
    """item (a place in rows), rank, doc_id, score of one block of items."""
    spark = index.shards.sparkSession
    size = np.array([len(r.terms) for r in rows])
    every = np.concatenate([np.asarray(r.terms, np.int64) for r in rows])
    terms, term = np.unique(every, return_inverse=True)
    asked = spark.sparkContext.broadcast(terms)
    counts = index.shards.select("terms", "ptr").mapInArrow(lambda b: _frequencies(b, asked), "at long, df long").groupBy("at").agg(F.sum("df").alias("df"))
    weight = np.zeros(len(terms), np.int64)
    for at, df in counts.collect():
        weight[at] = math.floor(1000 * math.log((2 * index.documents + 2) / (2 * df + 1)))
    items = spark.sparkContext.broadcast(Items(terms, weight, np.r_[0, np.cumsum(size)], term))
    bounds = index.shards.select("shard", "terms", "tops").mapInArrow(lambda b: _bounds(b, items), "item long, shard long, bound long")
    bounds = scratch.keep(bounds.withColumn("turn", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "shard"))), "bounds")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top, done, until = spark.createDataFrame([], "item long, doc_id long, score long, rank int"), 0, FIRST
    while True:
        least = top.where(F.col("rank") == k).select("item", F.col("score").alias("least"))
        left = bounds.where(F.col("turn") > done).join(least, "item", "left").where("least is null or bound >= least")
        visits = scratch.keep(left.where(F.col("turn") <= until).groupBy("shard").agg(F.collect_list("item").alias("asking")), "visits")
        pairs = visits.agg(F.sum(F.size("asking"))).first()[0]
        if pairs is None:
            # Bounds fall with the turn: an item that has no visit in this range has none after it.
            return top
        some = F.broadcast(visits) if pairs <= FEW_VISITS else visits
        scored = index.shards.join(some, "shard").select("doc_ids", "terms", "ptr", "places", "shares", "asking").mapInArrow(lambda b: _scored(b, items, k), "item long, doc_id long, score long")
        both = top.drop("rank").unionByName(scored)
        top = scratch.keep(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "top")
        done, until = until, until * FURTHER


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, t in text_terms(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + np.repeat(np.arange(len(t.n)), np.diff(t.ptr)))), pa.array(t.term)], ["item_id", "term"])


def search(index: Index, items: DataFrame, scratch: Scratch, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each of items (item_id, text)."""
    spark = items.sparkSession
    terms = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_terms, "item_id long, term long").distinct()
    asked = scratch.keep(terms.groupBy("item_id").agg(F.collect_list("term").alias("terms")), "items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // BLOCK_TERMS)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks if index.documents else 0):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        if rows:
            names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], "item long, item_id long")
            found = _block(index, rows, k, scratch).join(names, "item")
            out = out.unionByName(found.select("item_id", "rank", "doc_id", "score"))
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    scratch = Scratch(spark, "ranked")
    index = build(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch)
    return search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"), scratch)


OP12_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM (SELECT doc_id, text FROM documents)),
p AS (SELECT r, doc_id, t, count(*) AS tf, sum(count(*)) OVER (PARTITION BY r) AS n FROM t GROUP BY r, doc_id, t),
s AS (SELECT count(DISTINCT r) AS nn, count(*) AS l FROM t),
i AS (SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
w AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t, nn),
x AS (SELECT r, doc_id, p.t, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * CAST(n AS BIGINT) * nn) // l)) AS x FROM p, s),
f AS (SELECT item_id, doc_id, r, CAST(sum(w * x) AS BIGINT) AS score FROM i JOIN w USING (t) JOIN x USING (t) GROUP BY item_id, doc_id, r HAVING sum(w * x) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM f
QUALIFY rank <= 10
"""

QUERIES = {"op12_ranked_search": op12_ranked_search}
ORACLE = {"op12_ranked_search": OP12_SQL}
