"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is that of their 64-bit hashes. It is cut into fragments, and each set into its segments.

1. Documents with equal sets are one node. Sizes fall into classes, such that linked sets lie in one class or in two
   neighbouring ones. A class fixes the cut: linked sets differ in at most D n-grams there, so with D + 1 fragments or
   more at least one pair of their segments is equal. The hashes of the segments are the keys by which nodes meet. The
   cut has a few fragments more, as two empty segments are equal and say nothing; nodes with more empty segments than
   that have keys for them too. So no link is missed, and n-grams that are frequent by themselves bring nobody together.
2. The overlap of two nodes is counted fragment by fragment and summed per pair. Here fragments are wider (about WIDE n-grams of
   the larger class), so that no row holds the whole set of a long text.
3. A node is first compared with one node of its buckets: the one whose keys are the most popular, which is the origin
   of a group of copies, as long as it is there. Links found so join nodes to clusters. Then all nodes of a bucket that
   lie in different clusters are compared: in small buckets as pairs; in larger ones in blocks, in which partial
   overlaps are counted as products of incidence matrices, pairs that differ in more than D are dropped, and the
   partial counts of the others are summed. So a group of thousands of copies doesn't become all its pairs.
4. Connected components of the links; a document that has several texts belongs to all their nodes.

Defined cases: texts without words (null, empty, blank) have an empty set and are linked with nothing; a text of fewer
words than an n-gram has one n-gram; rows without doc_id are linked with nothing and have no component; rows that share
a doc_id are one document, so what one of them is linked with is linked with the others; an empty table gives no rows;
other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hardwood.llm import wordbytes
from hardwood.llm.common import Scratch, packed, table, thrifty
from hardwood.llm.near_dups import components

#: N-grams of a wide fragment, about.
WIDE = 1024
#: Buckets of up to SMALL nodes outside their clusters are compared as pairs, larger ones in blocks of about BLOCK nodes.
SMALL, BLOCK, TILE = 24, 1024, 256
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Classes:
    """Sizes by class: class c holds starts[c] .. starts[c + 1] - 1. The cut of class c serves pairs whose smaller set lies in c."""

    def __init__(self, percent: int, most: int):
        self.percent = percent
        starts = [1]
        while starts[-1] <= most:
            starts.append(starts[-1] * 100 // percent + 1)
        starts.append(starts[-1] * 100 // percent + 1)
        self.starts = np.array(starts, np.int64)
        small = self.starts[1:] - 1
        large = small * 100 // percent
        #: Most n-grams that are in one set only: 100 I >= p (x + y - I) means x + y - 2 I <= (x + y) (100 - p) / (100 + p).
        self.apart = (small + large) * (100 - percent) // (100 + percent)
        #: Empty segments that a cut allows for.
        self.spare = 1 + self.apart // 200
        self.parts = np.where(self.apart > 0, self.apart + 1 + self.spare, 0)
        self.wide = np.maximum(1, large // WIDE)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, sizes, "right") - 1


def _fragment(h: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """In which of so many equal ranges of the order each hash lies."""
    return (((h >> np.uint64(32)) * parts.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


# -- sets and keys ---------------------------------------------------------------------------------------------------


class Sets(NamedTuple):
    """Of a slice of texts: the size of each set, and of the sets with n-grams (`full`) their hashes in order, names and checks."""

    ids: pa.Array
    extra: list
    sizes: np.ndarray
    full: np.ndarray
    hashes: np.ndarray
    node: np.ndarray
    check: np.ndarray

    def placed(self, percent: int) -> tuple[np.ndarray, Classes, np.ndarray, np.ndarray]:
        """Sizes of the full sets, their classes, and the set of each hash."""
        size = self.sizes[self.full].astype(np.int64)
        classes = Classes(percent, int(size.max(initial=1)))
        return size, classes, classes.of(size), np.repeat(np.arange(len(size)), size)


def _sets(batches: Iterator[pa.RecordBatch], k: int, salt: int) -> Iterator[Sets]:
    """Sets of (doc_id, text, other columns)."""
    for batch in batches:
        for lo, data, offsets in wordbytes.slices(batch.column(1)):
            n = len(offsets) - 1
            row, h = wordbytes.shingles(wordbytes.words(data, offsets), k)
            sizes = np.bincount(row, minlength=n)
            full = np.flatnonzero(sizes)
            begin = np.r_[0, np.cumsum(sizes[full])[:-1]].astype(np.int64)
            total = np.add.reduceat(h, begin) if len(full) else h[:0]
            check = np.bitwise_xor.reduceat(wordbytes.mix64(h + np.uint64(1)), begin) if len(full) else h[:0]
            node = wordbytes.mix64(wordbytes.mix64(total + np.uint64(salt)) ^ (check * _GOLDEN))
            yield Sets(batch.column(0).slice(lo, n), [c.slice(lo, n) for c in batch.columns[2:]], sizes, full, h, node, wordbytes.mix64(total) + check)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


SKETCH = "doc_id long, n_shingles long, node long, check long, own int, buckets array<long>"


def _buckets(x: Sets, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each full set, owner and key of its buckets), by the cut of its class and of the class below. The last
    bit of a key is that of its cut."""
    size, classes, own, set_of = x.placed(percent)
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for below in (0, 1):
        c = np.maximum(own - below, 0)
        parts = np.where(own >= below, classes.parts[c], 0)
        first = np.r_[0, np.cumsum(parts)]
        # A row for each fragment of each set, empty ones too.
        owner = np.repeat(np.arange(len(size)), parts)
        number = np.arange(first[-1]) - first[owner]
        inside = (parts > 0)[set_of]
        at = first[set_of[inside]] + _fragment(x.hashes[inside], parts[set_of[inside]])
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
        digest, filled = np.zeros(first[-1], np.uint64), np.zeros(first[-1], bool)
        if len(at):
            digest[at[new]] = np.add.reduceat(wordbytes.mix64(x.hashes[inside] * _GOLDEN + np.uint64(3)), new)
        filled[at] = True
        wanted = filled | (np.bincount(owner[~filled], minlength=len(size)) > classes.spare[c])[owner]
        salt = (c[owner].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64)
        key = wordbytes.mix64(digest + wordbytes.mix64(salt * _GOLDEN + np.uint64(11)))
        key = (key & ~np.uint64(1)) | (c[owner].astype(np.uint64) & np.uint64(1))
        keys.append(key[wanted])
        owners.append(owner[wanted])
    return own, np.concatenate(owners), np.concatenate(keys)


def _sketch(batches: Iterator[pa.RecordBatch], k: int, percent: int, salt: int) -> Iterator[pa.RecordBatch]:
    for x in _sets(batches, k, salt):
        n, none = len(x.sizes), np.ones(len(x.sizes), bool)
        none[x.full] = False
        own, owner, key = _buckets(x, percent)
        order = np.argsort(owner, kind="stable")
        ptr = np.r_[0, np.cumsum(np.bincount(x.full[owner], minlength=n))].astype(np.int32)

        def spread(values: np.ndarray, kind: pa.DataType, x: Sets = x, n: int = n, none: np.ndarray = none) -> pa.Array:
            out = np.zeros(n, np.int64)
            out[x.full] = values
            return pa.array(out, mask=none).cast(kind)

        columns = [x.ids, pa.array(x.sizes.astype(np.int64)), spread(x.node.view(np.int64), pa.int64()), spread(x.check.view(np.int64), pa.int64()), spread(own, pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ptr), _signed(key[order]))], ["doc_id", "n_shingles", "node", "check", "own", "buckets"])


SEGMENTS = "doc_id long, node long, cut int, fragment int, segment array<long>"


def _segments(batches: Iterator[pa.RecordBatch], k: int, percent: int, salt: int) -> Iterator[pa.RecordBatch]:
    """The wide segments of (doc_id, text, cuts), by each of the cuts."""
    for x in _sets(batches, k, salt):
        _, classes, own, set_of = x.placed(percent)
        cuts = x.extra[0].take(pa.array(x.full))
        for below in (0, 1):
            c = np.maximum(own - below, 0)
            asked = np.zeros(len(own), bool)
            flat, length = np.asarray(cuts.flatten()), np.asarray(pc.fill_null(pc.list_value_length(cuts), 0))
            at = np.repeat(np.arange(len(own)), length)
            asked[at[(flat == c[at]) & (own[at] >= below)]] = True
            part = _fragment(x.hashes, classes.wide[c][set_of])
            new = np.flatnonzero(np.r_[True, (set_of[1:] != set_of[:-1]) | (part[1:] != part[:-1])]) if len(part) else part
            lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(part)].astype(np.int32)), _signed(x.hashes))
            keep = asked[set_of[new]]
            new, owner = new[keep], set_of[new][keep]
            columns = [x.ids.take(pa.array(x.full[owner])), _signed(x.node[owner]), pa.array(c[owner].astype(np.int32)), pa.array(part[new].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, lists.filter(pa.array(keep))], ["doc_id", "node", "cut", "fragment", "segment"])


# -- overlaps --------------------------------------------------------------------------------------------------------


class Join:
    """What the steps of one join share: documents, nodes (node, doc_id, size, own) and settings."""

    def __init__(self, docs: DataFrame, percent: int, k: int, scratch: Scratch):
        self.docs, self.percent, self.k, self.scratch, self.salt = docs, percent, k, scratch, 0
        self.nodes: DataFrame | None = None

    def sketch(self) -> DataFrame:
        """SKETCH of all documents; no two sets have the same node."""
        for self.salt in range(8):
            percent, k, salt = self.percent, self.k, self.salt
            sketch = self.scratch.keep(self.docs.mapInArrow(thrifty(lambda b: _sketch(b, k, percent, salt)), SKETCH), "sketch", as_dealt=True)
            if sketch.groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").isEmpty():
                return sketch
            self.scratch.drop(sketch)
        raise RuntimeError("no salt tells all sets apart")

    def segments(self, wanted: DataFrame) -> DataFrame:
        """SEGMENTS of the wanted (node, cut)."""
        percent, k, salt = self.percent, self.k, self.salt
        cuts = self.scratch.keep(wanted.distinct().join(self.nodes, "node").groupBy("doc_id").agg(F.collect_set("cut").alias("cuts")), "cuts")
        made = self.docs.join(cuts, "doc_id").select("doc_id", "text", "cuts").mapInArrow(thrifty(lambda b: _segments(b, k, percent, salt)), SEGMENTS)
        return self.scratch.keep(made.select("node", "cut", "fragment", "segment"), "segments")

    def linked(self, counts: DataFrame) -> DataFrame:
        """The links among counts (a, b, sizes, cut, fragment, overlap). A segment may be there several times, as it may
        come from several rows of a document or meet in several buckets."""
        once = counts.groupBy("a", "b", "sizes", "cut", "fragment").agg(F.max("overlap").alias("overlap"))
        total = once.groupBy("a", "b", "sizes").agg(F.sum("overlap").alias("overlap"))
        return self.scratch.keep(total.where(F.lit(100 + self.percent) * F.col("overlap") >= F.lit(self.percent) * F.col("sizes")).select("a", "b"), "links")

    def counted(self, pairs: DataFrame) -> DataFrame:
        """The links among the written pairs (a, b)."""
        a, b = (self.nodes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("own").alias(f"own_{x}")) for x in "ab")
        sized = pairs.join(a, "a").join(b, "b").where(F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * self.percent)
        sized = self.scratch.keep(sized.select("a", "b", (F.col("size_a") + F.col("size_b")).alias("sizes"), F.least("own_a", "own_b").alias("cut")), "sized")
        segments = self.segments(sized.select(F.explode(F.array("a", "b")).alias("node"), "cut"))
        both = sized.join(segments.select(F.col("node").alias("a"), "cut", "fragment", F.col("segment").alias("s")), ["a", "cut"])
        both = both.join(segments.select(F.col("node").alias("b"), "cut", "fragment", F.col("segment").alias("t")), ["b", "cut", "fragment"])
        links = self.linked(both.select("a", "b", "sizes", "cut", "fragment", F.size(F.array_intersect("s", "t")).cast("long").alias("overlap")))
        self.scratch.drop(sized, segments)
        return links


def _cell(percent: int):
    """Partial overlaps of the asking with the asked nodes of a cell (bucket, two blocks, fragment of the bucket's cut)."""

    def tile(q: pd.DataFrame, t: pd.DataFrame) -> tuple[np.ndarray, ...]:
        lists = [*q.segment, *t.segment]
        length = np.array([len(x) for x in lists])
        gram, at, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        # The incidence matrices are multiplied a few thousand n-grams at a time; an n-gram of one set adds nothing.
        shared = (count > 1)[at]
        owner, at = np.repeat(np.arange(len(lists)), length)[shared], (np.cumsum(count > 1) - 1)[at[shared]]
        order = np.argsort(at, kind="stable")
        owner, at, overlap = owner[order], at[order], np.zeros((len(q), len(t)), np.float32)
        for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
            i, j = np.searchsorted(at, [lo, lo + 4096])
            seen = np.zeros((len(lists), 4096), np.float32)
            seen[owner[i:j], at[i:j] - lo] = 1
            overlap += seen[: len(q)] @ seen[len(q) :].T

        def sides(column: str) -> tuple[np.ndarray, np.ndarray]:
            return q[column].to_numpy()[:, None], t[column].to_numpy()[None, :]

        (x, y), (own_q, own_t), (node_q, node_t), (cluster_q, cluster_t) = map(sides, ("size", "own", "node", "cluster"))
        apart = length[: len(q), None] + length[None, len(q) :] - 2 * overlap
        fits = (cluster_q != cluster_t) & (np.minimum(own_q, own_t) == q["cut"].iat[0]) & (overlap > 0)
        fits &= (np.minimum(x, y) * 100 >= np.maximum(x, y) * percent) & (apart * (100 + percent) <= (x + y) * (100 - percent))
        i, j = np.nonzero(fits)
        a, b = node_q[i, 0], node_t[0, j]
        return np.minimum(a, b), np.maximum(a, b), (x + y)[i, j], overlap[i, j].astype(np.int64)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        q, t = pdf[pdf.asks], pdf[~pdf.asks]
        none = np.zeros(0, np.int64)
        found = [tile(q.iloc[x : x + TILE], t.iloc[y : y + TILE]) for x in range(0, len(q), TILE) for y in range(0, len(t), TILE)]
        a, b, sizes, overlap = (np.concatenate([none, *x]) for x in zip(*found, strict=True)) if found else (none,) * 4
        return pd.DataFrame({"a": a, "b": b, "sizes": sizes, "cut": np.full(len(a), pdf["cut"].iat[0], np.int32), "fragment": np.full(len(a), pdf["fragment"].iat[0], np.int32), "overlap": overlap})

    return compare


COUNTS = "a long, b long, sizes long, cut int, fragment int, overlap long"


# -- candidates ------------------------------------------------------------------------------------------------------


def _first_pairs(meets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): for each node the pivot that it meets most. The pivot of a bucket is the node whose buckets hold the most
    nodes; of a group of copies that is the origin, or the copy that is least changed."""
    weights = meets.groupBy("node").agg(F.sum("n").alias("weight"))
    pivots = meets.join(weights, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("m")).select("bucket", F.col("m.node").alias("pivot"))
    shared = meets.join(pivots, "bucket").where("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("c"))
    best = shared.groupBy("node").agg(F.max(F.struct("c", "pivot")).alias("m"))
    return scratch.keep(best.select(F.col("node").alias("a"), F.col("m.pivot").alias("b")), "first")


def _across(join: Join, meets: DataFrame, clusters: DataFrame) -> DataFrame:
    """The links of nodes that meet in a bucket and lie in different clusters."""
    scratch = join.scratch
    named = meets.drop("n").join(clusters, "node", "left").withColumn("cluster", F.coalesce("component", "node")).drop("component")
    per_cluster = named.groupBy("bucket", "cluster").agg(F.count("*").alias("c"))
    stats = per_cluster.groupBy("bucket").agg(F.count("*").alias("clusters"), F.sum("c").alias("n"), F.max(F.struct("c", "cluster")).alias("m")).where("clusters > 1")
    stats = stats.select("bucket", "n", F.col("m.cluster").alias("main"), (F.col("n") - F.col("m.c")).alias("rest"))
    mixed = scratch.keep(named.join(stats, "bucket"), "mixed")
    small = mixed.where(F.col("n") <= SMALL).select("bucket", "cut", F.col("node").alias("a"), F.col("cluster").alias("cluster_a"), F.col("own").alias("own_a"))
    other = small.select("bucket", F.col("a").alias("b"), F.col("cluster_a").alias("cluster_b"), F.col("own_a").alias("own_b"))
    pairs = small.join(other, "bucket").where((F.col("a") < F.col("b")) & (F.col("cluster_a") != F.col("cluster_b")) & (F.least("own_a", "own_b") == F.col("cut")))
    links = join.counted(scratch.keep(pairs.select("a", "b").distinct(), "pairs"))
    large = mixed.where(F.col("n") > SMALL)
    segments = join.segments(large.select("node", "cut"))
    dealt = large.withColumns({"asking": F.ceil(F.col("rest") / BLOCK).cast("int"), "asked": F.ceil(F.col("n") / BLOCK).cast("int")})
    i, j = F.pmod(F.xxhash64("node"), F.col("asking")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("asked")).cast("int")
    columns = ["bucket", "cut", "node", "own", "cluster"]
    as_asking = dealt.where("cluster <> main").select(*columns, i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("j"), F.lit(True).alias("asks"))
    as_asked = dealt.select(*columns, F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("i"), j.alias("j"), F.lit(False).alias("asks"))
    cells = as_asking.unionByName(as_asked).join(join.nodes.select("node", "size"), "node").join(segments, ["node", "cut"])
    counts = cells.groupBy("bucket", "i", "j", "cut", "fragment").applyInPandas(_cell(join.percent), COUNTS)
    links = links.unionByName(join.linked(counts))
    scratch.drop(segments)
    return links


# -- the operator ----------------------------------------------------------------------------------------------------


def jaccard_join(docs: DataFrame, percent: int = 90, k: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Documents are linked if 100 * intersection >= percent * union of their sets of k words."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    scratch = scratch or Scratch(docs.sparkSession, "fragments", pack=True)
    join = Join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), percent, k, scratch)
    sketch = join.sketch()
    full = sketch.where("node is not null and doc_id is not null")
    join.nodes = scratch.keep(full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("size"), F.min("own").alias("own")), "nodes")
    keyed = full.join(join.nodes.select("node", "doc_id"), ["node", "doc_id"]).select("node", "own", F.explode("buckets").alias("bucket"))
    crowded = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    cut = F.when(F.col("own").bitwiseAND(1) == F.col("bucket").bitwiseAND(1).cast("int"), F.col("own")).otherwise(F.col("own") - 1)
    meets = scratch.keep(keyed.join(crowded, "bucket").select("bucket", cut.alias("cut"), "node", "own", "n").distinct(), "meets")
    ids = full.select("doc_id", "node").distinct()
    least = ids.groupBy("doc_id").agg(F.min("node").alias("b"))
    same_id = scratch.keep(ids.join(least, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b"), "same-id")
    links = join.counted(_first_pairs(meets, scratch)).unionByName(same_id)
    links = links.unionByName(_across(join, meets, components(links, scratch)))
    named = join.nodes.join(components(links, scratch), "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    groups = scratch.keep(named.join(first, "component").select(F.col("node").alias("_node"), "component_id"), "groups")
    node = F.when(F.col("doc_id").isNotNull(), F.col("node"))
    out = sketch.select("doc_id", "n_shingles", node.alias("node")).join(groups, F.col("node") == F.col("_node"), "left")
    return packed(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and component at similarity 0.9."""
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP11_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
  FROM t),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
-- Linked sets share one of the first n - ceil(0.9 n) + 1 shingles in one common order.
o AS (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY f, x) AS r
      FROM (SELECT *, count(*) OVER (PARTITION BY x) AS f FROM e)),
p AS (SELECT doc_id, n, x FROM o WHERE r <= n - (90 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id
      AND a.n * 100 >= 90 * b.n AND b.n * 100 >= 90 * a.n),
l AS (
  SELECT c.a, c.b FROM c JOIN s AS sa ON sa.doc_id = c.a JOIN s AS sb ON sb.doc_id = c.b
  WHERE 100 * len(list_intersect(sa.g, sb.g)) >= 90 * (len(sa.g) + len(sb.g) - len(list_intersect(sa.g, sb.g)))),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id WHERE r.c < u.b)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, m.c AS component_id
FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""

QUERIES = {"op11_jaccard_join": op11_jaccard_join}
ORACLE = {"op11_jaccard_join": OP11_SQL}
