"""Near duplicates by MinHash with sequential Bayesian verification.

1. One pass over the texts gives each document the size and fingerprint of its shingle set, MinHash signatures and
   band keys. Equal sets are one node from here on, named by the smallest doc_id.
2. Nodes that share a band key are candidates. Each node is first compared with one of the smallest nodes of its
   buckets only, the one it shares most bands with; verified links join nodes into clusters. Then the nodes outside
   the largest cluster of a bucket are compared with their most alike partners, and at last with all nodes of other
   clusters that are left. So a group of thousands of copies doesn't become all its pairs, and no link is left out.
3. A comparison reads the signatures in batches. A pair is dropped once the posterior probability that its similarity
   reaches the threshold is below the chosen miss probability; the rest is verified on the full shingle sets.
4. Connected components of the links, by repeated minima and pointer jumps.

With 30 bands of 5 rows a pair at similarity 0.85 shares no band with probability 3e-8, at 0.8 with 7e-6; lower
thresholds are refused.

Defined cases: texts without words (null, empty, blank) have an empty set and are linked with nothing; a text of fewer
words than a shingle has one shingle; rows without doc_id are linked with nothing, have no component and are kept (the
pipeline's stage compares them too); rows that share a doc_id are one document: what one of them is linked with, all are;
an empty table gives no rows; other columns aren't read, and come through `deduplicated` as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hardwood.llm import wordbytes
from hardwood.llm.common import Scratch, table, thrifty

BANDS, ROWS = 30, 5
HASHES = BANDS * ROWS
#: Hashes read between two looks at the posterior.
BATCH = 25
#: Buckets of more nodes than SMALL are compared in blocks of about BLOCK nodes, TILE at a time within a task.
SMALL, BLOCK, TILE = 32, 2048, 128
#: Bytes and texts, at most, whose words and minima are held at once.
SLICE_BYTES, AT_ONCE = 1 << 18, 1024
#: Hashes, of 8 bits, of the long signatures that decide about the pairs left in large buckets.
LONG = 1024
#: Most alike partners that a node outside the largest cluster of a large bucket is compared with before all others.
BEST = 4
_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_LONG_XOR = _rng.integers(0, 1 << 32, LONG, dtype=np.uint32)
_LONG_MUL = _rng.integers(0, 1 << 32, LONG, dtype=np.uint32) | np.uint32(1)


def min_matches(percent: int, miss: float, looks: list[int]) -> list[tuple[int, int]]:
    """(hashes read, fewest equal ones to go on) at each look: with m of n equal and an even prior, the similarity
    reaches percent/100 with probability P(Binomial(n + 1, percent/100) <= m)."""
    t, found = percent / 100, []
    for n in looks:
        below, m = 0.0, 0
        while m <= n:
            ways = math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
            below += math.exp(ways + m * math.log(t) + (n + 1 - m) * math.log(1 - t))
            if below >= miss:
                break
            m += 1
        found.append((n, m))
    return found


SHORT_LOOKS = list(range(BATCH, HASHES + 1, BATCH))
LONG_LOOKS = [64, 128, 256, 512, LONG]


def promising(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, tests: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of the rows i of a and j of b (signatures) pass every test, and how many hashes they share; each batch
    is read when its test comes, for the survivors only."""
    alive, equal, done = np.arange(len(i)), np.zeros(len(i), np.int64), 0
    for n, least in tests:
        equal = equal + (a[i[alive], done:n] == b[j[alive], done:n]).sum(1)
        stay = equal >= least
        alive, equal, done = alive[stay], equal[stay], n
    return alive, equal


# -- one pass over the texts -----------------------------------------------------------------------------------------

SKETCH = "doc_id long, n_shingles long, f1 long, f2 long, sig binary, bands array<long>"


def _minima(h: np.ndarray, begin: np.ndarray, xor: np.ndarray, mul: np.ndarray) -> np.ndarray:
    """For each set (its hashes from begin on) and each hash function the least value."""
    low = np.empty((len(begin), len(xor)), np.uint32)
    v = (h >> np.uint64(32)).astype(np.uint32)
    x, y = np.empty_like(v), np.empty_like(v)
    for j in range(len(xor) if len(begin) else 0):
        np.bitwise_xor(v, xor[j], out=x)
        np.multiply(x, mul[j], out=x)
        np.right_shift(x, np.uint32(15), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0x2C1B3C6D), out=x)
        low[:, j] = np.minimum.reduceat(x, begin)
    return low


def _sketch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for lo, data, offsets in wordbytes.slices(batch.column(1), SLICE_BYTES):
            n = len(offsets) - 1
            row, h = wordbytes.shingles(wordbytes.words(data, offsets), k)
            sizes = np.bincount(row, minlength=n)
            full = np.flatnonzero(sizes)
            begin = (np.cumsum(sizes[full]) - sizes[full]).astype(np.int64)
            f1 = np.add.reduceat(h, begin) if len(full) else h[:0]
            f2 = np.bitwise_xor.reduceat(wordbytes.mix64(h + np.uint64(1)), begin) if len(full) else h[:0]
            low = _minima(h, begin, _XOR, _MUL)
            sig = ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
            key = np.zeros((len(full), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                key = wordbytes.mix64(key * np.uint64(0xD6E8FEB86659FD93) + low[:, r::ROWS])
            at = np.full(n, -1)
            at[full] = np.arange(len(full))
            null = at < 0

            def column(x, at=at, null=null, size=len(full)):
                return pa.array(x.view(np.int64)[at] if size else np.zeros(len(at), np.int64), pa.int64(), mask=null)

            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, n), pa.array(sizes.astype(np.int64)), column(f1), column(f2),
                    pa.array([None if i < 0 else sig[i].tobytes() for i in at], pa.binary()),
                    pa.array([None if i < 0 else key[i].view(np.int64) for i in at], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "f1", "f2", "sig", "bands"],
            )


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """SKETCH of (doc_id, text) rows; the columns after n_shingles are null for empty sets."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(thrifty(lambda b: _sketch(b, k)), SKETCH)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for lo, data, offsets in wordbytes.slices(batch.column(1), SLICE_BYTES):
            n = len(offsets) - 1
            row, h = wordbytes.shingles(wordbytes.words(data, offsets), k)
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=n))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, n), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], ["node", "shingles"])


def _long_signatures(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, data, offsets in wordbytes.slices(batch.column(1), SLICE_BYTES, AT_ONCE):
            row, h = wordbytes.shingles(wordbytes.words(data, offsets), k)
            full, begin = np.unique(row, return_index=True)
            low = _minima(h, begin, _LONG_XOR, _LONG_MUL)
            sig = ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + full)), pa.array([x.tobytes() for x in sig], pa.binary())], ["node", "sig"])


# -- verification ----------------------------------------------------------------------------------------------------


def _prune(batches: Iterator[pa.RecordBatch], tests) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in (2, 3))
        row = np.arange(len(a))
        yield batch.select([0, 1]).take(pa.array(promising(a, row, b, row, tests)[0]))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, miss: float, k: int, scratch: Scratch) -> DataFrame:
    """The links (a, b) among the written pairs. Every join has written tables on both sides, so that a node in
    thousands of pairs is a skewed key of plain exchanges, which adaptive execution splits."""
    sig = nodes.select("node", "sig")
    with_sigs = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    tests = min_matches(percent, miss, SHORT_LOOKS)
    left = scratch.keep(with_sigs.select("a", "b", "sig_a", "sig_b").mapInArrow(thrifty(lambda x: _prune(x, tests)), "a long, b long"), "promising")
    wanted = scratch.keep(left.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    sets = scratch.keep(texts.mapInArrow(thrifty(lambda x: _sets(x, k)), "node long, shingles array<long>"), "sets")
    own = left.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a")
    both = own.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b")
    common = F.size(F.array_intersect("s", "t")).cast("long")
    links = both.withColumn("_c", common).where(F.lit(100) * F.col("_c") >= F.lit(percent) * (F.size("s") + F.size("t") - F.col("_c")))
    links = scratch.keep(links.select("a", "b"), "links")
    scratch.drop(left, wanted, sets)
    return links


# -- connected components --------------------------------------------------------------------------------------------


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node in links: the smallest node that can be reached.

    Each round takes the smallest component among the neighbours, then follows the component's own component. Labels
    only fall, so an unchanged sum ends it; written tables cut the lineage of each round.
    """
    edges = scratch.keep(links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v"), "edges")
    labels = scratch.keep(edges.groupBy(F.col("u").alias("node")).agg(F.least("u", F.min("v")).alias("component")), "labels")
    total = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
    while total is not None:
        heard = edges.join(labels, edges.u == labels.node).select(F.col("v").alias("node"), "component")
        lower = scratch.keep(heard.unionByName(labels).groupBy("node").agg(F.min("component").alias("component")), "lower")
        owner = lower.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = scratch.keep(lower.join(owner, "component").select("node", F.col("above").alias("component")), "labels")
        scratch.drop(labels, lower)
        labels, before = jumped, total
        total = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if total == before:
            break
    scratch.drop(edges)
    return labels


# -- candidates ------------------------------------------------------------------------------------------------------


def _best_pivots(buckets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): for each node the smallest node of a bucket that it shares most buckets with."""
    pivots = scratch.keep(buckets.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n"), "pivots")
    shared = buckets.join(pivots, "bucket").where("node <> pivot").groupBy("node", "pivot").count()
    best = shared.groupBy("node").agg(F.max(F.struct("count", (-F.col("pivot")).alias("p"))).alias("m"))
    pairs = scratch.keep(best.select(F.col("node").alias("a"), (-F.col("m.p")).alias("b")), "pairs")
    scratch.drop(pivots)
    return pairs


def _most_alike(a: np.ndarray, b: np.ndarray, equal: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each a the pairs that share most hashes, `best` at most."""
    order = np.lexsort((b, -equal, a))
    a, b, equal = a[order], b[order], equal[order]
    new = np.r_[True, a[1:] != a[:-1]]
    rank = np.arange(len(a)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return a[rank < best], b[rank < best], equal[rank < best]


def _compare_block(tests, kind: type, best: int | None):
    def arrays(x: pd.DataFrame) -> tuple[np.ndarray, ...]:
        return np.frombuffer(b"".join(x.sig), kind).reshape(len(x), -1), np.stack(x.bands.to_list()), x.node.to_numpy(), x.cluster.to_numpy()

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        none = np.zeros(0, np.int64)
        found, band = [(none, none, none)], pdf.band.iat[0]
        if pdf.asks.any() and not pdf.asks.all():
            (sig_q, band_q, node_q, cluster_q), (sig_t, band_t, node_t, cluster_t) = arrays(pdf[pdf.asks]), arrays(pdf[~pdf.asks])
            for x in range(0, len(node_q), TILE):
                row = []
                for y in range(0, len(node_t), TILE):
                    i, j = np.nonzero(cluster_q[x : x + TILE, None] != cluster_t[None, y : y + TILE])
                    i, j = i + x, j + y
                    ok, equal = promising(sig_q, i, sig_t, j, tests)
                    i, j = i[ok], j[ok]
                    # A pair counts in the first band that both share, and nowhere else.
                    first = (band_q[i] == band_t[j]).argmax(1) == band
                    row.append((node_q[i[first]], node_t[j[first]], equal[first]))
                a, b, equal = (np.concatenate(x) for x in zip(*row, strict=True))
                found.append(_most_alike(a, b, equal, best) if best and len(a) else (a, b, equal))
        a, b, equal = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"a": a, "b": b, "equal": equal})

    return compare


def _across_clusters(nodes: DataFrame, docs: DataFrame, clusters: DataFrame, percent: int, miss: float, k: int, best: int | None, scratch: Scratch) -> DataFrame:
    """(a, b) with a > b, for nodes of one bucket in different clusters.

    Buckets of up to SMALL nodes give their pairs. In larger ones the nodes outside the largest cluster ask all
    others: both are dealt into blocks, and a task compares the signatures of two blocks without making rows of pairs.
    best: of the promising pairs in larger buckets, only so many of the most alike for each asking node; if None, all
    of them, by long signatures, which are made for the nodes of these buckets only.
    """
    buckets = nodes.join(clusters, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"), F.posexplode("bands").alias("band", "bucket"))
    per_cluster = buckets.groupBy("bucket", "cluster").agg(F.count("*").alias("c"))
    stats = per_cluster.groupBy("bucket").agg(F.count("*").alias("clusters"), F.sum("c").alias("n"), F.max(F.struct("c", "cluster")).alias("m")).where("clusters > 1")
    stats = scratch.keep(stats.select("bucket", "n", F.col("m.cluster").alias("main"), (F.col("n") - F.col("m.c")).alias("rest")), "stats")
    mixed = scratch.keep(buckets.join(stats, "bucket"), "mixed")
    small = mixed.where(F.col("n") <= SMALL).select("bucket", "node", "cluster")
    other = small.select("bucket", F.col("node").alias("b"), F.col("cluster").alias("cluster_b"))
    pairs = small.withColumnRenamed("node", "a").join(other, "bucket").where("a > b and cluster <> cluster_b").select("a", "b")
    # One row a node, with its large buckets, until the signatures are there: they are not joined once per bucket.
    entry = F.struct("bucket", "band", "main", F.ceil(F.col("rest") / BLOCK).cast("int").alias("asking"), F.ceil(F.col("n") / BLOCK).cast("int").alias("asked"))
    large = mixed.where(F.col("n") > SMALL).groupBy("node", "cluster").agg(F.collect_list(entry).alias("entries"))
    if best:
        tests, kind = min_matches(percent, miss, SHORT_LOOKS), np.uint16
    else:
        tests, kind = min_matches(percent, miss, LONG_LOOKS), np.uint8
        wanted = scratch.keep(large.select(F.col("node").alias("doc_id")), "wanted")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
        sig = scratch.keep(texts.mapInArrow(thrifty(lambda x: _long_signatures(x, k)), "node long, sig binary").dropDuplicates(["node"]), "long")
        large = large.join(sig, "node")
    large = large.join(nodes.select("node", "bands", *(["sig"] if best else [])), "node")
    large = large.select("node", "cluster", "sig", "bands", F.inline("entries"))
    own = F.pmod(F.xxhash64("node"), F.col("asking")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("asked")).cast("int")
    columns = ["node", "cluster", "band", "sig", "bands"]
    as_asking = large.where("cluster <> main").select("bucket", own[0].alias("i"), F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("j"), F.lit(True).alias("asks"), *columns)
    as_asked = large.select("bucket", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("i"), own[1].alias("j"), F.lit(False).alias("asks"), *columns)
    found = as_asking.unionByName(as_asked).groupBy("bucket", "i", "j").applyInPandas(_compare_block(tests, kind, best), "a long, b long, equal long")
    if best:
        order = Window.partitionBy("a").orderBy(F.desc("equal"), "b")
        found = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= best)
    found = found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    out = scratch.keep(pairs.unionByName(found).distinct(), "pairs")
    scratch.drop(stats, mixed)
    return out


# -- the operator ----------------------------------------------------------------------------------------------------


def _keyed(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, text, ...) with _key, one number for each doc_id and text that occur together, and the table
    (_key, _id) of them."""
    for seed in range(8):
        hashed = lambda salt: F.xxhash64(F.lit(salt), F.col("doc_id").isNull(), F.col("doc_id"), F.col("text"), F.col("text").isNull())
        keyed = rows.withColumn("_key", hashed(2 * seed))
        other = hashed(2 * seed + 1)
        ids = keyed.groupBy("_key").agg(F.min("doc_id").alias("_id"), F.min(other).alias("_low"), F.max(other).alias("_high"))
        ids = scratch.keep(ids, "ids")
        if ids.where("_low <> _high").isEmpty():
            return keyed, ids.select("_key", "_id")
    raise RuntimeError("no seed tells all rows apart")


def _groups(docs: DataFrame, percent: int, k: int, miss: float, scratch: Scratch, same: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text), in which a doc_id has one text; rows
    without doc_id have no component. same: pairs (a, b) of doc_ids that are one document."""
    sketch = scratch.keep(sketches(docs, k), "sketch")
    full = sketch.where("f1 is not null and doc_id is not null")
    nodes = full.groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.min_by(F.struct("sig", "bands"), "doc_id").alias("m"))
    nodes = scratch.keep(nodes.select("node", "f1", "f2", "m.sig", "m.bands"), "nodes")
    first = _best_pivots(nodes.select("node", F.explode("bands").alias("bucket")), scratch)
    links = verified(first, nodes, docs, percent, miss, k, scratch)
    if same is not None:
        node_of = full.select("doc_id", "f1", "f2").distinct().join(nodes.select("f1", "f2", "node"), ["f1", "f2"]).select("doc_id", "node")
        a, b = (node_of.select(F.col("doc_id").alias(x), F.col("node").alias(f"node_{x}")) for x in "ab")
        one = same.join(a, "a").join(b, "b").where("node_a <> node_b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        links = links.unionByName(scratch.keep(one, "same"))
    tested = first
    for best in (BEST, None):
        scratch.release()
        pairs = _across_clusters(nodes, docs, components(links, scratch), percent, miss, k, best, scratch)
        pairs = scratch.keep(pairs.join(tested, ["a", "b"], "left_anti"), "untested")
        links = links.unionByName(verified(pairs, nodes, docs, percent, miss, k, scratch))
        tested = tested.unionByName(pairs)
    scratch.release()
    groups = components(links, scratch)
    named = scratch.keep(nodes.join(groups, "node", "left").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.coalesce("component", "node").alias("component_id")), "named")
    light = sketch.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("f1")).alias("f1"), "f2")
    out = light.join(named, (light.f1 == named.g1) & (light.f2 == named.g2), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 3, miss: float = 1e-6, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their k-word shingle sets. miss: the probability,
    at each look at a pair's signatures, at which the pair may be dropped though it is a link.
    """
    if percent < 80:
        raise ValueError("the bands are made for similarities of 0.8 and more")
    scratch = scratch or Scratch(docs.sparkSession, "near")
    keyed, ids = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scratch)
    named = keyed.select(F.when(F.col("doc_id").isNotNull(), F.col("_key")).alias("doc_id"), "text")
    ids = ids.where("_id is not null")
    least = ids.groupBy("_id").agg(F.min("_key").alias("b"), F.count("*").alias("texts")).where("texts > 1").drop("texts")
    same = ids.join(least, "_id").where("_key <> b").select(F.col("_key").alias("a"), "b")
    found = scratch.keep(_groups(named, percent, k, miss, scratch, same).withColumnsRenamed({"doc_id": "_key", "component_id": "_group"}), "groups")
    first = found.where("_key is not null").join(ids, "_key").groupBy("_group").agg(F.min("_id").alias("component_id"))
    own = found.select("_key", "_group").where("_key is not null").distinct().join(ids, "_key").join(first, "_group").select(F.col("_key").alias("_k"), "_id", "component_id")
    out = found.join(own, F.col("_key") == F.col("_k"), "left")
    return out.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id", (F.col("_id").isNull() | (F.col("_id") == F.col("component_id"))).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 85, k: int = 3, miss: float = 1e-6) -> DataFrame:
    """docs with one document of each group, the one with the smallest doc_id, those without one last; repeated rows stay
    once. Columns of docs may have any name.

    Rows that share a doc_id and differ in text are documents of their own here, and so are rows without one."""
    scratch = Scratch(docs.sparkSession, "kept")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*docs.columns).alias("_row"))
    keyed, ids = _keyed(rows, scratch)
    decided = _groups(keyed.select(F.col("_key").alias("doc_id"), "text"), percent, k, miss, scratch)
    groups = decided.select(F.col("doc_id").alias("_key"), "component_id").distinct().join(ids, "_key").groupBy("component_id")
    keep = scratch.keep(groups.agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_key")).alias("m")).select("m._key"), "kept")
    return keyed.join(keep, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count, component and whether it stays."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
  FROM t),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
-- Sets with 100 * intersection >= 85 * union share one of the first n - ceil(0.85 n) + 1 shingles in one common order.
o AS (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY f, x) AS r
      FROM (SELECT *, count(*) OVER (PARTITION BY x) AS f FROM e)),
p AS (SELECT doc_id, n, x FROM o WHERE r <= n - CAST(ceil(0.85 * n) AS BIGINT) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id
      AND a.n * 100 >= 85 * b.n AND b.n * 100 >= 85 * a.n),
l AS (
  SELECT c.a, c.b FROM c JOIN s AS sa ON sa.doc_id = c.a JOIN s AS sb ON sb.doc_id = c.b
  WHERE 100 * len(list_intersect(sa.g, sb.g)) >= 85 * (len(sa.g) + len(sb.g) - len(list_intersect(sa.g, sb.g)))),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id WHERE r.c < u.b)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""

QUERIES = {"op3_near_duplicates": op3_near_duplicates}
ORACLE = {"op3_near_duplicates": OP3_SQL}
