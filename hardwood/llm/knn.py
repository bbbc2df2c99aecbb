"""Exact top-k search by inner product, as a Voronoi kNN join.

1. Equal vectors are one point; of its ids the k + 1 smallest are enough, whatever the query.
2. A sample of the points gives the pivots, about twice the root of their number. Each point belongs to its nearest
   pivot's cell; queries do so too. With u the pivot's direction, x = a u + (rest of length r).
3. Each cell is summarised by its number of points, the range of their a, the largest r and the largest length n. For
   a query q = b u + (rest of length s): a b - r s <= q.x <= a b + r s, and r is at most the root of n n - a a. So the
   summaries, and the pivots, which are points themselves, tell a score that a query's k-th best reaches.
4. Queries of neighbouring cells form groups, points of neighbouring cells areas. A query asks an area only if one of
   its cells can reach that score; a group is summarised, for each cell that its queries ask, by the range of b, the
   largest s and the lowest such score, and a point goes to a group only if it can reach that.
5. Blocks of an area's points meet parts of a group's queries; the best k of each query over all blocks are the result.

The bounds leave out much where vectors lie in clusters and nothing where they are spread evenly over many dimensions;
there the work stays queries times points, in tasks of bounded size.

Scores are integers (components times 1024, rounded down), and ties go to the smaller id.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without
id; vectors of another length than the query's are no candidates; repeated rows are one; of rows with equal ids and
different vectors, each asks and each answers, and an id counts once, with the best of its scores; a query without
candidates has no rows; an empty table gives no rows; other columns are not read. Scaled components, and scores, beyond
64 bits are cut to the nearest 64-bit integer, so that such scores tie.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hardwood.llm.common import Scratch, broadcast_if_small, table

K = 10
SCALE = 1024
#: Sampled pivots at most, over all vector lengths; they and one summary each are what every task gets.
PIVOTS = 4096
#: Queries of a part and points of a block about, and queries whose scores a task holds at a time.
GROUP, BLOCK, TILE = 1024, 8192, 256
SALTS = 16
#: Rows (one a group and cell) up to which the groups' summaries are broadcast.
BROADCAST_ROWS = 200_000
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1  # of 64-bit integers


# -- vectors and points ----------------------------------------------------------------------------------------------


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, dim, x): the vectors that take part, scaled, as 32-bit integers or, where they don't fit, 64-bit ones."""
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
                continue
            x = np.floor(np.asarray(v.values).astype(np.float64) * SCALE)
            if np.isnan(x).any() or not np.isfinite(np.asarray(v.values, np.float64)).all():
                continue
            small = np.abs(x).max() < 1 << 31
            whole = x.astype(np.int32) if small else np.array([int(c) if abs(c) < 2.0**63 else (_HIGH if c > 0 else _LOW) for c in np.clip(x, -1e300, 1e300)], np.int64)
            for column, value in zip(out, (i, len(x), whole.tobytes()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["vec_id", "dim", "x"])


def packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, x binary) of the rows (vec_id, embedding) that take part."""
    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_pack, "vec_id long, dim int, x binary")


def matrix(x: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors of one length as whole numbers, a row each."""
    if all(len(b) == 4 * dim for b in x):
        return np.frombuffer(b"".join(x), np.int32).reshape(-1, dim).astype(np.int64)
    return np.stack([np.frombuffer(b, np.int32 if len(b) == 4 * dim else np.int64).astype(np.int64) for b in x])


def points(rows: DataFrame, scratch: Scratch, k: int = K) -> DataFrame:
    """(dim, x, ids array<long>): the distinct vectors of a written table of packed rows, each with its k + 1 smallest ids.

    Only vectors whose hash occurs twice are shuffled. Their ids are cut in two steps, so that a vector of a third of
    all rows doesn't meet in one task."""
    h = F.xxhash64("dim", "x")
    twice = scratch.keep(rows.groupBy(h.alias("_h")).count().where("count > 1").select("_h"), "twice")
    keyed = rows.withColumn("_h", h)
    single = keyed.join(twice, "_h", "left_anti").select("dim", "x", F.array("vec_id").alias("ids"))
    v = keyed.join(twice, "_h", "left_semi").dropDuplicates(["vec_id", "dim", "x"]).withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    for part in (["dim", "x", "_salt"], ["dim", "x"]):
        v = v.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    return single.unionByName(v.groupBy("dim", "x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))


# -- cells and bounds ------------------------------------------------------------------------------------------------


class Cells(NamedTuple):
    """Of the vectors of one length: pivots, their directions, and of each cell the points, the least and the largest
    a, the largest r and the largest length; the group of its queries and the area of its points."""

    pivots: np.ndarray
    directions: np.ndarray
    count: np.ndarray
    low: np.ndarray
    high: np.ndarray
    far: np.ndarray
    norm: np.ndarray
    group: np.ndarray
    area: np.ndarray


def directions(pivots: np.ndarray) -> np.ndarray:
    length = np.sqrt((pivots * pivots).sum(1))
    return pivots / np.where(length > 0, length, 1.0)[:, None]


def split(x: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the part along each direction and the length of the rest, rounded up a little."""
    along = x @ u.T
    norm = (x * x).sum(1)[:, None]
    # The rounding of the difference is far below the slack.
    return along, np.sqrt(np.maximum(norm - along * along, 0) + 1e-12 * norm)


def nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return ((pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T).argmin(1)


def _assign(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Adds cell, a and r to batches with the columns dim and x."""
    for batch in batches:
        dims, cell = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int32)
        a, r = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        for dim in np.unique(dims):
            p, rows = pivots[int(dim)], np.flatnonzero(dims == dim)
            for at in np.array_split(rows, -(-len(rows) // TILE)):
                x = matrix(batch.column("x").take(pa.array(at)).to_pylist(), int(dim)).astype(float)
                cell[at] = nearest(x, p)
                u = directions(p[cell[at]])
                a[at] = (x * u).sum(1)
                r[at] = np.sqrt(((x - a[at][:, None] * u) ** 2).sum(1)) * (1 + 1e-9)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(a), pa.array(r)], [*batch.schema.names, "cell", "a", "r"])


class Bounds(NamedTuple):
    """For queries and cells: b, s and whether the query asks the cell; for queries the score that the k-th best reaches."""

    b: np.ndarray
    s: np.ndarray
    asks: np.ndarray
    kth: np.ndarray


def _longest(b: np.ndarray, s: np.ndarray, c: Cells) -> np.ndarray:
    """The largest a b + r s with a in the cell's range and a a + r r at most n n: where the point (a, r) lies along
    (b, s), or at the end of the range next to that."""
    length = np.sqrt(b * b + s * s)
    along = c.norm * b / np.where(length > 0, length, 1.0)
    at = np.clip(along, c.low, c.high)
    rest = np.sqrt(np.maximum(c.norm * c.norm - at * at, 0) + 1e-12 * c.norm * c.norm)
    return np.where(at == along, c.norm * length, b * at + s * rest) * (1 + 1e-9 * np.sign(b * at + s * rest))


def bounds(q: np.ndarray, c: Cells, k: int) -> Bounds:
    b, s = split(q, c.directions)
    upper = np.minimum(np.maximum(b * c.low, b * c.high) + s * c.far, _longest(b, s, c))
    upper = np.where(c.count > 0, upper, -np.inf)
    lower = np.where(c.count > 0, np.minimum(b * c.low, b * c.high) - s * c.far, -np.inf)
    # k + 1 points reach the score, as one of them may be the query itself.
    order = np.argsort(-lower, axis=1)
    enough = np.cumsum(c.count[order], axis=1) >= k + 1
    kth = np.where(enough.any(1), np.take_along_axis(lower, np.take_along_axis(order, enough.argmax(1)[:, None], 1), 1)[:, 0], -np.inf)
    if len(c.pivots) > k:
        kth = np.maximum(kth, np.partition(q @ c.pivots.T, len(c.pivots) - k - 1, axis=1)[:, len(c.pivots) - k - 1])
    kth = kth - 1e-9 * (np.abs(np.where(np.isfinite(kth), kth, 0)) + np.sqrt((q * q).sum(1)) * np.sqrt((c.pivots * c.pivots).sum(1).max(initial=0)) + 1)
    return Bounds(b, s, upper >= kth[:, None], kth)


def _tiles(batch: pa.RecordBatch, cells: dict[int, Cells], k: int) -> Iterator[tuple[int, np.ndarray, Bounds]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        for at in np.array_split(rows, -(-len(rows) // TILE)):
            q = matrix(batch.column("x").take(pa.array(at)).to_pylist(), int(dim)).astype(float)
            yield int(dim), at, bounds(q, cells[int(dim)], k)


def _ask(batches: Iterator[pa.RecordBatch], cells: dict[int, Cells], k: int) -> Iterator[pa.RecordBatch]:
    """Adds the group of each query and the areas that it asks."""
    for batch in batches:
        group, areas = np.zeros(batch.num_rows, np.int32), [[]] * batch.num_rows
        for dim, at, found in _tiles(batch, cells, k):
            group[at] = cells[dim].group[batch.column("cell").to_numpy()[at]]
            for i, asks in zip(at, found.asks, strict=True):
                areas[i] = np.unique(cells[dim].area[asks])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group), pa.array(areas, pa.list_(pa.int32()))], [*batch.schema.names, "grp", "areas"])


def _summarise(batches: Iterator[pa.RecordBatch], cells: dict[int, Cells], k: int) -> Iterator[pa.RecordBatch]:
    """Of queries with their groups: for each group and cell that one of them asks, the range of b, the largest s and
    the lowest score to reach."""
    names = ["dim", "grp", "cell", "b_low", "b_high", "s", "kth"]
    for batch in batches:
        grp = batch.column("grp").to_numpy()
        for dim, at, found in _tiles(batch, cells, k):
            for g in np.unique(grp[at]):
                own = grp[at] == g
                asks = found.asks[own]
                cell = np.flatnonzero(asks.any(0))
                b, s = (np.where(asks, x[own], bad)[:, cell] for x, bad in ((found.b, np.inf), (found.s, -np.inf)))
                kth = np.where(asks, found.kth[own][:, None], np.inf)[:, cell].min(0)
                top = np.where(asks, found.b[own], -np.inf)[:, cell].max(0)
                n = len(cell)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, g, np.int32)), pa.array(cell.astype(np.int32)), pa.array(b.min(0)), pa.array(top), pa.array(s.max(0)), pa.array(kth)], names)


# -- the join --------------------------------------------------------------------------------------------------------


def _solve(k: int):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        asking = pdf.query_id.notna()
        out: list[tuple[int, int, int]] = []
        queries, near, dim = pdf[asking], pdf[~asking], int(pdf.dim.iat[0])
        if len(queries) and len(near):
            x, ids = matrix(near.x.to_list(), dim), near.ids.to_list()
            first = np.array([i[0] for i in ids])
            own = queries.query_id.astype("int64").to_numpy()
            for lo in range(0, len(queries), TILE):
                q = matrix(queries.x.iloc[lo : lo + TILE].to_list(), dim)
                for row, query in zip(_scores(q, x), own[lo : lo + TILE], strict=True):
                    # k + 1 points are enough, as only one of them can have the query's id and no other.
                    at = np.flatnonzero(row >= np.partition(row, len(row) - k - 1)[len(row) - k - 1]) if len(row) > k + 1 else np.arange(len(row))
                    at = at[np.lexsort((first[at], -row[at]))]
                    best = sorted((-int(row[i]), int(v)) for i in at for v in ids[i] if v != query)[:k]
                    out += [(int(query), v, -s) for s, v in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return solve


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact products, in the narrowest arithmetic that holds them."""
    most = int(np.abs(q.astype(float)).max()) * int(np.abs(x.astype(float)).max()) * q.shape[1]
    if most < 1 << 53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    if most < 1 << 62:
        return q @ x.T
    return np.clip(q.astype(object) @ x.T.astype(object), -_HIGH, _HIGH).astype(np.int64)


def _gathered(pivots: dict[int, np.ndarray], counts: dict[tuple[int, int], int], about: int) -> dict[int, np.ndarray]:
    """For each vector length the gathering of each cell: so many that one has about `about` rows, around the pivots
    with most rows."""
    found = {}
    for dim, p in pivots.items():
        n = np.array([counts.get((dim, c), 0) for c in range(len(p))])
        centres = np.argsort(-n, kind="stable")[: min(len(p), max(1, -(-int(n.sum()) // about)))]
        found[dim] = nearest(p, p[centres])
    return found


def _shares(spark: SparkSession, of: dict[int, np.ndarray], counts: dict[tuple[int, int], int], about: int, names: str) -> DataFrame:
    """(dim, gathering, how many shares of about `about` rows it takes), one row a gathering."""
    size: dict[tuple[int, int], int] = {}
    for (dim, cell), n in counts.items():
        key = dim, int(of[dim][cell])
        size[key] = size.get(key, 0) + n
    return F.broadcast(spark.createDataFrame([(d, g, max(1, -(-n // about))) for (d, g), n in size.items()], names))  # PIVOTS rows at most


class Join(NamedTuple):
    """Points as they go to groups of queries, and queries as they ask areas; a row each, with the block and part."""

    data: DataFrame
    asks: DataFrame


def replicated(vectors: DataFrame, every: int, k: int, pivots: int, scratch: Scratch) -> Join | None:
    """The rows that meet by (dim, grp, i, area, j), or None without any vectors.

    The driver gets the number of points of each vector length, the pivots and one summary a cell."""
    spark = vectors.sparkSession
    rows = scratch.keep(packed(vectors), "rows")
    pts = scratch.keep(points(rows, scratch, k), "points")
    sizes = {r.dim: r["count"] for r in pts.groupBy("dim").count().collect()}
    if not sizes:
        return None
    total, chosen = sum(sizes.values()), {}
    for dim, n in sizes.items():
        # A share of the pivots for each length, one at least; found by a threshold on the hash, not by a global sort.
        wanted = max(1, min(2 * round(n**0.5) + k + 1, pivots * n // total, n))
        share = max(1, -(-(1 << 20) * 2 * wanted // n))
        some = pts.where((F.col("dim") == dim) & (F.pmod(F.xxhash64(F.lit(1), "x"), F.lit(1 << 20)) < share))
        got = [bytes(r.x) for r in some.orderBy(F.xxhash64("x"), "x").limit(wanted).select("x").collect()]
        chosen[dim] = matrix(got, dim).astype(float) if got else np.zeros((1, dim))
    cells = scratch.keep(pts.mapInArrow(lambda b: _assign(b, chosen), "dim int, x binary, ids array<long>, cell int, a double, r double"), "cells")
    asked = rows.where(F.col("vec_id") % every == 0).select("dim", "x", F.col("vec_id").alias("query_id"))
    asked = scratch.keep(asked.mapInArrow(lambda b: _assign(b, chosen), "dim int, x binary, query_id long, cell int, a double, r double"), "asked")

    summary = cells.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.min("a").alias("low"), F.max("a").alias("high"), F.max("r").alias("far"), F.max(F.sqrt(F.col("a") * F.col("a") + F.col("r") * F.col("r"))).alias("norm")).collect()
    n_points = {(r.dim, r.cell): r.n for r in summary}
    n_asked = {(r.dim, r.cell): r["count"] for r in asked.groupBy("dim", "cell").count().collect()}
    if not n_asked:
        return None
    groups, areas = _gathered(chosen, n_asked, GROUP), _gathered(chosen, n_points, BLOCK)
    known = {}
    for dim, p in chosen.items():
        count, (low, high, far, norm) = np.zeros(len(p), np.int64), np.zeros((4, len(p)))
        for r in summary:
            if r.dim == dim:
                count[r.cell], low[r.cell], high[r.cell], far[r.cell], norm[r.cell] = r.n, r.low, r.high, r.far, r.norm * (1 + 1e-9)
        known[dim] = Cells(p, directions(p), count, low, high, far, norm, groups[dim], areas[dim])

    asking = scratch.keep(asked.drop("a", "r").mapInArrow(lambda b: _ask(b, known, k), "dim int, x binary, query_id long, cell int, grp int, areas array<int>"), "asking")
    wants = asking.mapInArrow(lambda b: _summarise(b, known, k), "dim int, grp int, cell int, b_low double, b_high double, s double, kth double")
    wants = wants.groupBy("dim", "grp", "cell").agg(F.min("b_low").alias("b_low"), F.max("b_high").alias("b_high"), F.max("s").alias("s"), F.min("kth").alias("kth"))
    parts = _shares(spark, groups, n_asked, GROUP, "dim int, grp int, parts int")
    blocks = _shares(spark, areas, n_points, BLOCK, "dim int, area int, blocks int")
    wants = scratch.keep(wants.join(parts, ["dim", "grp"]), "wants")

    area_of = spark.createDataFrame([(d, c, int(g)) for d, each in areas.items() for c, g in enumerate(each)], "dim int, cell int, area int")
    data = cells.join(F.broadcast(area_of), ["dim", "cell"]).join(blocks, ["dim", "area"]).join(broadcast_if_small(wants, BROADCAST_ROWS), ["dim", "cell"])
    data = data.where(F.greatest(F.col("a") * F.col("b_low"), F.col("a") * F.col("b_high")) + F.col("r") * F.col("s") >= F.col("kth"))
    data = data.select("dim", "grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), "area", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int").alias("j"), "x", "ids")
    asks = asking.join(parts, ["dim", "grp"]).withColumn("i", F.pmod(F.xxhash64("query_id", "x"), F.col("parts")).cast("int")).withColumn("area", F.explode("areas"))
    asks = asks.join(blocks, ["dim", "area"]).select("dim", "grp", "i", "area", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "x", "query_id")
    return Join(data, asks)


def top_k(vectors: DataFrame, every: int = 100, k: int = K, pivots: int = PIVOTS, scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every vector whose vec_id is divisible by `every`."""
    scratch = scratch or Scratch(vectors.sparkSession, "knn")
    join = replicated(vectors, every, k, pivots, scratch)
    if join is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    both = join.data.withColumn("query_id", F.lit(None).cast("long")).unionByName(join.asks.withColumn("ids", F.lit(None).cast("array<long>")))
    found = both.groupBy("dim", "grp", "i", "area", "j").applyInPandas(_solve(k), "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every hundredth vector, against all others."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 1024) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

QUERIES = {"op9_top_k": op9_top_k}
ORACLE = {"op9_top_k": OP9_SQL}
