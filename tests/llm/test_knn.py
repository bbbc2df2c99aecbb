import math
import random

import numpy as np
import pytest

from hardwood.llm import knn
from hardwood.llm.common import Scratch
from tests.llm.helpers import frame, tables

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10):
    pts = sorted({(i, tuple(math.floor(1024 * float(np.float32(c))) for c in v)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)})
    out = []
    for q in sorted({i for i, _ in pts if i % 100 == 0}):
        scores = {}
        for p, x in pts:
            for i, y in pts if p == q else ():
                if i != q and len(x) == len(y):
                    s = sum(a * b for a, b in zip(x, y, strict=True))
                    scores[i] = max(s, scores.get(i, s))
        best = sorted((-s, i) for i, s in scores.items())[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def clustered(seed, n, d=8, centres=4, spread=0.1):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(centres)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(middle)]) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(knn, "GROUP", 3)
    monkeypatch.setattr(knn, "BLOCK", 50)


def test_against_all_rows(spark, tmp_path, small):
    rows = clustered(5, 600)
    same = rows[7][1]
    rows += [(1000 + i, same) for i in range(120)] + [(1200, same), (1200, same), (700, rows[0][1])]
    rows += [(800, None), (801, []), (900, [1.0, None] + [0.0] * 6), (901, [float("nan")] * 8), (902, [float("inf")] * 8), (None, same), (1300, [1.0, 2.0]), (1301, [0.5, 0.25]), (1400, [0.0, 0.0, 1.0])]
    d = tables(spark, tmp_path, embeddings=frame(spark, [(i, v, 0) for i, v in rows], VECTORS))
    assert got(knn.op9_top_k(spark, d)) == brute(rows)


def test_ids_with_several_vectors_and_clashing_columns(spark, small):
    rows = clustered(6, 300) + [(200, [1.0] * 8), (200, [-1.0] * 8), (205, [2.0] * 8), (205, [-2.0] * 8)]
    df = frame(spark, [(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, cell int, dim int, ids string")
    assert got(knn.top_k(df)) == brute(rows)


def test_bounds_leave_out_far_areas(spark, small):
    """Of separate clusters most pairs of a point and a group of queries are never made; the result is whole."""
    rows = clustered(8, 2000, d=16, centres=20, spread=0.01)
    df = frame(spark, [(i, v, 0) for i, v in rows], VECTORS)
    join = knn.replicated(df, 100, 10, knn.PIVOTS, Scratch(spark, "test"))
    groups = join.asks.select("grp", "i").distinct().count()
    share = join.data.count() / (2000 * groups)
    print("share of points and groups that meet", share)
    assert share < 0.15
    assert got(knn.top_k(df)) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(500, 6)) * 100, rng.normal(size=(40, 6)) * 100
    p = x[:20]
    cell, u = knn.nearest(x, p), knn.directions(p)
    along, rest = knn.split(x, u)
    a, r = along[np.arange(500), cell], rest[np.arange(500), cell]
    of = [np.flatnonzero(cell == c) for c in range(20)]
    c = knn.Cells(p, u, np.array([len(i) for i in of]), np.array([a[i].min() for i in of]), np.array([a[i].max() for i in of]), np.array([r[i].max() for i in of]), np.array([np.sqrt((x[i] ** 2).sum(1)).max() for i in of]), np.zeros(20, int), np.zeros(20, int))
    upper = knn._longest(*knn.split(q, u), c)
    for k, i in enumerate(of):
        assert (upper[:, [k]] >= q @ x[i].T - 1e-6).all()
    found, scores = knn.bounds(q, c, 10), q @ x.T
    assert (found.kth <= np.sort(scores, 1)[:, -11]).all()
    for i in range(40):
        best = np.argsort(-scores[i])[:10]
        assert found.asks[i, cell[best]].all()
        assert (found.b[i, cell] * a + found.s[i, cell] * r >= scores[i] - 1e-6).all()


def test_large_components(spark):
    """Scores stay exact far beyond the range of doubles; what doesn't fit into 64 bits is cut and ties."""
    rows = [(0, [float(1 << 19), 1.0]), (1, [1.0, 0.0]), (2, [float(1 << 30), 3.0]), (3, [1e30, 1.0]), (4, [-1e30, 1.0]), (100, [float(1 << 20), 5.0])]
    top = (1 << 63) - 1
    want = []
    for q in (0, 100):
        scores = [(min(max(s, -top), top), i) for _, _, i, s in [x for x in brute(rows) if x[0] == q]]
        want += [(q, r, i, s) for r, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1])), 1)]
    assert got(knn.top_k(frame(spark, [(i, v, 0) for i, v in rows], VECTORS))) == want


def test_many_lengths(spark):
    """No limit on how many vector lengths there are."""
    rows = [(i * 50, [float(i % 7), *[1.0] * (i // 2)]) for i in range(60)]
    assert got(knn.top_k(frame(spark, [(i, v, 0) for i, v in rows], VECTORS))) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert knn.op9_top_k(spark, tables(spark, tmp_path, embeddings=frame(spark, [], VECTORS))).count() == 0
