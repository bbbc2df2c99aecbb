import random

import numpy as np
import pytest

from hardwood.llm import common, fragments
from tests import oracle
from tests.llm.helpers import files_written, frame, many_partitions, odd_documents, tables
from tests.llm.test_near_dups import shingles

DOCS = "doc_id long, text string"


def brute(rows, percent=90, k=3):
    """Documents are ids: what one row is linked with, the other rows of the id are linked with too."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if i is not None and j is not None and s and t and (i == j or 100 * len(s & t) >= percent * len(s | t)):
                label[root(a)] = root(b)
    least = {}
    for n, (i, _) in enumerate(sets):
        if i is not None:
            least[root(n)] = min(i, least.get(root(n), i))
    return sorted(((i, len(s), least.get(root(n)) if i is not None else None) for n, (i, s) in enumerate(sets)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def copies(seed, n, words, edits):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.choice(edits)):
            at = rng.randrange(len(own))
            own[at : at + rng.choice((0, 1))] = [f"r{rng.randrange(10**6)}"] * rng.choice((0, 1))
        rows.append((1000 - i, " ".join(own)))
    return rows


@pytest.mark.parametrize("percent,k", [(90, 3), (80, 5), (95, 1)])
def test_odd_documents(spark, percent, k):
    rows = [r[:2] for r in odd_documents(seed=percent)]
    assert got(fragments.jaccard_join(frame(spark, rows, DOCS), percent, k)) == brute(rows, percent, k)


@pytest.mark.parametrize("small", [3, 24])
def test_large_group_of_near_copies(spark, monkeypatch, small):
    """Pairs on both sides of the threshold, in buckets that are compared in blocks, and in many fragments."""
    monkeypatch.setattr(fragments, "SMALL", small)
    monkeypatch.setattr(fragments, "BLOCK", 8)
    monkeypatch.setattr(fragments, "TILE", 4)
    monkeypatch.setattr(fragments, "WIDE", 16)
    rows = copies(3, 70, 120, (0, 1, 2, 3, 4, 6, 8)) + [(i, t) for i, t in enumerate(["one two three"] * 3)]
    assert got(fragments.jaccard_join(frame(spark, rows, DOCS))) == brute(rows)


def test_sizes_at_the_bound(spark):
    """Sets that are prefixes of each other: each is linked with those of 90 % of its size at least."""
    rows = [(n, " ".join(f"w{i}" for i in range(n))) for n in (3, 4, 9, 11, 12, 13, 20, 22, 24, 40, 42, 44, 47, 60, 70, 71, 78, 86, 95, 200, 219, 222, 230)]
    assert got(fragments.jaccard_join(frame(spark, rows, DOCS))) == brute(rows)


def test_rows_of_one_id_are_one_document(spark):
    texts = [" ".join(f"{x}{i}" for i in range(30)) for x in "abc"]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (3, texts[1]), (2, texts[1].upper()), (4, texts[2]), (None, texts[2]), (5, None), (5, "")]
    found = got(fragments.jaccard_join(frame(spark, rows, DOCS).coalesce(1)))
    assert found == brute(rows) and (3, 28, 1) in found


def test_empty_segments_are_no_cut():
    """Every pair of sets that differs in few n-grams shares a key, however their hashes lie."""
    rng = np.random.default_rng(0)
    for size in (9, 10, 12, 15, 20, 40, 400):
        for _ in range(200):
            hashes = np.sort(rng.integers(0, 1 << 64, size + 1, dtype=np.uint64) >> np.uint64(rng.choice((0, 0, 3))))
            apart = int(0.1 * size)
            sets = [hashes[:-1], np.delete(hashes, rng.choice(size, apart, replace=False))]
            if len(np.intersect1d(*sets)) * 100 < 90 * len(np.union1d(*sets)):
                continue
            keys = []
            for s in sets:
                x = fragments.Sets(None, [], np.array([len(s)]), np.array([0]), s, None, None)
                keys.append(set(fragments._buckets(x, 90)[2].tolist()))
            assert keys[0] & keys[1] or np.array_equal(*sets)


def test_statement(spark, tmp_path):
    rows = [r for r in odd_documents() if r[0] is not None and r[0] != 101] + [(2000 + i, t, "en", "s", 1) for i, t in copies(1, 20, 60, (0, 1, 2))]
    docs = frame(spark, rows).selectExpr("*", "1 as node", "2 as component_id", "3 as bucket")
    folder = tables(spark, tmp_path, documents=docs)
    df = fragments.op11_jaccard_join(spark, folder)
    assert oracle.difference(df, oracle.views(folder), fragments.OP11_SQL) == ""


def test_empty_table_and_refused_settings(spark):
    assert fragments.jaccard_join(frame(spark, [], DOCS)).count() == 0
    with pytest.raises(ValueError):
        fragments.jaccard_join(frame(spark, [], DOCS), percent=10)


def test_few_files_from_many_partitions(spark, monkeypatch):
    """A group in blocks, pairs in small buckets and rows that share an id, with a file for several partitions."""
    monkeypatch.setattr(fragments, "SMALL", 6)
    rows = [*(r[:2] for r in odd_documents(seed=4)), *((i + 2000, t) for i, t in copies(8, 60, 120, (0, 1, 3, 9)))]
    files, n = files_written(monkeypatch), 280
    with many_partitions(spark, n):
        out = fragments.jaccard_join(frame(spark, rows, DOCS))
        assert got(out) == brute(rows)
        most = max(common.WAVES * spark.sparkContext.defaultParallelism, -(-n // common.PACK))
        assert out.rdd.getNumPartitions() <= most
    assert len(files) > 20 and max(files.values()) <= most
