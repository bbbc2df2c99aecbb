import random
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from hardwood.llm import near_dups
from tests.llm.helpers import frame, odd_documents


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(rows, percent=85, k=3):
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
        least[root(n)] = i if least.get(root(n)) is None else min(x for x in (i, least[root(n)]) if x is not None)
    return sorted(((i, len(s), least[root(n)]) for n, (i, s) in enumerate(sets)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_odd_documents(spark):
    rows = [r[:2] for r in odd_documents()]
    out = near_dups.near_duplicates(frame(spark, rows, "doc_id long, text string"))
    assert got(out) == brute(rows)
    for r in out.collect():
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)


def test_large_group_of_near_copies(spark, monkeypatch):
    """A group whose pairs lie on both sides of the threshold, in buckets that are compared in blocks."""
    monkeypatch.setattr(near_dups, "SMALL", 4)
    monkeypatch.setattr(near_dups, "BLOCK", 8)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.choice((0, 1, 3, 5, 8, 14))):
            words[rng.randrange(120)] = f"r{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(words)))
    assert got(near_dups.near_duplicates(frame(spark, rows, "doc_id long, text string"))) == brute(rows)


@pytest.mark.parametrize("percent,k", [(80, 5), (95, 1)])
def test_other_settings(spark, percent, k):
    rows = [r[:2] for r in odd_documents(seed=2)]
    assert got(near_dups.near_duplicates(frame(spark, rows, "doc_id long, text string"), percent, k)) == brute(rows, percent, k)


def test_deduplicated_keeps_one_of_each_group(spark):
    docs = frame(spark, odd_documents()).selectExpr("*", "1 as component_id", "true as kept")
    out = near_dups.deduplicated(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    named = [i for i in ids if i is not None]
    assert len(named) == len(set(named)) and {5, 200, 201, 203} <= set(named) and not {100, 101} & set(named)
    # The copy without id goes with its group; the row without id and text is linked with nothing.
    assert [r for r in out.collect() if r.doc_id is None and r.text is not None] == [] and ids.count(None) == 1


def test_low_thresholds_are_refused(spark):
    with pytest.raises(ValueError):
        near_dups.near_duplicates(frame(spark, [], "doc_id long, text string"), percent=50)


def test_empty_table(spark):
    assert near_dups.near_duplicates(frame(spark, [], "doc_id long, text string")).count() == 0


def test_posterior_bounds():
    tests = near_dups.min_matches(85, 1e-6, near_dups.LONG_LOOKS)
    rng = np.random.default_rng(0)
    for n, least in tests:
        assert (rng.binomial(n, 0.85, 200_000) >= least).mean() > 0.9999
    assert tests[-1][1] > 0.78 * near_dups.LONG


def test_components_of_a_chain(spark):
    from hardwood.llm.common import Scratch

    links = frame(spark, [(i + 1, i) for i in range(40)] + [(101, 100)], "a long, b long")
    found = {r.node: r.component for r in near_dups.components(links, Scratch(spark, "t")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_deduplicated_keeps_other_texts_of_a_shared_id(spark):
    texts = {"a": "one two three four five six", "b": "seven eight nine ten eleven twelve", "c": "red green blue black white grey"}
    rows = [(1, texts["a"]), (1, texts["b"]), (1, texts["b"]), (2, texts["a"]), (2, texts["c"]), (3, texts["b"].upper()), (4, ""), (4, None), (4, None)]
    out = near_dups.deduplicated(frame(spark, rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(1, texts["a"]), (1, texts["b"]), (2, texts["c"]), (4, ""), (4, None)], key=str)


def test_rows_of_one_id_are_one_document(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "x y z w"), (3, "x y z w"), (2, "A b c d"), (4, "p q r s"), (4, None), (4, "")]
    found = got(near_dups.near_duplicates(frame(spark, rows, "doc_id long, text string").coalesce(1)))
    assert found == brute(rows) and (3, 2, 1) in found and (2, 2, 1) in found


def test_deduplicated_rows_without_id_and_clashing_columns(spark):
    rows = [(None, "one two three four"), (None, "one two three four"), (None, "ONE two three four"), (7, "five six seven"), (None, "five six seven"), (None, None)]
    docs = frame(spark, rows, "doc_id long, text string").selectExpr("*", "'K' as _key", "'I' as _id", "'R' as _row", "'G' as component_id")
    out = near_dups.deduplicated(docs).collect()
    assert sorted((r.doc_id, (r.text or "").lower()) for r in out if r.doc_id) == [(7, "five six seven")] and len(out) == 3
    assert {(r._key, r._id, r._row, r.component_id) for r in out} == {("K", "I", "R", "G")}


def peak_mb(step):
    tracemalloc.start()
    try:
        step()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("best,kind,width,looks", [(None, np.uint8, near_dups.LONG, near_dups.LONG_LOOKS), (4, np.uint16, near_dups.HASHES, near_dups.SHORT_LOOKS)])
def test_blocks_of_alike_nodes_take_little_memory(best, kind, width, looks):
    """Whole blocks of near copies, against all pairs one by one."""
    rng, n = np.random.default_rng(5), 600
    base, tests = rng.integers(0, 250, width), near_dups.min_matches(85, 1e-6, looks)
    sig = np.where(rng.random((2 * n, width)) < rng.choice([0.02, 0.11, 0.5], 2 * n)[:, None], rng.integers(0, 250, (2 * n, width)), base).astype(kind)
    bands = np.where(rng.random((2 * n, near_dups.BANDS)) < 0.5, np.arange(near_dups.BANDS), -1 - np.arange(2 * n)[:, None])
    bands[:, 1] = 1
    cluster = rng.integers(0, 40, 2 * n)
    pdf = pd.DataFrame({"node": rng.permutation(2 * n), "cluster": cluster, "band": 1, "sig": [x.tobytes() for x in sig], "bands": list(bands), "asks": np.arange(2 * n) < n})
    expected = []
    for q in range(n):
        equal = np.cumsum(sig[q] == sig[n:], 1)
        fits = np.all([equal[:, m - 1] >= least for m, least in tests], 0) & (cluster[q] != cluster[n:]) & ((bands[q] == bands[n:]).argmax(1) == 1)
        pairs = sorted((-int(equal[t, -1]), int(pdf.node[n + t])) for t in np.flatnonzero(fits))
        expected += [(int(pdf.node[q]), b, -e) for e, b in pairs[:best]]
    compare = near_dups._compare_block(tests, kind, best)
    found = compare(pdf)
    assert expected and sorted(map(tuple, found.values.tolist())) == sorted(expected)
    assert peak_mb(lambda: compare(pdf)) < 40
    assert not len(compare(pdf[pdf.asks])) and not len(compare(pdf[~pdf.asks]))


def test_long_signatures_of_short_texts_take_little_memory():
    texts = pa.array([None, "", *(f"a{i} b{i % 7} c d" for i in range(8000))])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], ["doc_id", "text"])
    found = {}

    def step():
        for part in near_dups._long_signatures(iter([batch]), 3):
            found.update(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))

    assert peak_mb(step) < 40
    assert sorted(found) == list(range(2, 8002)) and {len(x) for x in found.values()} == {near_dups.LONG}
    for i in (2, 1025, 1026, 8001):
        alone = pa.RecordBatch.from_arrays([pa.array([i]), texts.slice(i, 1)], ["doc_id", "text"])
        assert next(near_dups._long_signatures(iter([alone]), 3)).column(1)[0].as_py() == found[i]
