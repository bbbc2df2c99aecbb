from collections import defaultdict

import pytest

from hardwood.llm import mixing
from tests.llm.helpers import frame, odd_documents, tables


def filled(sizes, weights, cap=3):
    """Shares by weight, the excess over the caps shared again until none is above."""
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        whole, more = sum(weights[s] for s in open_), 0.0
        for s in list(open_):
            share = left * weights[s] / whole
            if target[s] + share >= cap * sizes[s]:
                more += target[s] + share - cap * sizes[s]
                target[s] = float(cap * sizes[s])
                open_.discard(s)
            else:
                target[s] += share
        left = more
    return target


def test_targets_and_cuts(spark, tmp_path):
    rows = odd_documents()
    d = tables(spark, tmp_path, documents=frame(spark, rows))
    got = mixing.op10_mix_sources(spark, d).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows if r[0] is not None}
    sizes = defaultdict(int)
    for _, text, _, s, _ in rows:
        sizes[s] += len((text or "").replace("　", "_").split())
    order = sorted((s for s in sizes if s is not None), key=str) + [None]
    target = filled(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        if r.doc_id is not None:
            assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(target[source[r.doc_id]])
            taken[source[r.doc_id]] += r.taken
        else:
            taken["s1" if r.size else None] += r.taken
    for s, n in taken.items():
        assert n == int(target[s] + 1e-9)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.op10_mix_sources(spark, d).collect()), key=str)


def test_mixed_documents_keep_columns(spark):
    rows = odd_documents()
    docs = frame(spark, rows).selectExpr("*", "1 as size", "'x' as target", "2 as _row")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert {r.size for r in out.collect()} == {1}
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("digits", [3, 4, 5])
def test_more_ranges_change_nothing(spark, digits):
    sized = mixing.with_sizes(frame(spark, odd_documents()))
    rows = lambda df: sorted(((r.doc_id, r.size, r.taken, r.copies) for r in df.collect()), key=str)
    assert rows(mixing.mix(sized, digits=digits)) == rows(mixing.mix(sized, digits=6))
    assert [mixing.range_digits(n) for n in (0, 10**8, 10**9, 10**11)] == [3, 3, 4, 6]


def test_rows_without_id_spread_over_ranges(spark):
    rows = [(None, f"text number {i}", "en", "s", 1) for i in range(300)]
    assert mixing.with_sizes(frame(spark, rows)).select("_key").distinct().count() == 300


def test_mixed_documents_like_copies(spark):
    """The rows are those that the decisions on keys and sizes name, repeats of the row at the cut included."""
    rows = odd_documents() + [(900, "again and again", "en", "s9", 1)] * 40 + [(901 + i, "other words here", "en", "s10", 1) for i in range(30)]
    docs = frame(spark, rows)
    want = {}
    for r in mixing.mix(mixing.with_sizes(docs)).collect():
        want[r.doc_id, r.text] = want.get((r.doc_id, r.text), 0) + r.copies
    got = {}
    for r in mixing.mixed_documents(docs).collect():
        got[r.doc_id, r.text] = got.get((r.doc_id, r.text), 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_empty_table(spark, tmp_path):
    assert mixing.op10_mix_sources(spark, tables(spark, tmp_path, documents=frame(spark, []))).count() == 0


@pytest.mark.parametrize("copies", [1, 3, 1000])
def test_repeated_rows_at_the_cut(spark, copies):
    """Equal rows are one key; what the mix takes of them still sums to the target, and no more than is there."""
    rows = [(1, "a b c d e f g", "en", "s0", 1)] * copies + [(2, "other words", "en", "s1", 1)] * copies
    got = mixing.mix(mixing.with_sizes(frame(spark, rows).repartition(7))).collect()
    for source in ("s0", "s1"):
        own = [r for r in got if r.source == source]
        assert len(own) == copies and sum(r.taken for r in own) == int(own[0].target + 1e-9) and all(r.taken <= 3 * r.size for r in own)
        assert max(r.taken for r in own) - min(r.taken for r in own) <= own[0].size
