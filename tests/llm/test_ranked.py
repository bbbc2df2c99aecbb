import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from hardwood.llm import ranked
from hardwood.llm.common import Scratch
from tests import oracle
from tests.llm.helpers import frame, odd_documents, tables

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return ["".join(c.lower() if c.isascii() else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    documents, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    for item, own in asked.items():
        found = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * documents // total
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own & c.keys())
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def run(spark, docs, items, **kw):
    scratch = Scratch(spark, "t")
    return ranked.search(ranked.build(frame(spark, docs, DOCS), scratch, **kw), frame(spark, items, ITEMS), scratch)


def topics(seed, n, topics=6):
    """Documents that each keep to the words of one topic, and some common words."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        own = [f"t{i % topics}w{j}" for j in range(40)]
        rows.append((i, " ".join([rng.choice(own) for _ in range(rng.randint(5, 60))] + [rng.choice("abcdef") for _ in range(10)])))
    return rows


@pytest.mark.parametrize("depth", [0, 3])
def test_topics_against_brute_force(spark, monkeypatch, depth):
    monkeypatch.setattr(ranked, "SHARD", 8)
    monkeypatch.setattr(ranked, "FIRST", 1)
    docs = topics(1, 300)
    items = [(i, " ".join(random.Random(i).choice([f"T{i % 6}w{j}" for j in range(40)]) for _ in range(6)) + " a,b unknown") for i in range(12)]
    items += [(3, "t1w1 t2w2"), (50, None), (51, "nothing known"), (None, "a t0w1")]
    assert got(run(spark, docs, items, depth=depth)) == brute(docs, items)


def test_blocks_of_items_and_shuffled_visits(spark, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 20)
    monkeypatch.setattr(ranked, "FEW_VISITS", 1)
    monkeypatch.setattr(ranked, "SHARD", 20)
    docs, items = topics(2, 120), [(i, f"t{i % 6}w1 t{i % 6}w2 a b c") for i in range(14)]
    assert got(run(spark, docs, items)) == brute(docs, items)


def test_ties_repeated_rows_and_odd_texts(spark, tmp_path):
    docs = [r[:2] for r in odd_documents()] + [(500 - i, "equal Texts tie") for i in range(30)] + [(500, "equal texts tie")] * 3 + [(None, "equal texts tie")] * 2
    items = [(1, "EQUAL texts"), (2, "日本語 kan karia"), (3, "x"), (4, "tie")]
    odd = frame(spark, docs, DOCS).selectExpr("*", "1 as shard", "2 as item_id", "3 as n")
    folder = tables(spark, tmp_path, documents=odd, benchmark=frame(spark, items, ITEMS).selectExpr("*", "1 as doc_id", "2 as rank"))
    df = ranked.op12_ranked_search(spark, folder)
    assert got(df) == brute(docs, items)
    assert oracle.difference(df, oracle.views(folder), ranked.OP12_SQL) == ""


def test_bisection_separates_topics():
    rows = topics(3, 240, topics=4)
    names = {t: i for i, t in enumerate(sorted({t for _, x in rows for t in terms(x)}))}
    lists = [np.array(sorted({names[t] for t in terms(x)}), np.int64) for _, x in rows]
    ptr = np.r_[0, np.cumsum([len(x) for x in lists])]
    tree = ranked.bisect(ptr, np.concatenate(lists), 2)
    leaves = tree.leaves(ranked.Terms(ptr, np.concatenate(lists), np.ones(ptr[-1]), np.ones(len(lists))))
    assert len({(leaf, i % 4) for leaf, (i, _) in zip(leaves, rows, strict=True)}) == 4 and len(set(leaves)) == 4


def test_bounds_spare_shards(spark, monkeypatch):
    """Items of one topic end before they have seen the shards of the others."""
    monkeypatch.setattr(ranked, "SHARD", 8)
    monkeypatch.setattr(ranked, "FIRST", 2)
    monkeypatch.setattr(ranked, "FURTHER", 2)
    visited = []
    keep = Scratch.keep

    def watched(self, df, name):
        out = keep(self, df, name)
        if name == "visits":
            visited.append(out.selectExpr("coalesce(sum(size(asking)), 0)").first()[0])
        return out

    monkeypatch.setattr(Scratch, "keep", watched)
    docs = topics(4, 480)
    items = [(i, " ".join(f"t{i}w{j}" for j in range(3)) + " a") for i in range(6)]
    assert got(run(spark, docs, items)) == brute(docs, items)
    assert sum(visited) < 0.6 * 6 * 60


def test_empty_tables(spark):
    assert got(run(spark, [], [(1, "a")])) == [] and got(run(spark, [(1, "a")], [])) == [] and got(run(spark, [(1, ""), (2, None)], [(1, "a")])) == []
