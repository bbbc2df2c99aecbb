import math
from collections import Counter

import pytest
import xxhash

from hardwood.llm import quality
from tests.llm.helpers import frame, odd_documents, tables

LABELS = "doc_id long, quality int, toxic int"


def base(text):
    t = text or ""
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = {}
    for x in windows:
        count[x] = count.get(x, 0) + 1
    covered = {j for i, x in enumerate(windows) if count[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def cases():
    rows = odd_documents()
    rows += [(400, "a b c d e f g h " * 5, "en", "s", 1), (401, "## $% <a> | & *\nx\nx\n\n\n x", "en", "s", 1), (402, " ".join(f"w{i}" for i in range(30)) + " " + " ".join(f"w{i}" for i in range(9)), "en", "s", 1)]
    return rows


def test_base_features(spark, tmp_path):
    rows = cases()
    d = tables(spark, tmp_path, documents=frame(spark, rows), labels=frame(spark, [(1, 1, 0), (2, None, 0), (None, 1, 0), (3, 0, 0)], LABELS))
    out = quality.op7_quality_rules(spark, d)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out.collect()), key=str)
    assert got == sorted(((r[0], *base(r[1])) for r in rows), key=str)
    for r in out.collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)


def test_ratio_of_multinomials(spark):
    good, bad = "the cat sat on the mat and slept", "zz!! qq!! zz!! xx!! vv!! zz!!"
    docs = frame(spark, [(i, good if i < 6 else bad, "en", "s", 1) for i in range(8)])
    labels = frame(spark, [(0, 1, 0), (1, 1, 0)], LABELS)
    weights = quality.ratio_weights(docs, labels)
    out = {r.doc_id: r.llr for r in quality.judged(docs, weights).collect()}
    assert out[7] < 0 < out[0] == out[5]
    # Two trusted of six equal texts: each n-gram's share by hand, collisions aside. "the" occurs twice.
    n, b = 15, quality.BUCKETS
    raw, target = 6 * n + 2 * 11, 2 * n

    def ratio(trusted, all_):
        p = (all_ + 1) / (raw + b)
        return math.log((trusted + b * p) / ((target + b) * p))

    assert out[0] == pytest.approx((13 * ratio(2, 6) + 2 * ratio(4, 12)) / n, abs=0.02)


def test_no_trusted_documents_and_empty_tables(spark):
    docs, none = frame(spark, odd_documents()), frame(spark, [], LABELS)
    assert {r.llr for r in quality.judged(docs, quality.ratio_weights(docs, none)).collect()} == {0.0}
    assert quality.passing(docs.limit(0), none).count() == 0


def test_passing_keeps_columns(spark):
    docs = frame(spark, odd_documents()).selectExpr("*", "7 as kept", "'q' as llr", "8 as _w")
    out = quality.passing(docs, frame(spark, [(1, 1, 0)], LABELS))
    assert out.columns == docs.columns and out.count() and {r.kept for r in out.collect()} == {7}


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def ngrams(text):
    """Buckets of the words and pairs of a text, by plain Python."""
    words = [signed(xxhash.xxh64_intdigest(w, 42)) for w in (text or "").encode().replace(b"\x1c", b"_").split()]
    one = lambda x, seed: xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), seed)
    return [h % quality.BUCKETS for h in [*words, *(signed(one(b, one(a, 42))) for a, b in zip(words, words[1:]))]]


def test_scores_of_all_documents_like_brute_force(spark):
    rows = cases()
    trusted = {3, 4, 5, 300, 400}
    docs = frame(spark, rows)
    weights = quality.ratio_weights(docs, frame(spark, [(i, 1, 0) for i in trusted], LABELS))
    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(ngrams(r[1]))
        target.update(ngrams(r[1]) if r[0] in trusted else [])
    n, m, b = raw.total(), target.total(), quality.BUCKETS
    p = lambda x: (raw[x] + 1) / (n + b)
    ratio = lambda x: math.log((target[x] + b * p(x)) / ((m + b) * p(x)))
    want = []
    for r in rows:
        grams = ngrams(r[1])
        want.append((r[0], round(sum(map(ratio, grams)) / len(grams), 3) if grams else 0.0))
    got = [(r.doc_id, round(r.llr, 3)) for r in quality.judged(docs, weights).collect()]
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(a == pytest.approx(b, abs=0.0011) for (_, a), (_, b) in zip(got, want, strict=True))


def test_judged_keeps_any_column(spark):
    docs = frame(spark, odd_documents()).selectExpr("*", "7 as _n", "'q' as _w", "8 as _h", "9 as _row", "10 as _at", "1 as `a.b`", "5 as kept")
    out = quality.judged(docs, [0.0] * quality.BUCKETS)
    assert out.columns == [c for c in docs.columns if c != "kept"] + list(quality._ADDED)
    assert {tuple(r[c] for c in ("_n", "_w", "_h", "_row", "_at", "a.b")) for r in out.collect()} == {(7, "q", 8, 9, 10, 1)}
