import math
import zlib
from collections import Counter

import numpy as np
import pytest

from hardwood.llm import common, lattice, pieces
from tests.llm.helpers import files_written, frame, many_partitions, odd_documents, tables


def small_model():
    names = ["<unk>", "▁", "a", "b", "ab", "ba", "▁a", "aab", "babab", "bbbbb", *(f"<{i}>" for i in range(256))]
    v = pieces.Vocabulary(names, [0.0] * len(names), list(range(10, 266)), [False] + [True] * 9 + [False] * 256, 0, pieces.UNIGRAM)
    rng = np.random.default_rng(1)
    uses = rng.random((2, len(names)))
    scores = lattice.normalised(uses, {"ab": 0, "bbb": 1}, np.array([[3.0, 0.0], [0.5, 2.0]]), np.array([4.0, 6.0]))
    return v, names, scores


def paths(word, names, v, table, k):
    """Probability of each segmentation and its pieces, by plain recursion."""
    if not word:
        return [(1.0, [])]
    out = []
    for n in range(1, len(word) + 1):
        if word[:n] in names[1:10]:
            i = names.index(word[:n])
            out += [(math.exp(table.pieces[k, i]) * p, [i, *rest]) for p, rest in paths(word[n:], names, v, table, k)]
        elif n == 1:
            ids = [v.byte_ids[b] for b in word[0].encode()]
            out += [(math.exp(sum(table.pieces[k, i] for i in ids)) * p, [*ids, *rest]) for p, rest in paths(word[1:], names, v, table, k)]
    return out


WORDS = ["▁a", "▁ab", "▁bbb", "▁babab", "▁aabbbbbab", "▁zé", "▁b", "▁ababab"]


def test_marginals_like_brute_force():
    v, names, scores = small_model()
    got = lattice.Lattice(v, scores).log_probs(WORDS)
    for w, logs in zip(WORDS, got, strict=True):
        for k in (0, 1):
            whole = math.exp(scores.whole[k, scores.words[w[1:]]]) if w[1:] in scores.words else 0.0
            assert logs[k] == pytest.approx(math.log(whole + sum(p for p, _ in paths(w, names, v, scores, k))))


def test_expected_uses_like_brute_force():
    v, names, scores = small_model()
    counts = np.array([2.0, 5.0, 1.0, 3.0, 1.0, 2.0, 1.0, 7.0])
    got = lattice.Lattice(v, scores).expected(WORDS, counts, 1)
    want = np.zeros(len(names) + 2)
    for w, c in zip(WORDS, counts, strict=True):
        each = paths(w, names, v, scores, 1)
        total = sum(p for p, _ in each)
        own = math.exp(scores.whole[1, scores.words[w[1:]]]) if w[1:] in scores.words else 0.0
        whole = max(c * own / (own + total) - lattice.DISCOUNT, 0)
        if w[1:] in scores.words:
            want[len(names) + scores.words[w[1:]]] += whole
        for p, ids in each:
            for i in ids:
                want[i] += (c - whole) * p / total
    assert got == pytest.approx(want)


def test_base_and_model(spark, tmp_path):
    rows = odd_documents()
    d = tables(spark, tmp_path, documents=frame(spark, rows))
    got = lattice.op6_lattice_scores(spark, d).collect()
    tokens = [(r[0], (r[1] or "").encode().lower().split()) for r in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [w for i, w in tokens if not held(i)]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()) + len(train), len(c) + 1
    base = lambda w: sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
    want = sorted(((i, held(i), len(w) + 1, 1 + sum(x in c for x in w), n, round(base(w), 5)) for i, w in tokens), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=str) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def plain_forward(word, weight, unit, longest):
    """log sum over all segmentations of each prefix, and of each suffix, by plain recursion over a dict of pieces."""
    n = len(word)
    arcs = [(i, j, word[i:j]) for i in range(n) for j in range(i + 1, min(n, i + longest) + 1) if word[i:j] in weight]
    arcs += [(i, i + 1, None) for i in range(n) if word[i] not in weight]
    cost = lambda i, x: weight[x] if x is not None else sum(unit[b] for b in word[i].encode())
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)
    before, after = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for i, j, x in sorted(arcs, key=lambda a: a[:2]):
        before[j] = add(before[j], before[i] + cost(i, x))
    for i, j, x in sorted(arcs, key=lambda a: a[:2], reverse=True):
        after[i] = add(after[i], cost(i, x) + after[j])
    return before, after, [(i, j, x, cost(i, x)) for i, j, x in arcs]


def plain_scores(rows, v):
    """Both scores of every document, in natural logs, by plain Python: the whole fit and the scoring."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    docs = [(i, (t or "").encode().lower().decode().translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" "), lang) for i, t, lang, *_ in rows]
    docs = [(i, [w for w in words if w], lang) for i, words, lang in docs]
    train = [d for d in docs if not held(d[0])]
    langs = [x for x, _ in sorted(Counter(d[2] for d in train if d[2]).items(), key=lambda kv: (-kv[1], kv[0]))]
    names = [None, *langs] if any(d[2] is None for d in train) else langs
    ids = {p: i for i, (p, n) in enumerate(zip(v.pieces, v.normal, strict=True)) if n}
    longest = max(map(len, ids))
    first = lattice.vocabulary_weights(v)
    models = []
    for name in names:
        own = [d for d in train if d[2] == name]
        c = Counter(w for d in own for w in d[1])
        ends = len(own) + lattice.PRIOR
        pieces, uses = first * max(c.total(), 1), dict(c)
        for step in range(lattice.ROUNDS + 1):
            total = pieces.sum() + sum(uses.values()) + ends
            with np.errstate(divide="ignore"):
                logs = np.log(pieces / total)
            weight, unit = {p: logs[i] for p, i in ids.items()}, [logs[i] for i in v.byte_ids]
            if step == lattice.ROUNDS:
                break
            new, after_uses = np.full(len(first), lattice.PRIOR), {}
            for w, n in c.items():
                f, back, arcs = plain_forward("▁" + w, weight, unit, longest)
                o = math.log(uses[w] / total) if uses[w] else -math.inf
                after_uses[w] = max(n / (1 + math.exp(min(f[-1] - o, 700))) - lattice.DISCOUNT, 0) if uses[w] else 0.0
                for i, j, x, cost in arcs:
                    use = math.exp(f[i] + cost + back[j] - f[-1]) * (n - after_uses[w])
                    for p in [ids[x]] if x is not None else [v.byte_ids[b] for b in ("▁" + w)[i].encode()]:
                        new[p] += use
            pieces, uses = new, after_uses
        models.append((weight, unit, {w: math.log(u / total) for w, u in uses.items() if u}, math.log(ends / total), len(own) + lattice.PRIOR))
    end = sum(math.exp(m[3]) for m in models) / len(models)
    share = lattice.PRIOR / (len(train) + lattice.PRIOR)
    logs = np.log(first * (1 - end))
    models = [(*m[:4], math.log(m[4] / sum(x[4] for x in models) * (1 - share))) for m in models]
    models.append(({p: logs[i] for p, i in ids.items()}, [logs[i] for i in v.byte_ids], {}, math.log(end), math.log(share)))
    seen, out = {}, []
    for i, words, _ in docs:
        each = []
        for k, (weight, unit, own, of_end, prior) in enumerate(models):
            logp = of_end
            for w in words:
                if (k, w) not in seen:
                    seen[k, w] = np.logaddexp(plain_forward("▁" + w, weight, unit, longest)[0][-1], own.get(w, -math.inf))
                logp += seen[k, w]
            each.append((logp, prior))
        out.append((i, np.logaddexp.reduce([a + b for a, b in each]), each[-1][0]))
    return out


def test_both_scores_like_plain_python(spark):
    """The query's scores: the fit by components and rounds, own arcs, the vocabulary's component and the mixture."""
    rows = [r for r in odd_documents() if r[0] != 300]
    got = lattice.lattice_scores(frame(spark, rows), pieces.read_vocabulary()).collect()
    want = sorted(((i, round(a / math.log(10), 3), round(b / math.log(10), 3)) for i, a, b in plain_scores(rows, pieces.read_vocabulary())), key=str)
    have = sorted(((r.doc_id, round(r.score, 3), round(r.vocabulary_score, 3)) for r in got), key=str)
    assert [x[0] for x in have] == [x[0] for x in want]
    for a, b in zip(have, want, strict=True):
        assert a[1] == pytest.approx(b[1], rel=1e-4, abs=2e-3) and a[2] == pytest.approx(b[2], rel=1e-4, abs=2e-3)


def test_probabilities_sum_to_less_than_one():
    """Over all words of up to three letters, a word's probabilities leave room for the end."""
    import itertools

    v, _, scores = small_model()
    words = ["▁" + "".join(x) for n in (1, 2, 3) for x in itertools.product("ab", repeat=n)]
    total = np.exp(lattice.Lattice(v, scores).log_probs(words)).sum(0) + np.exp(scores.ends)
    assert (total < 1).all()


def test_no_training_rows_and_empty_table(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    v = pieces.read_vocabulary()
    row = lattice.lattice_scores(frame(spark, [(held, "some text", "en", "s", 1)]), v).collect()
    assert row[0].n_known == 0 and row[0].train_tokens == 0 and math.isfinite(row[0].score)
    assert lattice.lattice_scores(frame(spark, []), v).count() == 0


def test_scores_do_not_depend_on_what_is_broadcast(spark):
    """Every training word has its own arc, whether it is looked up or joined."""
    docs, v = frame(spark, odd_documents()), pieces.read_vocabulary()
    got = [sorted(((r.doc_id, r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lattice.lattice_scores(docs, v, frequent=n).collect()), key=str) for n in (1000, 3, 0)]
    assert got[0] == got[1] == got[2]


@pytest.mark.parametrize("most", [0, 1, 3, 50, 200, 10**6])
def test_frequent_words_by_a_histogram(spark, most):
    """No more words than asked for have the count, and hardly fewer: the steps of the histogram are narrow."""
    counts = [1] * 100 + [2] * 40 + [63, 64, 65, 66, 1000, 1001, 5_000_000]
    df = frame(spark, [(str(i), c) for i, c in enumerate(counts)], "word string, c long")
    least = lattice.least_frequent(df, most)
    taken = sum(c >= least for c in counts)
    assert taken <= most and taken >= {0: 0, 1: 1, 3: 1, 50: 47, 200: 147, 10**6: 147}[most]
    assert lattice.least_frequent(df.limit(0), most) > 10**9


def test_same_scores_and_few_files_from_many_partitions(spark, monkeypatch):
    """Rows keep apart, and the tables of shuffled words have a file for several partitions."""
    docs, v, n = frame(spark, odd_documents()), pieces.read_vocabulary(), 300
    scores = lambda df: sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in df.collect()), key=str)
    want = scores(lattice.lattice_scores(docs, v, frequent=3))
    files = files_written(monkeypatch)
    with many_partitions(spark, n):
        out = lattice.lattice_scores(docs.repartition(n // 3), v, frequent=3)
        assert scores(out) == want
        most = max(common.WAVES * spark.sparkContext.defaultParallelism, -(-n // common.PACK))
        assert out.rdd.getNumPartitions() <= most
    assert max(c for name, c in files.items() if not name.startswith("rows-")) <= most and any(name.startswith("rows-") for name in files)
