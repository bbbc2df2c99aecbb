import numpy as np
from sentencepiece import SentencePieceProcessor

from hardwood.llm import pieces
from tests.llm.helpers import frame, odd_documents, tables

HARD = ["", " ", "  a  b ", "a\n\nb\t c", "日本語 😀 ñandú", "x" * 1000, "ab" * 300 + " c", "\x00\x01", "trailing \n", "▁a▁", "1 000 000", "supercalifragilistic expialidocious"]


def plain_viterbi(unit, v):
    """Ids of the path with the best sum of scores, of equal ones that with the shorter last piece."""
    ids = {p: i for i, (p, n) in enumerate(zip(v.pieces, v.normal, strict=True)) if n}
    longest, unknown = max(map(len, ids)), min(v.scores[i] for i in ids.values()) - 10.0
    best, back = [0.0], [(0, [])]
    for j in range(1, len(unit) + 1):
        options = []
        for i in range(j - 1, max(-1, j - longest - 1), -1):
            if unit[i:j] in ids:
                options.append((best[i] + v.scores[ids[unit[i:j]]], i, [ids[unit[i:j]]]))
            elif j - i == 1:
                options.append((best[i] + unknown, i, [v.byte_ids[b] for b in unit[i].encode()]))
        top = max(o[0] for o in options)
        _, i, own = next(o for o in options if o[0] == top)
        best.append(top)
        back.append((i, own))
    path, j = [], len(unit)
    while j:
        path, j = back[j][1] + path, back[j][0]
    return path


def test_like_the_library(spark, tmp_path):
    rows = odd_documents() + [(500 + i, t, "en", "s", 1) for i, t in enumerate(HARD)]
    d = tables(spark, tmp_path, documents=frame(spark, rows))
    library = SentencePieceProcessor(model_file=pieces.MODEL)
    got = pieces.op8_sentencepiece(spark, d).collect()
    want = sorted((str(r[0]), library.encode(r[1] or "")) for r in rows)
    assert sorted((str(r.doc_id), r.pieces) for r in got) == want
    assert all(r.round_trip and r.n_pieces == len(r.pieces) for r in got)
    text = {str(r[0]): r[1] for r in rows}
    v, paths = pieces.read_vocabulary(), {}
    for r in (x for x in got if x.doc_id is not None):
        units = pieces.Segmenter(v, False).units.findall("▁" + text[str(r.doc_id)].replace(" ", "▁")) if text[str(r.doc_id)] else []
        for u in units:
            paths.setdefault(u, plain_viterbi(u, v))
        best = [i for u in units for i in paths[u]]
        assert (r.n_viterbi, r.viterbi_agrees) == (len(best), best == r.pieces)
    assert {r.viterbi_agrees for r in got} == {True, False}


def test_viterbi_like_brute_force():
    """A unigram vocabulary made by hand: the best path of every word against all its segmentations."""
    rng = np.random.default_rng(0)
    names = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab", "aa"]
    v = pieces.Vocabulary(names, [0.0, *(-rng.random(len(names) - 1) * 5).tolist()], [-1] * 256, [False] + [True] * (len(names) - 1), 0, pieces.UNIGRAM)
    score = dict(zip(names, v.scores, strict=True))
    s = pieces.Segmenter(v)

    def best(word):
        found = {0: (0.0, [])}
        for j in range(1, len(word) + 1):
            options = []
            for i in range(j):
                p = word[i:j]
                if p in score and p != "<unk>":
                    options.append((found[i][0] + score[p], found[i][1] + [names.index(p)]))
                elif j - i == 1:
                    options.append((found[i][0] + s.unknown, found[i][1] + [0]))
            found[j] = max(options)
        return found[len(word)]

    words = ["▁" + "".join(rng.choice(list("abcz"), rng.integers(1, 9))) for _ in range(300)]
    for w, ids in zip(words, s._segment(words)[0], strict=True):
        total = sum(score[names[i]] if i else s.unknown for i in ids)
        assert abs(total - best(w)[0]) < 1e-9


def test_long_words_both_ways():
    s = pieces.Segmenter(pieces.read_vocabulary())
    for word in ("▁" + "thetionand" * 20, "▁" + "a" * 200, "▁" + "".join(chr(97 + i * 7 % 26) for i in range(220))):
        found = s.table.substrings(pieces.code_points([word], len(word)))
        assert (pieces.merge_long(len(word), found, s.scores) == pieces.merge_pairs(found, s.scores)).all()
        back, long = pieces.viterbi(found, s.scores, s.unknown), pieces.viterbi_long(len(word), found, s.scores, s.unknown)
        on_path = lambda b: [x[1].tolist() for x in pieces.walked(b, found)]
        assert on_path(back) == on_path(long)


def test_every_piece_is_found_and_words_keep_their_order():
    """Pieces whose hashes share their high bits too; words of all lengths, some spelled in bytes, in any order."""
    v = pieces.read_vocabulary()
    s = pieces.Segmenter(v)
    assert s.table.shared > 1
    for i, (p, n) in enumerate(zip(v.pieces, v.normal, strict=True)):
        if n and p:
            assert s.table.substrings(pieces.code_points([p], len(p)))[len(p) - 1][0, 0] == i
    library, rng = SentencePieceProcessor(model_file=pieces.MODEL), np.random.default_rng(1)
    words = ["▁" + "".join(rng.choice(list("etaoinshr\u4e9c\U0001f600z"), rng.integers(1, 30))) for _ in range(500)] + ["▁" + "the\U0001f600" * 100, "▁"]
    flat, size, n_best, same = s._segments(words)
    for w, ids, n, equal in zip(words, np.split(flat, np.cumsum(size)[:-1]), n_best, same, strict=True):
        best = plain_viterbi(w, v)
        assert (n, equal) == (len(best), best == ids.tolist())
        assert ids.tolist() == library.encode(w[1:]) or w == "▁"


def test_decode_and_columns(spark):
    v = pieces.read_vocabulary()
    docs = frame(spark, odd_documents()).selectExpr("*", "1 as pieces", "2 as ids")
    both = pieces.decode(pieces.encode(docs, v, into="ids"), v, pieces="ids")
    assert both.columns == [*(c for c in docs.columns if c != "ids"), "ids", "decoded"]
    assert all(r.decoded == (r.text or "") and r.pieces == 1 for r in both.collect())
    strange = spark.createDataFrame([([5, 99999, -3, 1],), (None,), ([],)], "pieces array<int>")
    assert sorted(len(r.decoded) for r in pieces.decode(strange, v).collect())[:2] == [0, 0]
    assert pieces.encode(docs.limit(0), v).count() == 0
