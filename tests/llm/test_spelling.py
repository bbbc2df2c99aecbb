import random
import re
import zlib

import pytest

from hardwood.llm import spelling
from tests import oracle
from tests.llm.helpers import frame, odd_documents, tables

WORDS = "word string, n long"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    """{word: (n, n_near, form, form_n, root)} of {word: n}."""
    found = {}
    for w, n in words.items():
        beside = [x for x in words if near(w, x)]
        best = min(beside, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        found[w] = [n, len(beside), form, words.get(form)]
    for w in found:
        root = w
        while found[root][2] is not None:
            root = found[root][2]
        found[w].append(root)
    return {w: tuple(x) for w, x in found.items()}


def counted(rows):
    words = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                words[run] = words.get(run, 0) + 1
    return {w: n for w, n in words.items() if n >= 2}


def got(df):
    assert set(df.columns) == {"word", "n", "n_near", "form", "form_n", "root"}
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.mark.parametrize("hot", [1, 40, 5000])
def test_pairs_against_brute_force(spark, monkeypatch, hot):
    """Few letters, so that the trie is dense; every share of hot nodes gives the same."""
    monkeypatch.setattr(spelling, "HOT_PART", hot)
    rng = random.Random(hot)
    words = {"".join(rng.choice("abÿ") for _ in range(rng.randint(4, 8))): rng.choice((2, 3, 25, 300, 4000)) for _ in range(400)}
    assert got(spelling.variants(frame(spark, list(words.items()), WORDS))) == brute(words)


def test_chain_of_forms(spark):
    words = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20000, "xbcdefghijk": 1999}
    found = got(spelling.variants(frame(spark, list(words.items()), WORDS)))
    assert found == brute(words) and found["abcdefg"][4] == "abcdefghijk"


def test_every_edit_at_every_place(spark):
    word = "aabbccaab"
    others = {word[:i] + word[i + 1 :] for i in range(9)} | {word[:i] + "z" + word[i:] for i in range(10)} | {word[:i] + "z" + word[i + 1 :] for i in range(9)}
    words = {word: 1000} | dict.fromkeys(others, 2) | {"aabbcbaab" * 2: 5}
    assert got(spelling.variants(frame(spark, list(words.items()), WORDS))) == brute(words)


def test_odd_texts_against_brute_force_and_statement(spark, tmp_path):
    rng = random.Random(5)
    base = ["Überraschung", "recursive", "letters", "colourful", "straße" + "n", "abcdefg"]
    rows = [r[:2] for r in odd_documents()] + [(400 + i, " ".join(rng.choice(base) for _ in range(30)) + ".x-Letters_letters") for i in range(40)] + [(None, "letters recursive"), (401, "q" * 4000 + " " + "q" * 4000)]
    docs = frame(spark, rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as root")
    folder = tables(spark, tmp_path, documents=docs)
    df = spelling.op13_spelling_variants(spark, folder)
    assert got(df) == brute(counted(rows)) and df.where("form is not null").count() >= 2
    assert oracle.difference(df, oracle.views(folder), spelling.OP13_SQL) == ""


def test_groups(spark):
    found = spelling.groups(frame(spark, [("colours", 100), ("colors", 3), ("colour", 5), ("apart", 7)], WORDS)).collect()
    assert [tuple(r) for r in found] == [("colours", 3, 108, ["colours", "colour", "colors"])]


def test_empty_tables(spark):
    assert spelling.variants(frame(spark, [], WORDS)).count() == 0
    assert spelling.vocabulary(frame(spark, [(1, None), (2, "")], "doc_id long, text string")).count() == 0
