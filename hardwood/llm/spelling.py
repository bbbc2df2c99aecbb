"""Spelling variants by errata tries: words are near if one code point inserted, deleted or replaced makes them equal.

The words of the vocabulary form a trie, whose nodes are kept as rows (the prefix by its length and two hashes). At each
node the child with the most words is heavy, the others are light. A pair of near words parts at one node, and at least
one of the two lies in a light subtree there. So each light subtree is merged, with one character skipped or replaced:

* into the heavy subtree: the word with its character replaced by the heavy one, skipped, or put after the heavy one;
* with its light siblings: the words under one key, in which the character is a blank.

Terminals that coincide are the pairs. The end of a word counts as a child. A word meets at most log2(words) light edges
(small to large), so the merged words number n log n and not n times the alphabet times the length.

The trie is dealt by node. Nodes that hold more than a HOT_PART of all rows (the root and other short or common
prefixes; there are no more than HOT_PART of them by count) are joined by a broadcast, all others by a shuffle.

Defined cases: null and empty texts have no words; a null doc_id is an empty text in front of the colon; rows that repeat
count again; an empty table gives no rows; other columns of docs aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hardwood.llm.common import Scratch, ascii_lower, table

LETTERS = "[A-Za-zÀ-ÿ]"
#: One of so many (document, run) pairs loses a code point.
SLIP = 31
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A word's form occurs at least so many times as often.
FORM_RATIO = 10
#: A node with more than a HOT_PART of all rows of the trie is hot.
HOT_PART = 5000
BLANK = "*"


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the runs of letters in docs (doc_id, text), after the slips."""
    # A run is maximal: what starts at its first letter and takes all letters, so shorter runs never match.
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS}{{{least_length},}})"), F.lit(1))).alias("run"),
    )
    runs = runs.select(ascii_lower(F.col("run")).alias("run"), F.crc32(F.concat("id", F.lit(":"), ascii_lower(F.col("run")))).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % SLIP == 0, _without("run", at)).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _without(word: str, at: Column) -> Column:
    return F.concat(F.left(F.col(word), at), F.substr(F.col(word), at + 2))


def _edges(words: DataFrame) -> DataFrame:
    """A row for each word and node on its path: the node, and the character of the child ("" for the word's end)."""
    at = words.select("word", F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("d"))
    prefix = F.left(F.col("word"), F.col("d"))
    return at.select("word", "d", F.xxhash64(prefix).alias("h1"), F.xxhash64(F.lit(1), prefix).alias("h2"), F.substr(F.col("word"), F.col("d") + 1, F.lit(1)).alias("c"))


def light_edges(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, d, c, heavy): the nodes at which a word leaves the heavy path, its own character and the heavy one."""
    node = ["d", "h1", "h2"]
    edges = _edges(words)
    children = edges.groupBy(*node, "c").agg(F.count("*").alias("n"))
    heavy = children.groupBy(*node).agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("rows"), F.count("*").alias("children")).where("children > 1")
    heavy = scratch.keep(heavy.select(*node, F.col("m.c").alias("heavy"), "rows"), "heavy")
    total = heavy.agg(F.sum("rows")).first()[0] or 0
    is_hot = F.col("rows") * HOT_PART > total
    hot = heavy.where(is_hot).drop("rows").withColumn("hot", F.lit(True))
    tagged = edges.join(F.broadcast(hot), node, "left")
    shallow = tagged.where("hot and c <> heavy").select("word", "d", "c", "heavy")
    deep = tagged.where("hot is null").drop("hot", "heavy").join(heavy.where(~is_hot).drop("rows"), node).where("c <> heavy").select("word", "d", "c", "heavy")
    return scratch.keep(shallow.unionByName(deep), "light")


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) with a < b for all pairs of words (distinct, written) that one edit makes equal."""
    light = light_edges(words, scratch)
    before, after, rest = F.left(F.col("word"), F.col("d")), F.substr(F.col("word"), F.col("d") + 2), F.substr(F.col("word"), F.col("d") + 1)
    inner = F.col("c") != ""
    merged = F.array(
        F.when(inner, F.concat(before, "heavy", after)),
        F.when(inner, F.concat(before, after)),
        F.concat(before, "heavy", rest),
    )
    asked = light.select(F.col("word").alias("a"), F.explode(merged).alias("b")).where("b is not null")
    into_heavy = asked.join(words.select(F.col("word").alias("b")), "b", "left_semi")
    # No two words under a key are equal, so a key has at most as many as there are letters.
    siblings = light.where(inner).groupBy(F.concat(before, F.lit(BLANK), after).alias("key")).agg(F.collect_list("word").alias("all")).where(F.size("all") > 1)
    beside = siblings.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b")).where("a < b")
    both = into_heavy.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(beside)
    return both.distinct()


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of the words that have a form, by jumps that double in length; counts rise along a chain at least
    FORM_RATIO times, so there are few."""
    reached = scratch.keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = scratch.keep(reached.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        scratch.drop(reached)
        reached = moved
        if reached.where("moved").isEmpty():
            return reached.select("word", "root")


def variants(words: DataFrame, ratio: int = FORM_RATIO, scratch: Scratch | None = None) -> DataFrame:
    """word, n, n_near, form, form_n, root of each row of words (word, n; words are distinct)."""
    scratch = scratch or Scratch(words.sparkSession, "spelling")
    words = scratch.keep(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_pairs(words, scratch)
    both = scratch.keep(pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p")).select("p.*"), "near")
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    is_form = -F.col("best.m") >= F.lit(ratio) * F.col("n")
    with_form = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n"),
    )
    with_form = scratch.keep(with_form, "forms")
    last = roots(with_form.where("form is not null").select("word", "form"), scratch)
    return with_form.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def groups(words: DataFrame) -> DataFrame:
    """root, n_words, n and the words of each group of two or more, most frequent first; a group has as many words as
    lead to its root, so this is for reading, not for joins."""
    found = variants(words).withColumn("_r", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("n"), "word")))
    grouped = found.groupBy("root").agg(F.count("*").alias("n_words"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("_r", "word"))).alias("m"))
    return grouped.where("n_words > 1").select("root", "n_words", "n", F.col("m.word").alias("words"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word that occurs twice, its near words, form and root."""
    scratch = Scratch(spark, "spelling")
    return variants(vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text")), scratch=scratch)


OP13_SQL = r"""
WITH RECURSIVE r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
k AS (SELECT id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
-- crc32: one table entry per byte value, then one step per byte.
t AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS x(i)),
x AS (SELECT id, run, n, hex(encode(id || ':' || run)) AS x FROM k),
b AS (SELECT id, run, n, list_transform(range(1, CAST(length(x) / 2 AS BIGINT) + 1), lambda i: CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT)) AS b FROM x),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS h FROM b, t),
s AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i) AS p, substr(word, i + 2) AS q FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
e AS (SELECT DISTINCT d.word AS a, w.word AS b FROM d JOIN w ON w.word = d.p || d.q),
m AS (
  SELECT a, b FROM e UNION SELECT b, a FROM e
  UNION SELECT x.word, y.word FROM d x JOIN d y ON x.i = y.i AND x.p || '*' || x.q = y.p || '*' || y.q AND x.word <> y.word),
f AS (SELECT m.a AS word, count(*) AS n_near, min({'m': -w.n, 'b': m.b}) AS best FROM m JOIN w ON w.word = m.b GROUP BY m.a),
g AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 10 * w.n THEN best.b END AS form, CASE WHEN -best.m >= 10 * w.n THEN -best.m END AS form_n
      FROM w LEFT JOIN f USING (word)),
z(word, root, form) AS (SELECT word, word, form FROM g UNION ALL SELECT z.word, g.word, g.form FROM z JOIN g ON g.word = z.form)
SELECT g.word, g.form, z.root, g.n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM g JOIN z ON z.word = g.word AND z.form IS NULL
"""

QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLE = {"op13_spelling_variants": OP13_SQL}
