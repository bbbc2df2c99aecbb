"""Language-model scores by subword lattices.

Each word, with a mark for the space before it, spans a lattice whose arcs are the pieces of an existing vocabulary; a
character without a piece has the arc of its byte pieces. The probability of a word is the sum over all its
segmentations, by a forward recursion in log space; a document's is the product over its words and its end.

Arcs are weighed in two ways, in the same lattice:

* by the vocabulary's own scores alone (`vocabulary_score`). The scores of the vocabulary at hand are ranks, so the
  piece at rank r weighs 1 / (r + 10), over their sum.
* by a model learned from the training documents (`score`). It is a sum over a few components: one for each frequent
  language of the training documents, one for the rest, so that a text's language need not be known when it is scored,
  and one of the vocabulary's own scores, which keeps texts unlike any training document from being priced out. In the
  learned components the weights by rank are only the start; some rounds of expectation maximisation over all distinct
  training words, weighted by their counts, replace them, and every training word also has one arc as a whole, whose
  uses are discounted in favour of its pieces.

Each task of a round sums its expected uses of pieces, and one number a piece and component reaches the driver. The
uses of the words' own arcs stay in a written table, (component, word, c, uses), which each round replaces.

The base is a word unigram with add-one counts. Words that are frequent in training (FREQUENT of them at most) are
looked up in a broadcast table; the counts and own arcs of all others come from a shuffled join, so no word is cut off
and FREQUENT changes no result.

Defined cases: null, empty and blank texts have the end token only; rows without doc_id count as training rows, rows
without lang belong to the rest, languages of equal frequency are taken by name; repeated rows count as often as they
occur, and equal texts get equal scores; texts are scored whole, and words of any length; columns but doc_id, text and
lang are not read; without training rows every count is 0 and both scores are those of the vocabulary; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hardwood.llm.common import Scratch, ascii_lower, packed, table, thrifty, words
from hardwood.llm.pieces import SPACE, PieceTable, Vocabulary, by_length, code_points, read_vocabulary

FOLDS, HELD = 7, 2
ROUNDS = 3
#: Added to every piece's expected count.
PRIOR = 0.01
#: Taken from the uses of each word's own arc and given to its pieces, as other words have to be expected.
DISCOUNT = 0.75
#: Words whose counts and own arcs are broadcast; the rest is joined.
FREQUENT = 100_000
#: Languages with a component of their own.
LANGUAGES = 7
#: Arcs of up to so many code points are worked on for all words at once, longer ones singly; words of more code points
#: than LONG are scored one by one.
DENSE, LONG = 4, 512


#: Rows and bytes of words that a task takes at a time, so that there are many words of each length and component.
GATHER_ROWS, GATHER_BYTES = 100_000, 8 << 20


def gathered(batches: Iterator[pa.RecordBatch], rows: int = GATHER_ROWS, most: int = GATHER_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


class Scores(NamedTuple):
    """Natural logs, by component: of each piece, of the words with an arc of their own, of the end of a document, of
    the component itself, and of all uses together. Without words, whole has the own arcs of a table's words in one sum."""

    pieces: np.ndarray
    words: dict[str, int]
    whole: np.ndarray
    ends: np.ndarray
    shares: np.ndarray
    total: np.ndarray

    def own(self, uses: np.ndarray) -> np.ndarray:
        """Log weights of own arcs by their uses, (components, words)."""
        with np.errstate(divide="ignore"):
            return np.log(uses) - self.total[:, None]


def normalised(pieces: np.ndarray, words: dict[str, int], whole: np.ndarray, documents: np.ndarray) -> Scores:
    """From expected uses, (components, pieces) and (components, words), and the documents of each component."""
    ends = documents + PRIOR
    total = pieces.sum(1) + whole.sum(1) + ends
    with np.errstate(divide="ignore"):
        return Scores(np.log(pieces / total[:, None]), words, np.log(whole / total[:, None]), np.log(ends / total), np.log(ends / ends.sum()), np.log(total))


def vocabulary_weights(v: Vocabulary) -> np.ndarray:
    """What the vocabulary's scores say: the piece at rank r weighs 1 / (r + 10), bytes as the last ranks; they sum to 1."""
    n = len(v.pieces)
    order = sorted(range(n), key=lambda i: (not v.normal[i], -v.scores[i], i))
    w = np.zeros(n)
    w[order] = 1 / (np.arange(n) + 10.0)
    return w / w.sum()


def first_scores(v: Vocabulary, words: dict[str, int], whole: np.ndarray, documents: np.ndarray) -> Scores:
    """Pieces get half of a component's mass, by the vocabulary's scores, and its own arcs, by their words' counts, the
    other half."""
    mass = np.maximum(whole.sum(1), 1.0)
    return normalised(vocabulary_weights(v) * mass[:, None], words, whole, documents)


def with_vocabulary(scores: Scores, v: Vocabulary, documents: float) -> Scores:
    """The scores with one more component, the last, of the vocabulary's own scores: no words with an arc of their own,
    an end as in the mean of the others, and the share of PRIOR documents."""
    end, share = np.exp(scores.ends).mean(), PRIOR / (documents + PRIOR)
    pieces = np.log(vocabulary_weights(v) * (1 - end))
    none = np.full((1, scores.whole.shape[1]), -np.inf)
    return Scores(
        np.concatenate([scores.pieces, pieces[None]]), scores.words, np.concatenate([scores.whole, none]), np.append(scores.ends, np.log(end)),
        np.append(scores.shares + np.log1p(-share if share < 1 else -0.5), np.log(share if share < 1 else 0.5)), np.append(scores.total, 0.0),
    )


class Arcs(NamedTuple):
    """Arcs of a batch of equal-length words: log weights of the short ones by length, (components, words, start), and
    the long ones, which are few, one by one."""

    dense: list[np.ndarray]
    row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    weight: np.ndarray

    def mirrored(self, size: int) -> Arcs:
        return Arcs([w[:, :, ::-1] for w in self.dense], self.row, size - self.start - self.length, self.length, self.weight)


def forward(arcs: Arcs, size: int) -> np.ndarray:
    """log sum over all segmentations of the first j code points, j = 0..size: (components, words, size + 1)."""
    k, n, _ = arcs.dense[0].shape
    alpha = np.full((k, n, size + 1), -np.inf)
    alpha[:, :, 0] = 0
    order = np.argsort(arcs.start + arcs.length, kind="stable")
    row, start, weight = arcs.row[order], arcs.start[order], arcs.weight[:, order]
    bounds = np.searchsorted((arcs.start + arcs.length)[order], np.arange(size + 2))
    for j in range(1, size + 1):
        options = np.stack([alpha[:, :, j - m] + arcs.dense[m - 1][:, :, j - m] for m in range(1, min(j, len(arcs.dense)) + 1)])
        top = options.max(0)
        total = top + np.log(np.exp(options - top).sum(0))
        own = slice(bounds[j], bounds[j + 1])
        for c in range(k if own.stop > own.start else 0):
            np.logaddexp.at(total[c], row[own], alpha[c, row[own], start[own]] + weight[c, own])
        alpha[:, :, j] = total
    return alpha


class Lattice:
    """Word probabilities under Scores."""

    def __init__(self, vocabulary: Vocabulary, scores: Scores):
        self.table, self.v, self.scores = PieceTable(vocabulary), vocabulary, scores
        # Looked up with -1 for no piece.
        self.padded = np.concatenate([scores.pieces, np.full((len(scores.pieces), 1), -np.inf)], 1)

    def _bytes(self, char: str) -> list[int]:
        return [self.v.byte_ids[b] if self.v.byte_ids[b] >= 0 else self.v.unknown for b in char.encode()]

    def _arcs(self, found: list[np.ndarray], batch: list[str], components: slice) -> Arcs:
        padded = self.padded[components]
        dense = [padded[:, ids] for ids in found[:DENSE]]
        for r, i in zip(*np.nonzero(found[0] < 0), strict=True):
            dense[0][:, r, i] = padded[:, self._bytes(batch[r][i])].sum(1)
        long = [(m, *np.nonzero(ids >= 0)) for m, ids in enumerate(found[DENSE:], DENSE + 1)]
        row, start = (np.concatenate([x[i] for x in long] or [np.zeros(0, np.int64)]) for i in (1, 2))
        length = np.concatenate([np.full(len(x[1]), x[0]) for x in long] or [np.zeros(0, np.int64)])
        ids = np.concatenate([found[m - 1][r, i] for m, r, i in long] or [np.zeros(0, np.int32)])
        return Arcs(dense, row, start, length, padded[:, ids])

    def _parts(self, batch: list[str]) -> Iterator[list[int]]:
        for index in by_length(batch):
            yield from [index] if len(batch[index[0]]) <= LONG else [[i] for i in index]

    def _whole(self, batch: list[str], components: slice) -> tuple[np.ndarray, np.ndarray]:
        """Slot (-1: none) and log weights of each word's own arc."""
        get = self.scores.words.get
        slot = np.array([get(w[1:], -1) for w in batch])
        weights = np.full((len(self.padded[components]), len(batch)), -np.inf)
        weights[:, slot >= 0] = self.scores.whole[components][:, slot[slot >= 0]]
        return slot, weights

    def log_probs(self, batch: list[str], own: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each word (with its space mark) in each component: (words, components).

        own: log weights of the words' own arcs, (components, words); by default those of the scores."""
        out, every = np.zeros((len(batch), len(self.padded))), slice(None)
        own = self._whole(batch, every)[1] if own is None else own
        for index in self._parts(batch):
            part = [batch[i] for i in index]
            found = self.table.substrings(code_points(part, len(part[0])))
            alpha = forward(self._arcs(found, part, every), len(part[0]))[:, :, -1]
            out[index] = np.logaddexp(alpha, own[:, index]).T
        return out

    def expected(self, batch: list[str], counts: np.ndarray, component: int) -> np.ndarray:
        """Expected uses of every piece, then of every own arc, over words of a component that occur so often."""
        slot, own = self._whole(batch, slice(component, component + 1))
        pieces, whole = self.uses(batch, counts, component, own[0])
        return np.concatenate([pieces, np.bincount(slot[slot >= 0], whole[slot >= 0], len(self.scores.words))])

    def uses(self, batch: list[str], counts: np.ndarray, component: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected uses of every piece, and of each word's own arc, whose log weights are given."""
        only, total, wholes = slice(component, component + 1), np.zeros(len(self.v.pieces)), np.zeros(len(batch))
        for index in self._parts(batch):
            part = [batch[i] for i in index]
            size = len(part[0])
            found = self.table.substrings(code_points(part, size))
            arcs = self._arcs(found, part, only)
            alpha = forward(arcs, size)[0]
            # The backward pass is the forward pass over the mirrored arcs.
            beta = forward(arcs.mirrored(size), size)[0][:, ::-1]
            whole = np.maximum(np.exp(own[index] - np.logaddexp(alpha[:, -1], own[index])) * counts[index] - DISCOUNT, 0)
            left = counts[index] - whole
            wholes[index] = whole
            for m, ids in enumerate(found, 1):
                r, i = np.nonzero(ids >= 0)
                weight = self.scores.pieces[component, ids[r, i]]
                total += np.bincount(ids[r, i], np.exp(alpha[r, i] + weight + beta[r, i + m] - alpha[r, -1]) * left[r], len(total))
            for r, i in zip(*np.nonzero(found[0] < 0), strict=True):
                use = np.exp(alpha[r, i] + arcs.dense[0][0, r, i] + beta[r, i + 1] - alpha[r, -1]) * left[r]
                for b in self._bytes(part[r][i]):
                    total[b] += use
        return total, wholes


# -- training --------------------------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(component, word, c) over the texts, A-Z lower-cased. Each task sums its own words before the shuffle."""
    return docs.select("component", F.explode(words(ascii_lower(F.col("text")))).alias("word")).groupBy("component", "word").agg(F.count("*").alias("c"))


_STEP = "component int, word string, c long, uses double, arc int"


def learn_scores(counts: DataFrame, documents: np.ndarray, v: Vocabulary, scratch: Scratch, rounds: int = ROUNDS) -> tuple[Scores, DataFrame]:
    """Scores by expectation maximisation over the rows of word_counts, a table kept in scratch that goes; and these
    rows with the uses of their own arcs.

    documents: of each component."""
    context, n = counts.sparkSession.sparkContext, len(v.pieces)
    whole = np.zeros((len(documents), 1))
    for r in counts.groupBy("component").agg(F.sum("c").alias("c")).collect():
        whole[r.component] = r.c
    scores = first_scores(v, {}, whole, documents)
    kept, learned = counts, counts.select("component", "word", "c", F.col("c").cast("double").alias("uses"))
    for _ in range(rounds):
        shared = context.broadcast((v, scores))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            """The words with their new uses, and then the task's sums: of each piece, and at n of all own arcs."""
            lattice = Lattice(*shared.value)
            total = np.zeros((len(lattice.padded), n + 1))
            names = ["component", "word", "c", "uses", "arc"]
            for batch in gathered(batches):
                component, c, before = batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(float), batch.column(3).to_numpy()
                text, after = [SPACE + w for w in batch.column(1).to_pylist()], np.zeros(len(c))
                for k in np.unique(component):
                    at = np.flatnonzero(component == k)
                    own = lattice.scores.own(before[None, at])[k]
                    pieces, after[at] = lattice.uses([text[i] for i in at], c[at], k, own)
                    total[k, :n] += pieces
                    total[k, n] += after[at].sum()
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(after), pa.nulls(len(c), pa.int32())], names)
            k, arc = np.nonzero(total)
            none = [pa.nulls(len(k), t) for t in (pa.string(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), *none, pa.array(total[k, arc]), pa.array(arc, pa.int32())], names)

        step = scratch.keep(learned.mapInArrow(thrifty(expect), _STEP), "uses")
        shared.destroy()
        scratch.drop(kept)
        kept, learned = step, step.where("word is not null").drop("arc")
        sums = step.where("arc is not null").groupBy("component", "arc").agg(F.sum("uses").alias("uses")).toArrow()
        total = np.zeros((len(documents), n + 1))
        total[sums.column("component").to_numpy(), sums.column("arc").to_numpy()] = sums.column("uses").to_numpy()
        scores = normalised(total[:, :n] + PRIOR, {}, total[:, n:], documents)
    return scores, learned


# -- scoring ---------------------------------------------------------------------------------------------------------

_DOC = "row long, doc_id long, held_out boolean, n_tokens long, frequent long, base double, logs array<double>, rare array<struct<word:string,n:int>>"
_RARE = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))
_tables: dict[int, tuple] = {}


def _by_component(lists: pa.ListArray, components: int) -> np.ndarray:
    """(components, rows) of lists with one number for each component."""
    return lists.flatten().to_numpy().reshape(-1, components).T if len(lists) else np.zeros((components, 0))


def _frequent_table(shared) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Slot, base score and log probabilities of the frequent words, worked out once per worker process and model."""
    v, scores, names, base, uses = shared.value[:5]
    key = hash((scores.pieces.tobytes(), uses.tobytes(), tuple(names)))
    if key not in _tables:
        _tables.clear()
        logs = Lattice(v, scores).log_probs([SPACE + w for w in names], scores.own(uses))
        _tables[key] = {w.encode(): i for i, w in enumerate(names)}, np.append(base, 0.0), np.concatenate([logs, np.zeros((1, logs.shape[1]))])
    return _tables[key]


def _score_rows(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Sums over the end and the frequent words of each text, and its other words with their counts."""
    denominator, ends = shared.value[5:]
    slots, base_of, logs_of = _frequent_table(shared)
    base_of_end = math.log10((ends + 1) / denominator)
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        ids, held, texts = batch.column(0), batch.column(2), batch.column(1)
        for lo in range(0, len(texts), 64):
            split = [(t.as_py() or "").encode().lower().split() for t in texts.slice(lo, 64)]
            n, size = len(split), np.array([len(ws) for ws in split])
            slot = np.fromiter((slots.get(w, -1) for ws in split for w in ws), np.int64, size.sum())
            of = np.repeat(np.arange(n), size)
            base = np.bincount(of, base_of[slot], n) + base_of_end
            logs = np.stack([np.bincount(of, logs_of[slot, k], n) for k in range(logs_of.shape[1])], 1)
            frequent = np.bincount(of, slot >= 0, n).astype(np.int64) + (ends > 0)
            rare: list[dict[str, int]] = [{} for _ in split]
            begin = np.cumsum(size) - size
            for i in np.flatnonzero(slot < 0).tolist():
                d = of[i]
                w = split[d][i - begin[d]].decode()
                rare[d][w] = rare[d].get(w, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(n)), ids.slice(lo, n), held.slice(lo, n), pa.array(size + 1), pa.array(frequent), pa.array(base), pa.array(list(logs), pa.list_(pa.float64())),
                    pa.array([[{"word": w, "n": c} for w, c in r.items()] for r in rare], _RARE),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "frequent", "base", "logs", "rare"],
            )
            row += n


def _rare_logs(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Logs, the log probabilities of each word by component, in place of uses in (word, c, uses)."""
    lattice = Lattice(*shared.value[:2])
    for batch in gathered(batches):
        logs = lattice.log_probs([SPACE + w for w in batch.column(0).to_pylist()], lattice.scores.own(_by_component(batch.column(2), len(lattice.padded))))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(list(logs), pa.list_(pa.float64()))], ["word", "c", "logs"])


def least_frequent(counts: DataFrame, most: int) -> int:
    """The least count c that at most `most` words reach, from a histogram of counts: each number up to 64 and 16 steps
    for each doubling after that, so it has some hundred rows."""
    c = F.col("c")
    step = F.when(c <= 64, c.cast("double")).otherwise(F.floor(F.log2(c) * 16) / 16 * 1000)
    seen, least = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("step")).collect():
        seen += r.n
        if seen > most:
            break
        least = r.c
    return (1 << 62) if least is None else least


def lattice_scores(docs: DataFrame, v: Vocabulary, frequent: int = FREQUENT, languages: int = LANGUAGES, rounds: int = ROUNDS, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    vocabulary_score."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lattice", pack=True)
    docs = docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id")).alias("held_out"), "lang")
    training = docs.where("not held_out")
    by_lang = training.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    ends = training.count()
    rest = ends - sum(r["count"] for r in by_lang)
    documents = np.array([*([rest] if rest or not by_lang else []), *(r["count"] for r in by_lang)], float)
    component = F.lit(0)
    for i, r in enumerate(by_lang, len(documents) - len(by_lang)):
        component = F.when(F.col("lang") == r.lang, F.lit(i)).otherwise(component)
    by_component = scratch.keep(word_counts(training.withColumn("component", component)), "by_component")
    scores, learned = learn_scores(by_component, documents, v, scratch, rounds)
    scores, components = with_vocabulary(scores, v, float(ends)), range(len(documents) + 1)
    uses = F.array(*(F.sum(F.when(F.col("component") == k, F.col("uses")).otherwise(0.0)) for k in components))
    counts = scratch.keep(learned.groupBy("word").agg(F.sum("c").alias("c"), uses.alias("uses")), "counts")
    n, v_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, distinct = n + ends, v_words + (ends > 0)
    denominator = n + distinct + 1
    top = counts.where(F.col("c") >= least_frequent(counts, frequent)).toArrow()
    base = np.log10((top.column("c").to_numpy() + 1) / denominator)
    shared = spark.sparkContext.broadcast((v, scores, top.column("word").to_pylist(), base, _by_component(top.column("uses").combine_chunks(), len(components)), denominator, ends))
    rows = scratch.keep(docs.mapInArrow(thrifty(lambda b: _score_rows(b, shared)), _DOC), "rows", as_dealt=True)
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    distinct_rare = rare.select("word").distinct().join(counts, "word", "left").select("word", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("uses", F.array(*[F.lit(0.0)] * len(components))).alias("uses"))
    priced = distinct_rare.mapInArrow(thrifty(lambda b: _rare_logs(b, shared)), "word string, c long, logs array<double>")
    found = rare.join(priced, "word")
    n_base = F.col("n") * F.log10((F.col("c") + 1) / F.lit(float(denominator)))
    sums = found.groupBy("row").agg(F.sum(n_base).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("seen"), *(F.sum(F.col("n") * F.col("logs")[k]).alias(f"more_{k}") for k in components))
    out = rows.drop("rare").join(sums, "row", "left")
    each = F.array(*(F.col("logs")[k] + F.coalesce(f"more_{k}", F.lit(0.0)) + F.lit(float(scores.ends[k] + scores.shares[k])) for k in components))
    out = out.withColumn("_each", each).withColumn("_top", F.array_max("_each"))
    vocabulary = F.col("_each")[components[-1]] - F.lit(float(scores.shares[-1]))
    total = F.col("_top") + F.log(F.aggregate("_each", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("_top"))))
    out = out.select(
        "doc_id", "held_out", "n_tokens", (F.col("frequent") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (total / F.lit(math.log(10))).alias("score"), (vocabulary / F.lit(math.log(10))).alias("vocabulary_score"),
    )
    return packed(out)


def op6_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base score and lattice score."""
    return lattice_scores(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), read_vocabulary())


QUERIES = {"op6_lattice_scores": op6_lattice_scores}
ORACLE: dict[str, str] = {}
