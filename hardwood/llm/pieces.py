"""SentencePiece encoding and decoding in batches of numpy arrays.

Words of equal length advance together. All substrings of such a batch are hashed from one running sum and looked up
among the sorted hashes of the pieces. A Viterbi pass over the positions follows: the maxima of all words are taken at
once and kept as backpointers. For a unigram model its path is the model's segmentation. A BPE model segments otherwise:
its scores rank merges, and the path with the best sum of ranks is often another one. For it the same looked-up scores
drive the merges: at each step every word of the batch joins its best pair, found by one vectorised maximum; the Viterbi
path can be had beside that, as its number of pieces and whether both agree. Characters without a piece become byte
pieces.

Defined cases: null texts have no pieces and decode to ""; an empty text has no pieces; U+2581 in a text decodes to a
space, as the format can't tell them apart; of equal sums the shorter last piece counts, of equal pairs the leftmost;
repeated rows are encoded alike; a text is encoded whole, a word of a million characters too; columns of the input stay,
and those named like an added one are replaced; ids outside the vocabulary decode to U+FFFD; an empty table gives no
rows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hardwood.llm import wordbytes
from hardwood.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: Distinct units that a worker remembers, and code points from which a unit is segmented on its own.
REMEMBERED, LONG = 150_000, 256
#: Cells (words * length) of one batch of equal-length words.
CELLS = 1 << 15


class Vocabulary(NamedTuple):
    """What a model file says: pieces by id, their scores, the ids of bytes 0..255 (-1: none), unknown id, kind."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    normal: list[bool]
    unknown: int
    kind: int


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    """Reads a model file on the driver; the vocabulary then goes to the tasks with their code."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    sp = SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    byte_ids = [-1] * 256
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[1:-1], 16)] = i
    normal = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
    return Vocabulary([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], byte_ids, normal, sp.unk_id(), proto.trainer_spec.model_type)


# -- substrings of equal-length words --------------------------------------------------------------------------------

_BASE = 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        _powers[:] = []
        for b in (_BASE, _INVERSE):
            p = np.full(max(n + 1, 4096), b, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers


class PieceTable:
    """Sorted hashes of the pieces, to look up every substring of a batch of equal-length words."""

    def __init__(self, vocabulary: Vocabulary):
        pieces = [(p, i) for i, (p, n) in enumerate(zip(vocabulary.pieces, vocabulary.normal, strict=True)) if n and p]
        self.longest = max((len(p) for p, _ in pieces), default=1)
        keys, ids = [], []
        for length in sorted({len(p) for p, _ in pieces}):
            own = [(p, i) for p, i in pieces if len(p) == length]
            keys.append(self._hashes(code_points([p for p, _ in own], length), length)[:, 0])
            ids.append(np.array([i for _, i in own], np.int32))
        key, ident = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(key)
        self.keys, self.ids = key[order], ident[order]
        #: The first key with these 20 high bits, -1 for none: most substrings are no piece and end here. Some keys share
        #: these bits; `shared` is the most that do.
        high = (self.keys >> np.uint64(44)).astype(np.int64)
        self.first = np.full(1 << 20, -1, np.int32)
        self.first[high[::-1]] = np.arange(len(high), dtype=np.int32)[::-1]
        self.shared = int(np.bincount(high).max()) if len(high) else 0
        self.keys = np.r_[self.keys, np.zeros(self.shared, np.uint64)]
        self.ids = np.r_[self.ids, np.full(self.shared, -1, np.int32)]

    @staticmethod
    def _hashes(points: np.ndarray, length: int) -> np.ndarray:
        """Of every substring of this length: (words, positions)."""
        n, size = points.shape
        power, inverse = _power(size)
        sums = np.zeros((n, size + 1), np.uint64)
        np.cumsum(wordbytes.mix64(points.astype(np.uint64) + np.uint64(1)) * power[:size], axis=1, out=sums[:, 1:])
        return wordbytes.mix64((sums[:, length:] - sums[:, : size + 1 - length]) * inverse[: size + 1 - length] + np.uint64(length))

    def substrings(self, points: np.ndarray) -> list[np.ndarray]:
        """For each length 1..longest: the piece id at each position, or -1."""
        n, size = points.shape
        power, inverse = _power(size)
        sums = np.zeros((n, size + 1), np.uint64)
        np.cumsum(wordbytes.mix64(points.astype(np.uint64) + np.uint64(1)) * power[:size], axis=1, out=sums[:, 1:])
        found = []
        for length in range(1, min(size, self.longest) + 1):
            h = wordbytes.mix64((sums[:, length:] - sums[:, : size + 1 - length]) * inverse[: size + 1 - length] + np.uint64(length)).ravel()
            out = np.full(len(h), -1, np.int32)
            at = self.first[(h >> np.uint64(44)).view(np.int64)]
            maybe = np.flatnonzero(at >= 0)
            at, h = at[maybe], h[maybe]
            for _ in range(self.shared):
                hit = self.keys[at] == h
                out[maybe[hit]] = self.ids[at[hit]]
                maybe, at, h = maybe[~hit], at[~hit] + 1, h[~hit]
            found.append(out.reshape(n, size + 1 - length))
        return found


def code_points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def by_length(words: list[str], cells: int = CELLS) -> Iterator[list[int]]:
    """Indices of words of one length each, in batches of about `cells` code points."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for length, index in groups.items():
        step = max(1, cells // max(1, length))
        for lo in range(0, len(index), step):
            yield index[lo : lo + step]


# -- segmentation ----------------------------------------------------------------------------------------------------


def viterbi(found: list[np.ndarray], scores: np.ndarray, unknown: float) -> np.ndarray:
    """Start of the piece that ends at each position 1..L on the best path to it: (words, L + 1)."""
    n, size = found[0].shape
    best = np.full((n, size + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, size + 1), np.int64)
    for j in range(1, size + 1):
        options = []
        for length in range(1, min(j, len(found)) + 1):
            ids = found[length - 1][:, j - length]
            gain = np.where(ids >= 0, scores[ids], unknown if length == 1 else -np.inf)
            options.append(best[:, j - length] + gain)
        options = np.stack(options, 1)
        pick = options.argmax(1)
        best[:, j] = options[np.arange(n), pick]
        back[:, j] = j - 1 - pick
    return back


def viterbi_long(size: int, found: list[np.ndarray], scores: np.ndarray, unknown: float) -> np.ndarray:
    """viterbi for one long word: one arc after the other, by their ends, instead of a step over lengths for each position."""
    start, length, gain = [np.flatnonzero(found[0][0] < 0)], [], []
    length.append(np.ones(len(start[0]), np.int64))
    gain.append(np.full(len(start[0]), unknown))
    for n, ids in enumerate(found, 1):
        at = np.flatnonzero(ids[0] >= 0)
        start.append(at)
        length.append(np.full(len(at), n))
        gain.append(scores[ids[0, at]])
    begin, size_of, weight = (np.concatenate(x) for x in (start, length, gain))
    order = np.lexsort((size_of, begin + size_of))
    best, back = [0.0] + [-np.inf] * size, np.zeros((1, size + 1), np.int64)
    for a, b, w in zip(begin[order].tolist(), (begin + size_of)[order].tolist(), weight[order].tolist(), strict=True):
        if best[a] + w > best[b]:
            best[b] = best[a] + w
            back[0, b] = a
    return back


def merge_pairs(found: list[np.ndarray], scores: np.ndarray) -> np.ndarray:
    """The same table for a BPE model: each word joins its best-scored pair, the leftmost of equals, until none is a
    piece."""
    n, size = found[0].shape
    longest, none = len(found), np.append(scores, -np.inf)  # id -1 has no score
    piece = np.full((longest + 1, n, size), -1, np.int32)  # id by length, word and start
    for length, ids in enumerate(found, 1):
        piece[length, :, : ids.shape[1]] = ids
    stop = np.tile(np.minimum(np.arange(1, size + 2), size), (n, 1))  # end of the symbol that starts here
    before = np.tile(np.arange(-1, size), (n, 1))  # start of the symbol before it
    start = np.ones((n, size + 1), bool)
    start[:, size] = False
    gain = none[piece[2]] if longest > 1 else np.full((n, size), -np.inf)  # of joining the symbol that starts here to the next

    def joined(w, i, end):
        length = end - i
        return np.where(length <= longest, none[piece[np.minimum(length, longest), w, i]], -np.inf)

    # The rows of gain are the words that still have a pair; a merge changes that pair and the one before it.
    live = np.arange(n)
    while len(live) and size > 1:
        pick = gain.argmax(1)
        on = gain[np.arange(len(live)), pick] > -np.inf
        if not on.all():
            live, gain, pick = live[on], gain[on], pick[on]
        row = np.arange(len(live))
        gone = stop[live, pick]
        end = stop[live, gone]
        start[live, gone] = False
        gain[row, gone] = -np.inf
        stop[live, pick], before[live, end] = end, pick
        gain[row, pick] = np.where(end < size, joined(live, pick, stop[live, end]), -np.inf)
        left = before[live, pick]
        has = left >= 0
        gain[row[has], left[has]] = joined(live[has], left[has], end[has])
    back = np.zeros((n, size + 1), np.int64)
    w, i = np.nonzero(start)
    back[w, stop[w, i]] = i
    return back


def merge_long(size: int, ids: list[np.ndarray], scores: np.ndarray) -> np.ndarray:
    """merge_pairs for one long word, by a queue of pairs instead of a step over the word for each merge."""
    after, before, stop = list(range(1, size + 1)), list(range(-1, size - 1)), list(range(1, size + 1))

    def pair(i):
        k = after[i]
        if k < size:
            length = stop[k] - i
            if length <= len(ids) and ids[length - 1][0, i] >= 0:
                heapq.heappush(queue, (-scores[ids[length - 1][0, i]], i, k, stop[k]))

    queue: list[tuple] = []
    for i in range(size):
        pair(i)
    gone = [False] * size
    while queue:
        _, i, k, end = heapq.heappop(queue)
        if gone[i] or gone[k] or after[i] != k or stop[k] != end:
            continue
        gone[k], stop[i], after[i] = True, end, after[k]
        if after[k] < size:
            before[after[k]] = i
        pair(i)
        if before[i] >= 0:
            pair(before[i])
    back = np.zeros((1, size + 1), np.int64)
    for i in range(size):
        if not gone[i]:
            back[0, stop[i]] = i
    return back


def walked(back: np.ndarray, found: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The paths of all words, walked back at once: (word, start, id or -1) of each last piece, then of those before."""
    n, size = back.shape[0], back.shape[1] - 1
    at, rows, steps = np.full(n, size), np.arange(n), []
    while len(rows):
        start = back[rows, at[rows]]
        length = at[rows] - start
        ids = np.full(len(rows), -1, np.int32)
        for s in np.unique(length):
            own = length == s
            ids[own] = found[s - 1][rows[own], start[own]]
        steps.append((rows, start, ids))
        at[rows] = start
        rows = rows[start > 0]
    return steps


def cuts_of(back: np.ndarray, everywhere: bool) -> np.ndarray:
    """Where the pieces of every word start: (words, L). everywhere: whether back is filled at positions off the path."""
    n, size = back.shape[0], back.shape[1] - 1
    cuts = np.zeros((n, size), bool)
    if not everywhere:
        np.put_along_axis(cuts, back, True, 1)  # 0, which every path has, where no piece ends
        return cuts
    rows, at = np.arange(n), np.full(n, size)
    while len(rows):
        at = back[rows, at]
        cuts[rows, at] = True
        on = at > 0
        rows, at = rows[on], at[on]
    return cuts


class Segmenter:
    """Ids of units (words with the space marks before them)."""

    def __init__(self, vocabulary: Vocabulary, best: bool = True):
        """best: whether the Viterbi paths are wanted where they aren't the segmentation."""
        self.table, self.v = PieceTable(vocabulary), vocabulary
        self.scores, self.best = np.array(vocabulary.scores), best
        self.unknown = float(min(self.scores[list(vocabulary.normal)], default=0.0)) - 10.0
        longer = {c for p, n in zip(vocabulary.pieces, vocabulary.normal, strict=True) if n and len(p) > 1 for c in p}
        if any(n and SPACE in p.lstrip(SPACE) for p, n in zip(vocabulary.pieces, vocabulary.normal, strict=True)):
            raise ValueError("a piece has a space inside; texts can't be cut at spaces")
        # No merge crosses a character that is in no longer piece.
        alone = "" if "\n" in longer or "\n" in vocabulary.pieces else "\n"
        self.units = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + ("|\n+" if alone else ""))
        self.known: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.known.clear()
        self.flat, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: Of each unit: pieces of its Viterbi path, and whether that is its segmentation.
        self.n_best, self.same = np.zeros(0, np.int64), np.zeros(0, bool)

    def _segment(self, words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        flat, size, n_best, same = self._segments(words)
        return np.split(flat, np.cumsum(size)[:-1]), n_best, same

    def _segments(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in a row and how many each has; pieces of each Viterbi path, and whether it is the same."""
        size, n_best, same = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.ones(len(words), bool)
        order, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for index in by_length(words):
            length = len(words[index[0]])
            points = code_points([words[i] for i in index], length)
            for lo, hi in [(0, len(index))] if length <= LONG else [(i, i + 1) for i in range(len(index))]:
                own = np.array(index[lo:hi])
                found = self.table.substrings(points[lo:hi])
                if self.best or self.v.kind != BPE:
                    cuts = best = cuts_of(viterbi(found, self.scores, self.unknown) if length <= LONG else viterbi_long(length, found, self.scores, self.unknown), True)
                    n_best[own] = self._count(best, found, words, own)
                if self.v.kind == BPE:
                    cuts = cuts_of(merge_pairs(found, self.scores) if length <= LONG else merge_long(length, found, self.scores), False)
                    if self.best:
                        same[own] = (best == cuts).all(1)
                flat, size[own] = self._ids(cuts, found, words, own)
                order.append(own)
                parts.append(flat)
        # From the order of the lengths to that of the words.
        order, flat = np.concatenate(order), np.concatenate(parts)
        begin = np.zeros(len(words), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        ends = np.cumsum(size)
        return flat[np.repeat(begin - (ends - size), size) + np.arange(len(flat))], size, n_best, same

    def _ids(self, cuts: np.ndarray, found: list[np.ndarray], words: list[str], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of all words in a row, bytes for characters without one, and how many each word has."""
        row, start = np.nonzero(cuts)
        length = np.where(np.r_[row[1:] != row[:-1], True], cuts.shape[1], np.r_[start[1:], 0]) - start
        ids = np.full(len(row), -1, np.int32)
        for s, at in enumerate(found, 1):
            of = np.flatnonzero(length == s)
            ids[of] = at[row[of], start[of]]
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, np.bincount(row, minlength=len(cuts))
        spelled = [self._bytes(words[own[r]][s]) for r, s in zip(row[odd].tolist(), start[odd].tolist(), strict=True)]
        n = np.ones(len(ids), np.int64)
        n[odd] = [len(x) for x in spelled]
        flat = np.repeat(ids, n)
        flat[np.repeat(ids < 0, n)] = np.concatenate(spelled)
        return flat, np.bincount(row, n, len(cuts)).astype(np.int64)

    def _count(self, cuts: np.ndarray, found: list[np.ndarray], words: list[str], own: np.ndarray) -> np.ndarray:
        n = cuts.sum(1)
        alone = cuts & (found[0] < 0)
        if alone.any():
            alone[:, :-1] &= cuts[:, 1:]
            for r, s in zip(*(x.tolist() for x in np.nonzero(alone)), strict=True):
                n[r] += len(self._bytes(words[own[r]][s])) - 1
        return n

    def _bytes(self, char: str) -> list[int]:
        ids = [self.v.byte_ids[b] for b in char.encode()]
        return ids if min(ids) >= 0 else [self.v.unknown]

    def _slots(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The remembered units of all texts in a row, and how many each text has."""
        split = [self.units.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self._reset()
        new = list(set().union(*split).difference(self.known))
        if new:
            flat, size, n_best, same = self._segments(new)
            begin = len(self.flat) + np.cumsum(size) - size
            self.known.update(zip(new, range(len(self.begin), len(self.begin) + len(new)), strict=True))
            self.flat, self.begin, self.size = np.r_[self.flat, flat], np.r_[self.begin, begin], np.r_[self.size, size]
            self.n_best, self.same = np.r_[self.n_best, n_best], np.r_[self.same, same]
        n = np.array([len(u) for u in split], np.int64)
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum())), n

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of the texts in them; then of each text the pieces of its Viterbi
        path, and whether that is its segmentation."""
        slot, units = self._slots(texts)
        size = self.size[slot]
        ends = np.r_[0, np.cumsum(size)]
        flat = self.flat[np.repeat(self.begin[slot] - ends[:-1], size) + np.arange(ends[-1])]
        of = np.repeat(np.arange(len(units)), units)
        return flat, ends[np.r_[0, np.cumsum(units)]], np.bincount(of, self.n_best[slot], len(units)).astype(np.int64), np.bincount(of, ~self.same[slot], len(units)) == 0


_segmenters: dict[int, Segmenter] = {}


def _segmenter(shared, best: bool) -> Segmenter:
    """One per worker process and vocabulary, as it remembers the units of earlier tasks."""
    v = shared.value
    key = hash((*v.pieces, *v.scores, v.kind, best))
    if key not in _segmenters:
        _segmenters[key] = Segmenter(v, best)
    return _segmenters[key]


def _appended(batch: pa.RecordBatch, lo: int, n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """n rows of the batch from lo on, with these columns instead of any of their names."""
    kept = [i for i, name in enumerate(batch.schema.names) if name not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, n) for i in kept), *columns.values()], [*(batch.schema.names[i] for i in kept), *columns])


def _pieces_of(sizes: Iterator[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes sum to about `most`, one row at least."""
    lo, total, hi = 0, 0, 0
    for hi, size in enumerate(sizes, 1):
        total += size
        if total >= most:
            yield lo, hi
            lo, total = hi, 0
    if lo < hi:
        yield lo, hi


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", into: str = "pieces", check: str | None = None, best: tuple[str, str] | None = None) -> DataFrame:
    """docs with the column `into`: the ids of its text, as array<int>. check: also a boolean column of this name,
    whether the ids decode to the text, found in the same pass. best: also columns of these names, the number of pieces
    of the Viterbi path (long) and whether that is the segmentation (boolean)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = _segmenter(shared, best is not None)
        decoder = Decoder(shared.value) if check else None
        for batch in batches:
            for lo, hi in _pieces_of((len(t.as_py() or "") for t in batch.column(where)), 1 << 20):
                texts = batch.column(where).slice(lo, hi - lo).to_pylist()
                flat, ends, n_best, same = segmenter.encode(texts)
                added = {into: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))}
                if best:
                    added |= {best[0]: pa.array(n_best), best[1]: pa.array(same)}
                if check:
                    back = decoder.decode([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
                    added[check] = pa.array([d == (t or "").replace(SPACE, " ") for d, t in zip(back, texts, strict=True)])
                yield _appended(batch, lo, hi - lo, added)

    out = T.StructType([f for f in docs.schema if f.name not in (into, check, *(best or ()))]).add(into, T.ArrayType(T.IntegerType()))
    out = out.add(best[0], "long").add(best[1], "boolean") if best else out
    return docs.mapInArrow(run, out.add(check, "boolean") if check else out)


class Decoder:
    """Bytes of every id in one array, gathered for a whole batch at once."""

    def __init__(self, v: Vocabulary):
        byte = {i: bytes([b]) for b, i in enumerate(v.byte_ids) if i >= 0}
        each = [byte[i] if i in byte else p.replace(SPACE, " ").encode() if n else b"" for i, (p, n) in enumerate(zip(v.pieces, v.normal, strict=True))]
        each[v.unknown] = " ⁇ ".encode()
        each.append("�".encode())
        self.size = np.array([len(x) for x in each])
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(each), np.uint8)

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        count = [len(x) for x in ids]
        flat = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)
        flat = np.where((flat >= 0) & (flat < len(self.size) - 1), flat, len(self.size) - 1)
        size = self.size[flat]
        ends = np.r_[0, np.cumsum(size)]
        data = self.data[np.repeat(self.begin[flat] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        cut = ends[np.r_[0, np.cumsum(count)].astype(np.int64)].tolist()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return [t[1:] if t.startswith(" ") else t for t in texts]


def decode(encoded: DataFrame, vocabulary: Vocabulary, pieces: str = "pieces", into: str = "decoded") -> DataFrame:
    """encoded with the column `into`: the text of the ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    where = encoded.columns.index(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            ids = batch.column(where)
            for lo, hi in _pieces_of((len(x.values) if x.is_valid else 0 for x in ids), 1 << 19):
                each = [np.asarray(x.values) if x.is_valid else np.zeros(0, np.int64) for x in ids.slice(lo, hi - lo)]
                yield _appended(batch, lo, hi - lo, {into: pa.array(decoder.decode(each), pa.string())})

    return encoded.mapInArrow(run, T.StructType([f for f in encoded.schema if f.name != into]).add(into, "string"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, whether they decode to its text, and how its Viterbi path compares."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode(docs, read_vocabulary(), check="round_trip", best=("n_viterbi", "viterbi_agrees"))
    return encoded.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces", "round_trip", "n_viterbi", "viterbi_agrees")


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
ORACLE: dict[str, str] = {}
