"""Words of Arrow text columns as numpy arrays, without a Python string per word.

Texts are taken in slices of about a megabyte, whole texts each, so that memory stays bounded by the slice or the
longest text. Words are hashed by differences of one running polynomial sum over the slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


class Words(NamedTuple):
    """The words of a slice: byte positions, the row within the slice, the hash, and hashes of leading bytes (0 for
    words that aren't longer)."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    prefixes: list[np.ndarray]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A pseudo-random value for each byte.
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_power = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64."""
    if len(_power[0]) <= n:
        size = max(n + 1, SLICE_BYTES + (1 << 18))
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _power[i] = np.cumprod(p, dtype=np.uint64)
    return _power


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES, max_rows: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them); null texts are empty, no text is split."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        hi = min(hi, lo + max_rows) if max_rows else hi
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE, prefixes: tuple[int, ...] = ()) -> Words:
    """Words are runs of bytes that aren't in `space`; A-Z count as a-z. Rows never share a word."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64), [np.zeros(0, np.uint64) for _ in prefixes])
    inside = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUE[LOWERED[data]] * power[:n], out=sums[1:])
    h = mix64((sums[end] - sums[start]) * inverse[start])
    leading = []
    for k in prefixes:
        long = np.flatnonzero(end - start > k)
        part = np.zeros(len(start), np.uint64)
        part[long] = mix64((sums[start[long] + k] - sums[start[long]]) * inverse[start[long]] + np.uint64(k))
        leading.append(part)
    return Words(start, end, np.searchsorted(offsets, start, "right") - 1, h, leading)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles, by row and hash; rows with fewer words have one for them all."""
    if not len(w.hash):
        return w.row, w.hash
    one, salt = np.uint64(0xD6E8FEB86659FD93), np.uint64(k)
    n = len(w.hash)
    parts = []
    if n >= k:
        whole = w.row[: n - k + 1] == w.row[k - 1 :]
        h = np.full(n - k + 1, salt)
        for i in range(k):
            h = mix64(h * one + w.hash[i : n - k + 1 + i])
        parts.append((w.row[: n - k + 1][whole], h[whole]))
    begin = np.flatnonzero(np.r_[True, w.row[1:] != w.row[:-1]])
    count = np.diff(np.r_[begin, n])
    for length in range(1, k):
        at = begin[count == length]
        h = np.full(len(at), np.uint64(length))
        for i in range(length):
            h = mix64(h * one + w.hash[at + i])
        parts.append((w.row[at], h))
    row, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(row) else np.zeros(0, bool)
    return row[new], h[new]
