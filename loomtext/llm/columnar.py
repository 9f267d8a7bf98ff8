"""Words, their hashes and n-grams of whole Arrow string columns, in numpy.

A word is a maximal run of letters, digits and marks after lower-casing.
Null texts have no words. Nothing here loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_WORD[0x80:] = True
#: First bytes under which UTF-8 has punctuation, symbols or spaces besides letters.
_SUSPECT = np.zeros(256, bool)
_SUSPECT[[0xC2, 0xC3, 0xE2, 0xE3, 0xEF, 0xF0]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        t = np.full(max(n, 64, 2 * len(_powers)), _BASE, np.uint64)
        t[0] = 1
        _powers = np.multiply.accumulate(t)
    return _powers


@dataclass
class Words:
    """hash, start and end (byte positions in data) of each word; first[d] : first[d + 1] are the words of row d."""

    data: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array and its offsets, from 0."""
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def row_slices(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts take about max_bytes together; a longer text is a range of its own."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64) + 16)
    at, n = 0, len(column)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield at, to
        at = to


def words(column: pa.Array | pa.ChunkedArray) -> Words:
    """Words of every row, hashed to 64 bits."""
    col = pc.utf8_lower(strings(column))
    data, offsets = raw(col)
    if len(data) and _SUSPECT[data].any():
        col = pc.replace_substring_regex(col, r"[^\p{L}\p{N}\p{M}\x00-\x7f]+", " ")
        data, offsets = raw(col)
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(data, np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64))
    is_word = _WORD[data]
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = is_word
    cuts = offsets[offsets < n]
    before[cuts] = False  # a row's first byte has nothing before it
    start = np.flatnonzero(is_word & ~before[:-1])
    after = np.empty(n, bool)
    after[:-1] = is_word[1:]
    after[-1] = False
    after[cuts[cuts > 0] - 1] = False
    end = np.flatnonzero(is_word & ~after) + 1
    lens = end - start
    if not len(lens):
        return Words(data, np.zeros(0, np.uint64), start, end, np.zeros(len(offsets), np.int64))
    at = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=at[1:])
    position = np.arange(at[-1] + lens[-1]) - np.repeat(at, lens)
    values = (data[is_word].astype(np.uint64) + np.uint64(1)) * _power_table(int(lens.max()))[position]
    h = mix(np.add.reduceat(values, at) + lens.astype(np.uint64))
    return Words(data, h, start, end, np.searchsorted(start, offsets, "left"))


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words and the index of each one's first word; none cross rows."""
    m = len(w.hash)
    if m < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = w.hash[: m - n + 1].copy()
    for k in range(1, n):
        g = mix(g * _BASE + w.hash[k : m - n + 1 + k])
    inside = np.ones(m - n + 1, bool)
    for k in range(1, n):
        late = w.first[1:-1] - k
        inside[late[(late >= 0) & (late <= m - n)]] = False
    at = np.flatnonzero(inside)
    return g[at], at
