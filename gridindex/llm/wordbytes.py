"""Words of whole texts as 64-bit hashes, computed for many texts at once with numpy on the Arrow buffers.

A word is a maximal run of bytes of one class; A-Z count as a-z. Every class used here separates at ASCII bytes only,
so working on UTF-8 bytes gives the same words as working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that are not white space: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Letters, digits and everything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BACK = pow(_STEP, -1, 1 << 64)
_CHUNK = 1 << 17


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_STEP, _CHUNK + 1), _powers(_BACK, _CHUNK + 1)


_WIDE = np.arange(1, 257, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """The words of the texts lo..hi-1: first[i]:first[i+1] are those of text lo+i; start and end are byte offsets, total and down what hashes of other stretches come from."""

    lo: int
    hi: int
    first: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    total: np.ndarray
    down: np.ndarray

    def prefix(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Words longer than length bytes, and the hash of that many first bytes of each."""
        at = np.flatnonzero(self.end - self.start > length)
        start = self.start[at]
        return at, mix((self.total[start + length] - self.total[start]) * self.down[start])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and bytes of a string column; a null is an empty text."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    return offsets.astype(np.int64), np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)


def words(column: pa.Array, table: np.ndarray = NOT_SPACE) -> Iterator[Words]:
    """Word hashes of each text, about 128 KB of texts at a time (a longer text comes alone, whole)."""
    if not len(column):
        return
    offsets, body = utf8(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _CHUNK, side="right")) - 1)
        bounds = offsets[lo : hi + 1] - offsets[lo]
        data = LOWER[body[offsets[lo] : offsets[hi]]]
        n = len(data)
        inside = table[data]
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[1:], before[0] = inside[:-1], False
            after[:-1], after[-1] = inside[1:], False
            cuts = bounds[1:-1]
            before[cuts[cuts < n]] = False
            after[cuts[cuts > 0] - 1] = False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        up, down = (_UP, _DOWN) if n <= _CHUNK else (_powers(_STEP, n + 1), _powers(_BACK, n + 1))
        total = np.zeros(n + 1, np.uint64)
        wide = _WIDE[data]
        np.multiply(wide, up[:n], out=wide)
        np.cumsum(wide, out=total[1:])
        yield Words(lo, hi, np.searchsorted(start, bounds), mix((total[end] - total[start]) * down[start]), start, end, total, down)
        lo = hi


def hash_word(word: str) -> int:
    """The hash that words() gives this word (already lower-cased)."""
    return int(next(words(pa.array([word]), np.ones(256, bool))).hash[0])
