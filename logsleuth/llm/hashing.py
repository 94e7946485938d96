"""Vectorised words and word sequences for the operators that run in Python tasks.

``Words`` cuts the UTF-8 buffer of an Arrow text column into words (runs of
bytes other than the six ASCII blanks) and hashes each to 64 bits without
making a Python object for it.  The hash is a polynomial over per-byte random
numbers modulo 2^64, taken from prefix sums, mixed with the word's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = 0xD1342543DE82EF97  # odd and 3 modulo 4, so that 1 - base has one factor 2
_STEP = 1 << 18  # bytes hashed at a time

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240607).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the base and of its inverse, as many as asked for so far."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, _STEP)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class Words:
    """The words of a list of texts: ``hash``, byte ``start`` and ``end`` of
    each in ``data``, and ``first``: text i has the words first[i]:first[i+1]."""

    def __init__(self, column: pa.Array, fold: bool = True):
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] \
            if len(column) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.empty(0, np.uint8)
        at = at - at[0]
        table = _FOLDED if fold else _BYTE
        border = np.zeros(len(self.data) + 1, bool)
        border[at] = True
        starts, ends, hashes = [], [], []
        lo = 0
        while lo < len(self.data):
            hi = self._cut(lo, border)
            s, e, h = _hash_words(self.data[lo:hi], border[lo:hi], table)
            starts.append(s + lo)
            ends.append(e + lo)
            hashes.append(h)
            lo = hi
        self.start = np.concatenate(starts) if starts else np.empty(0, np.int64)
        self.end = np.concatenate(ends) if ends else np.empty(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.first = np.searchsorted(self.start, at)

    def _cut(self, lo: int, border: np.ndarray) -> int:
        """End of a step that does not cut a word (a blank or the start of a text)."""
        hi, size = lo + _STEP, _STEP
        while hi < len(self.data):
            free = np.flatnonzero(_BLANK[self.data[hi:hi + size]] | border[hi:min(hi + size, len(self.data))])
            if len(free):
                return hi + int(free[0])
            hi += size
        return len(self.data)

    def __len__(self) -> int:
        return len(self.first) - 1

    def of(self, i: int) -> slice:
        return slice(int(self.first[i]), int(self.first[i + 1]))


def _hash_words(data: np.ndarray, border: np.ndarray, table: np.ndarray):
    solid = ~_BLANK[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | border))
    ends = np.empty(len(data), bool)  # the last byte of a word
    ends[-1] = True
    ends[:-1] = ~solid[1:] | border[1:]
    end = np.flatnonzero(solid & ends) + 1
    up, down = _POWERS.of(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(table[data] * up, out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    return start, end, mix(h ^ ((end - start).astype(np.uint64) * _ODD))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every run of ``n`` word hashes; position i is h[i:i+n].

    Built by doubling: the hash of a run is mixed from those of two shorter
    runs, so a window costs O(log n) array operations."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    if n == 1:
        return mix(h)
    a = n // 2
    left = windows(h, a)
    right = left if n - a == a else windows(h, n - a)
    size = len(h) - n + 1
    return mix(left[:size] * _ODD + right[a:a + size])


def inside(words: Words, n: int) -> np.ndarray:
    """Positions i of the words at which a run of ``n`` words of one text begins."""
    size = np.diff(words.first)
    ok = np.ones(len(words.hash), bool)
    for i in np.flatnonzero(size):
        ok[max(words.first[i], words.first[i + 1] - n + 1):words.first[i + 1]] = False
    return np.flatnonzero(ok)


def slices(column: pa.Array, limit: int) -> Iterator[tuple[int, pa.Array]]:
    """(offset, part): consecutive parts of a text column with about ``limit`` bytes each."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    lo, total = 0, 0
    for i, n in enumerate(size):
        total += n
        if total >= limit:
            yield lo, column[lo:i + 1]
            lo, total = i + 1, 0
    if lo < len(column):
        yield lo, column[lo:]
