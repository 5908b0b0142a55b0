"""Words of Arrow text columns as NumPy arrays: spans and 64-bit hashes.

Works on the UTF-8 buffers, so no Python string is made for a word.  Memory is
bounded by ``CHUNK`` bytes of text or one text, whichever is larger; hashing goes
in blocks of ``CHUNK`` bytes also inside one long text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public domain constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK + 4096
    while size < n:
        size *= 2
    if size not in _POWERS:
        out = []
        for b in (_BASE, _INV):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if size > CHUNK + 4096:
            return out[0], out[1]
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


def _table(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)])


LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
#: After lower-casing A-Z: letters, digits and everything beyond ASCII.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Anything but the space and the controls 9 to 13.
SOLID = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))


def span_hashes(values, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; ``values(lo, hi)`` gives a 64-bit number for each position.  Spans are sorted and disjoint."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(out):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + CHUNK, "right")))
        v = values(base, end[j - 1])
        power, inverse = _powers(len(v) + 1)
        total = np.zeros(len(v) + 1, dtype=np.uint64)
        np.cumsum(v * power[: len(v)], out=total[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = _mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        i = j
    return out


@dataclass
class Words:
    """Words of the rows ``first`` to ``first + rows`` of a batch.

    ``start`` and ``end`` are byte positions in ``data``; row i has the words
    ``at[i]`` to ``at[i + 1]`` and the bytes ``offsets[i]`` to ``offsets[i + 1]``.
    """

    first: int
    rows: int
    data: np.ndarray
    lower: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray

    def hashes(self) -> np.ndarray:
        return span_hashes(lambda lo, hi: _BYTE[self.lower[lo:hi]], self.start, self.end)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.at))

    def word(self, i: int) -> bytes:
        return self.lower[self.start[i] : self.end[i]].tobytes()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def row_groups(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Consecutive rows of at most ``limit`` bytes together, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, min(n, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j
        i = j


def words(texts: pa.Array, solid: np.ndarray, fold: bool = True) -> Iterator[Words]:
    """``solid`` says which bytes belong to a word, after lower-casing A-Z unless ``fold`` is false."""
    raw, offsets = buffers(texts)
    for i, j in row_groups(offsets):
        lo, hi = offsets[i], offsets[j]
        data = raw[lo:hi]
        lower, rel = LOWER[data] if fold else data, offsets[i : j + 1] - lo
        inside = solid[lower]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[rel] = True
        before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
        after = np.concatenate((inside[1:], [False])) if len(inside) else inside
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        yield Words(i, j - i, data, lower, rel, start, end, np.searchsorted(start, rel))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes (runs may cross rows)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        acc *= np.uint64(0xD1342543DE82EF95)
        acc += h[j : j + n]
    return _mix(acc)
