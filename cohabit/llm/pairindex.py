"""Byte-pair merging of many words at once over a pair occurrence index.

Every mergeable pair maps to all its positions in the words at hand.  Ranks that have positions are applied in ascending
order; each application joins all positions of its pairs and updates the lists of the pairs that it
breaks or makes.  Words don't touch, so each of them sees its own merges in the order of their ranks, leftmost
first, as if it were alone.

A vocabulary may hold pairs that do not rank after a pair that made one of their sides (pieces chosen by score).  Such ranks
are not ``safe``: their positions are joined one by one, and what then ranks before the next one comes in between.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

#: Up to so many positions are joined one by one; more are joined as arrays.
FEW = 24


@dataclass(frozen=True)
class Merges:
    """Mergeable pairs by key (left << 32 | right), their ranks, the symbols they make, and which ranks are safe."""

    keys: np.ndarray
    rank: np.ndarray
    made: np.ndarray
    safe: np.ndarray

    @staticmethod
    def build(pairs: Iterable[tuple[int, int, int, int]]) -> Merges:
        """From (left, right, rank, made); symbols and ranks are not negative."""
        left, right, rank, made = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        order = np.argsort(keys)
        lowest = np.full(max(left.max(), right.max(), made.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, left, rank)
        np.minimum.at(lowest, right, rank)
        safe = np.ones(rank.max() + 1, dtype=bool)
        safe[rank[lowest[made] <= rank]] = False
        return Merges(keys[order], rank[order].astype(np.int32), made[order].astype(np.int32), safe)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pair each is, or -1."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, k, -1).astype(np.int32)


class PairIndex:
    """Merges the words of one task; holds the tables that single steps look up."""

    def __init__(self, merges: Merges) -> None:
        self.m = merges
        self.pair = dict(zip(merges.keys.tolist(), range(len(merges.keys)), strict=True))
        self.rank, self.made, self.safe = merges.rank.tolist(), merges.made.tolist(), merges.safe.tolist()

    def merge(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word i holds the symbols at[i] to at[i + 1].  Gives the symbols left, and the places where they began."""
        n = len(symbols)
        # the place after the last stands for "none"
        self.sym = np.append(symbols, 0).astype(np.int64)
        self.next, self.prev = np.arange(1, n + 2), np.arange(-1, n)
        inside = at[1:] > at[:-1]
        self.next[at[1:][inside] - 1] = n
        self.prev[at[:-1][inside]] = n
        self.next[n] = n
        self.cur = np.full(n + 1, -1, dtype=np.int32)  # the pair that begins at a place
        self.gone = np.zeros(n + 1, dtype=bool)
        self.index: dict[int, list] = {}
        self.heap: list[int] = []
        p = np.flatnonzero(self.next[:n] < n)
        self._seen(p)
        views = [memoryview(x) for x in (self.sym, self.next, self.prev, self.cur, self.gone)]
        while self.heap:
            r = heapq.heappop(self.heap)
            places = self.index.pop(r)
            if self.safe[r] and sum(1 if isinstance(x, int) else len(x) for x in places) > FEW:
                self._join_all(r, np.unique(np.concatenate([np.atleast_1d(x) for x in places])))
            else:
                flat = [y for x in places for y in ((x,) if isinstance(x, int) else x.tolist())]
                self._join_each(r, sorted(set(flat)), *views)
        del views
        keep = np.flatnonzero(~self.gone[:n])
        return self.sym[keep], keep

    def _seen(self, p: np.ndarray) -> None:
        """Looks up the pairs at these places and files the places under their ranks."""
        k = self.m.find(self.sym[p], self.sym[self.next[p]])
        self.cur[p] = k
        p, r = p[k >= 0], self.m.rank[k[k >= 0]]
        if not len(p):
            return
        order = np.argsort(r, kind="stable")
        p, r = p[order], r[order]
        first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        for a, b, rank in zip(first.tolist(), [*first[1:].tolist(), len(p)], r[first].tolist(), strict=True):
            self._file(rank, p[a:b] if b - a > FEW else p[a:b].tolist())

    def _file(self, rank: int, places: np.ndarray | list[int]) -> None:
        if rank not in self.index:
            self.index[rank] = []
            heapq.heappush(self.heap, rank)
        if isinstance(places, list):
            self.index[rank] += places
        else:
            self.index[rank].append(places)

    def _join_all(self, r: int, p: np.ndarray) -> None:
        k = self.cur[p]
        p = p[(k >= 0) & (self.m.rank[k] == r)]
        if len(p) > 1:  # of pairs that overlap in a row, every second one
            begins = np.concatenate(([True], self.next[p[:-1]] != p[1:]))
            at = np.arange(len(p))
            p = p[(at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0]
        if not len(p):
            return
        n, gone = len(self.sym) - 1, self.next[p]
        self.sym[p] = self.m.made[self.cur[p]]
        after = self.next[gone]
        self.cur[gone], self.gone[gone], self.cur[p] = -1, True, -1
        self.next[p], self.prev[after] = after, p
        before = self.prev[p]
        touched = np.concatenate((before[before < n], p[after < n]))
        self._seen(np.unique(touched))

    def _join_each(self, r: int, places: list[int], sym, nxt, prv, cur, gone) -> None:
        n, rank, made, pair = len(sym) - 1, self.rank, self.made, self.pair
        todo = [(r, p) for p in places]
        while todo:
            want, p = heapq.heappop(todo)
            k = cur[p]
            if k < 0 or rank[k] != want:
                continue
            d = nxt[p]
            after, before = nxt[d], prv[p]
            sym[p] = made[k]
            cur[d], gone[d], cur[p] = -1, True, -1
            nxt[p], prv[after] = after, p
            for a, b in ((before, p), (p, after)):
                if a < n and b < n:
                    k = pair.get(sym[a] << 32 | sym[b], -1)
                    cur[a] = k
                    if k >= 0:
                        if rank[k] <= r:
                            heapq.heappush(todo, (rank[k], a))
                        else:
                            self._file(rank[k], [a])
