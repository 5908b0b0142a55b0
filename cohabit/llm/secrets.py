"""Secret scans (operator 8): patterns, and automata inferred from labelled credentials.

Credentials that the three base patterns find are labelled by their pattern.  For each
label a prefix tree of character classes is built and statistically compatible states are
merged (ALERGIA: Carrasco and Oncina 1994; equal depths first), which gives a probabilistic automaton of the
format, its length included.  Every token of eight characters or more, or what base spans leave of it, is then scored by its
log-likelihood ratio against a class-bigram model of all of these in the corpus: bits per character, less the bits that
an unlikely end and steps that the automaton has never seen cost, which are not shared among the characters: a token ends
once, at a length that fits the format or doesn't.
Tokens that reach ``min_bits`` become spans of kind ``grammar``.

The automata are fitted on at most ``max_values`` distinct credentials per label (those with
the smallest hash) of at most ``max_length`` characters; the background counts cover every document.  Scanning is one map over
whole texts.

Defined results: null and empty texts hold no spans; a corpus without credentials gives no
automata and so base spans only; repeated rows get the same spans; ties in position are
ordered assign, access, hex, grammar.  Added columns replace input columns of the same name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import words
from .common import free_name, mapped, without, written

KINDS = ("assign", "access", "hex", "grammar")
# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32

_SYMBOLS = "+/_.=-"
_GROUPS = ("abcdef", "ABCDEF", "ghijklmnopqrstuvwxyz", "GHIJKLMNOPQRSTUVWXYZ", "0123456789", *_SYMBOLS)
N_CLASS = len(_GROUPS)
_CLASS = np.full(256, N_CLASS, dtype=np.int64)
for _k, _g in enumerate(_GROUPS):
    _CLASS[[ord(c) for c in _g]] = _k
_TOKEN = _CLASS < N_CLASS
_HEX = np.array([chr(b) in "0123456789abcdef" for b in range(256)])
_CAPS = np.array([chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" for b in range(256)])
_SEPARATOR = np.array([chr(b) in ":=" for b in range(256)])


@dataclass
class Automaton:
    """Next state by (state, class), log2 probability by (state, class or end), and which steps were ever seen."""

    label: str
    step: np.ndarray
    bits: np.ndarray
    seen: np.ndarray


@dataclass
class SecretModel:
    automata: list[Automaton] = field(default_factory=list)
    background: np.ndarray = field(default_factory=lambda: np.zeros((N_CLASS + 1, N_CLASS + 1)))
    min_length: int = ASSIGN_VALUE
    min_bits: float = 1.0


class _States:
    """States of a prefix tree that can be merged: counts of visits, ends and steps, and where steps lead."""

    def __init__(self, values: list[str], alpha: float) -> None:
        self.child: list[dict[int, int]] = [{}]
        self.seen, self.ends, self.depth = [0], [0], [0]
        for value in sorted(values):
            q = 0
            self.seen[0] += 1
            for c in _CLASS[np.frombuffer(value.encode(), np.uint8)].tolist():
                if c not in self.child[q]:
                    self.child[q][c] = len(self.child)
                    self.child.append({})
                    self.seen.append(0)
                    self.ends.append(0)
                    self.depth.append(self.depth[q] + 1)
                q = self.child[q][c]
                self.seen[q] += 1
            self.ends[q] += 1
        self.taken = [{c: self.seen[k] for c, k in kids.items()} for kids in self.child]
        self.into = list(range(len(self.child)))
        self.spread = math.sqrt(0.5 * math.log(2 / alpha))

    def find(self, q: int) -> int:
        while self.into[q] != q:
            self.into[q] = self.into[self.into[q]]
            q = self.into[q]
        return q

    def after(self, q: int) -> list[tuple[int, int]]:
        return [(c, self.find(k)) for c, k in sorted(self.child[q].items())]

    def differ(self, x: int, n: int, y: int, m: int) -> bool:
        """Hoeffding's bound on two shares; few observations differ from nothing."""
        return abs(x / n - y / m) > self.spread * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def alike(self, p: int, q: int) -> bool:
        """Whether both states, and the states that equal steps lead to, end and go on alike."""
        todo, known = [(p, q)], set()
        while todo:
            a, b = (self.find(x) for x in todo.pop())
            if a == b or (a, b) in known:
                continue
            known.add((a, b))
            n, m = self.seen[a], self.seen[b]
            steps = {*self.child[a], *self.child[b]}
            if self.differ(self.ends[a], n, self.ends[b], m) or any(self.differ(self.taken[a].get(c, 0), n, self.taken[b].get(c, 0), m) for c in steps):
                return False
            todo += [(self.child[a][c], self.child[b][c]) for c in steps if c in self.child[a] and c in self.child[b]]
        return True

    def merge(self, p: int, q: int) -> None:
        """q becomes p; so do the states that equal steps lead to, since an automaton has one for each."""
        todo = [(p, q)]
        while todo:
            a, b = (self.find(x) for x in todo.pop())
            if a == b:
                continue
            self.into[b] = a
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for c, k in self.child[b].items():
                self.taken[a][c] = self.taken[a].get(c, 0) + self.taken[b][c]
                if c in self.child[a]:
                    todo.append((self.child[a][c], k))
                else:
                    self.child[a][c] = k


def infer(label: str, values: list[str], alpha: float = 0.01) -> Automaton:
    """State merging by Hoeffding bounds (ALERGIA) over class strings, in two rounds.

    A credential's characters spread over so many prefixes that single states of the tree are seen too rarely to be told apart.
    So states of equal depth are merged first, which adds up their counts; then, with these counts, states of different
    depths.  Two depths stay apart where, some steps on, one ends and the other does not: lengths are learnt.
    """
    t = _States(values, alpha)
    level = [0]
    while level:
        kept: list[int] = []
        for q in sorted({k for p in level for _, k in t.after(t.find(p))}, key=lambda q: (-t.seen[q], q)):
            q = t.find(q)
            if q in kept:
                continue
            twin = next((r for r in kept if t.alike(r, q)), None)
            if twin is None:
                kept.append(q)
            else:
                t.merge(twin, q)
        level = kept
    red = [0]
    while blue := [(-t.seen[k], t.depth[k], k) for p in red for _, k in t.after(p) if k not in red]:
        q = min(blue)[2]
        twin = next((r for r in red if t.alike(r, q)), None)
        if twin is None:
            red.append(q)
        else:
            t.merge(twin, q)
            red = list(dict.fromkeys(map(t.find, red)))
    at = {q: i for i, q in enumerate(red)}
    step, bits, seen = np.zeros((len(red), N_CLASS), np.int64), np.zeros((len(red), N_CLASS + 1)), np.zeros((len(red), N_CLASS), dtype=bool)
    for q, i in at.items():
        total = sum(t.taken[q].values()) + t.ends[q] + 0.1 * (N_CLASS + 1)
        to = dict(t.after(q))
        for c in range(N_CLASS):
            step[i, c], seen[i, c] = (at[to[c]], True) if c in to else (i, False)
            bits[i, c] = math.log2((t.taken[q].get(c, 0) + 0.1) / total)
        bits[i, N_CLASS] = math.log2((t.ends[q] + 0.1) / total)
    return Automaton(label, step, bits, seen)


def _spans(texts: pa.Array, min_length: int) -> Iterator[tuple]:
    """For each chunk: its tokens, the base spans by row, starts, ends and rows of what long tokens hold outside base spans, and ``point``.

    ``point`` gives the code points before each byte of the chunk.
    """
    for tokens, hexes, caps, marks in zip(words(texts, _TOKEN, False), words(texts, _HEX, False), words(texts, _CAPS, False), words(texts, _SEPARATOR, False), strict=True):
        found: list[list[tuple[str, int, int, str]]] = [[] for _ in range(tokens.rows)]
        taken: list[tuple[int, int]] = []
        first = (tokens.data & 0xC0) != 0x80
        point = np.concatenate(([0], np.cumsum(first)))
        base = point[tokens.offsets]

        for r in np.flatnonzero(np.diff(marks.at)).tolist():
            lo, hi = int(tokens.offsets[r]), int(tokens.offsets[r + 1])
            text, at = tokens.data[lo:hi].tobytes().decode(), None
            for m in ASSIGN.finditer(text):
                if len(m[2]) >= ASSIGN_VALUE:
                    found[r].append(("assign", m.start(), m.end(), m[2]))
                    if at is None:
                        at = np.concatenate((lo + np.flatnonzero(first[lo:hi]), [hi]))  # byte of each code point
                    taken.append((int(at[m.start()]), int(at[m.end()])))
        for w, kind, least in ((caps, "access", ACCESS_LENGTH), (hexes, "hex", HEX_LENGTH)):
            long = np.flatnonzero(w.end - w.start >= least)
            for i, r in zip(long.tolist(), (np.searchsorted(w.at, long, "right") - 1).tolist(), strict=True):
                lo, hi = int(w.start[i]), int(w.end[i])
                value = w.data[lo:hi].tobytes()
                if kind == "access":
                    k = value.find(b"AKIA")
                    if k < 0 or hi - lo - k < least:
                        continue
                    lo, value = lo + k, value[k:]
                found[r].append((kind, int(point[lo] - base[r]), int(point[hi] - base[r]), value.decode()))
                taken.append((lo, hi))
        long = np.flatnonzero(tokens.end - tokens.start >= min_length)
        yield tokens, found, *_outside(tokens.start[long], tokens.end[long], np.searchsorted(tokens.at, long, "right") - 1, taken, min_length), point


def _outside(start: np.ndarray, end: np.ndarray, row: np.ndarray, taken: list[tuple[int, int]], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the sorted, disjoint tokens hold outside ``taken``, in parts of at least ``least`` bytes."""
    spans: list[list[int]] = []
    for lo, hi in sorted(taken):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(hi, spans[-1][1])
        else:
            spans.append([lo, hi])
    if not spans:
        return start, end, row
    lo, hi = np.array(spans).T
    a, b = np.searchsorted(hi, start, "right"), np.searchsorted(lo, end, "left")
    free, parts = a >= b, []
    for n in np.flatnonzero(~free).tolist():
        at = int(start[n])
        for x, y in [*spans[a[n] : b[n]], [int(end[n])] * 2]:
            if x - at >= least:
                parts.append((at, x, int(row[n])))
            at = max(at, y)
    more = np.array(parts, dtype=np.int64).reshape(-1, 3)
    return tuple(np.concatenate((x[free], y)) for x, y in zip((start, end, row), more.T, strict=True))


def _score(model: SecretModel, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Best log-likelihood ratio: bits per character less what the end and steps never seen cost; tokens advance together, one character a turn."""
    order = np.argsort(start - end, kind="stable")
    s, n = start[order], (end - start)[order]
    total = [np.zeros(len(s)) for _ in model.automata]
    whole = [np.zeros(len(s)) for _ in model.automata]
    state = [np.zeros(len(s), np.int64) for _ in model.automata]
    last = np.full(len(s), N_CLASS, np.int64)
    for i in range(int(n[0]) if len(n) else 0):
        k = int(np.searchsorted(-n, -i, "left"))
        c = _CLASS[data[s[:k] + i]]
        free = model.background[last[:k], c]
        for a, t, w, q in zip(model.automata, total, whole, state, strict=True):
            gain, known = a.bits[q[:k], c] - free, a.seen[q[:k], c]
            t[:k] += np.where(known, gain, 0.0)
            w[:k] += np.where(known, 0.0, gain)
            q[:k] = a.step[q[:k], c]
        last[:k] = c
    best = np.full(len(s), -np.inf)
    if model.automata and len(s):
        ends = [np.minimum(0.0, a.bits[q, N_CLASS] - model.background[last, N_CLASS]) for a, q in zip(model.automata, state, strict=True)]
        best[order] = np.max([t / n + w + e for t, w, e in zip(total, whole, ends, strict=True)], axis=0)
    return best


def fit(docs: DataFrame, text: str = "text", max_values: int = 500, min_length: int = ASSIGN_VALUE, min_bits: float = 1.0, max_length: int = 256) -> SecretModel:
    """Learns the automata and the background from the corpus itself."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros((N_CLASS + 1) ** 2, dtype=np.int64)
        for b in batches:
            known = set()
            for w, found, start, end, _, _ in _spans(b.column(0), min_length):
                known.update((kind, value) for spans in found for kind, _, _, value in spans)
                n = end - start
                first = np.cumsum(n) - n
                c = _CLASS[w.data[np.repeat(start - first, n) + np.arange(n.sum())]]
                last = np.concatenate(([N_CLASS], c[:-1]))[: len(c)]
                last[first] = N_CLASS
                pairs += np.bincount(last * (N_CLASS + 1) + c, minlength=len(pairs))
                pairs += np.bincount(c[first + n - 1] * (N_CLASS + 1) + N_CLASS, minlength=len(pairs))
            rows = sorted(known)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.string()), pa.array([None] * len(rows), pa.int32()), pa.array([1] * len(rows), pa.int64())], names=["kind", "value", "pair", "n"])
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array([None] * len(at), pa.string()), pa.array([None] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(pairs[at])], names=["kind", "value", "pair", "n"])

    rows = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(gather, "kind string, value string, pair int, n long")
    seen = written(rows.groupBy("kind", "value", "pair").agg(F.sum("n").alias("n")), "secrets")
    pairs = np.zeros((N_CLASS + 1, N_CLASS + 1))
    for r in seen.where(F.col("pair").isNotNull()).collect():  # one row per pair of classes
        pairs[divmod(r["pair"], N_CLASS + 1)] = r["n"]
    automata = []
    for kind in KINDS[:3]:
        values = [r[0] for r in seen.where((F.col("kind") == kind) & (F.length("value") <= max_length)).orderBy(F.xxhash64("value"), "value").limit(max_values).select("value").collect()]
        if values:
            automata.append(infer(kind, values))
    background = np.log2((pairs + 0.5) / (pairs.sum(1, keepdims=True) + 0.5 * (N_CLASS + 1)))
    return SecretModel(automata, background, min_length, min_bits)


def find(docs: DataFrame, model: SecretModel, text: str = "text", to: str = "secret_spans") -> DataFrame:
    """Adds an array of (kind, start, end) in code points, end exclusive."""
    at = docs.sparkSession.sparkContext.broadcast(model)
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = at.value
        for b in batches:
            out: list = []
            for w, found, start, end, row, point in _spans(b.column(place), m.min_length):
                hit = np.flatnonzero(_score(m, w.data, start, end) >= m.min_bits)
                begin = point[start[hit]] - point[w.offsets[row[hit]]]
                for lo, n, r in zip(begin.tolist(), (end - start)[hit].tolist(), row[hit].tolist(), strict=True):
                    found[r].append(("grammar", lo, lo + n, ""))
                out += [[{"kind": k, "start": s, "end": e} for k, s, e, _ in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))] for spans in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind_of)], names=names)

    plain = without(docs, to)
    place, names = plain.columns.index(text), [*plain.columns, to]
    return mapped(plain, run, plain.withColumn(to, F.lit(None).cast("array<struct<kind:string,start:int,end:int>>")).schema)


def redact(docs: DataFrame, model: SecretModel, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Replaces every span by ``mark`` (touching or overlapping spans by one); null texts stay null."""
    spans = free_name(docs, "secret_spans")
    found = find(docs, model, text, spans)
    piece = lambda a, s: F.struct(
        F.concat(a["out"], F.when(s["start"] > a["at"], F.concat(F.substring(F.col(f"`{text}`"), a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).when(a["at"] == 0, F.lit(mark)).otherwise(F.lit(""))).alias("out"),
        F.greatest(a["at"], s["end"]).alias("at"),
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    clean = F.aggregate(spans, start, piece, lambda a: F.concat(a["out"], F.substring(F.col(f"`{text}`"), a["at"] + 1, F.length(F.col(f"`{text}`")))))
    return found.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(F.col(f"`{text}`"))).select(*[F.col(f"`{c}`") for c in docs.columns])
