"""SentencePiece encoding and decoding (operator 4) on a relational lattice.

Distinct units of text (a word with its leading spaces, cut further wherever no piece
spans the two neighbouring characters, which is exact) are exploded into their substrings up
to the longest piece, equi-joined to the piece table, and the edges found are grouped by
unit.  A Spark higher-order ``aggregate`` then folds each unit's edges:

* ``viterbi`` (unigram models): best total score over the lattice, left to right;
* ``merge`` (BPE models): the best-scored edge over exactly two current pieces is taken,
  leftmost first, until none is left.  For a BPE model the Viterbi path is *not* what the
  library returns (see the README for the share that differs), so the model's type decides.

The number of pieces of the Viterbi path, whatever the model, comes from the same lattice by the same fold over the
places of all units of a batch at once (``path_lengths``).  Characters that no edge covers get their ids there too
(``ids_of``): a table of all code points stays out of the plan, which the driver describes as text again and again.

Units are encoded once for the corpus: counted inside tasks, dealt by unit, and folded where they
lie, so the lattice needs no shuffle of its own.  The most frequent ones (``common`` at most, a fixed
number) are broadcast; of the others, 64-bit hashes meet the lexicon and return to their documents by a join.

Defined results: null texts give null ids, empty texts none; repeated rows are encoded
alike; characters without a piece become byte pieces (or the unknown piece); a table without rows
gives none.  Units of more than ``FOLD_LIMIT`` characters without a safe cut go through the same
merge (or Viterbi) rule with a heap, since the fold is quadratic in the unit's length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import row_groups, span_hashes
from .common import count_bucket, free_name, least_bucket, mapped, without, written

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
FOLD_LIMIT = 60
COMMON = 1_000_000
SLICE_BYTES = 1 << 19
HELD_BYTES = 48 << 20


@dataclass(frozen=True)
class Pieces:
    """The piece table of a model file: (piece, id, score), byte ids, and how to fold."""

    rows: list[tuple[str, int, float]]
    byte_ids: list[int]
    unknown: int
    fold: str
    prefix: bool
    text_of: dict[int, bytes]

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.rows)


def load(path: str = MODEL_PATH) -> Pieces:
    """Reads a model file on the driver (a vocabulary, so of bounded size)."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or any(p.type == 4 for p in model.pieces):
        raise ValueError("only identity normalisation without user symbols is supported")
    rows = [(p.piece, i, float(p.score)) for i, p in enumerate(model.pieces) if p.type == 1]
    if any(SPACE in p.lstrip(SPACE) for p, _, _ in rows):
        raise ValueError("a piece spans two words")
    known = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 6}
    byte_ids = [known[f"<0x{b:02X}>"] for b in range(256)] if model.trainer_spec.byte_fallback else []
    text_of = {i: p.replace(SPACE, " ").encode() for p, i, _ in rows} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
    unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
    return Pieces(rows, byte_ids, unknown, {1: "viterbi", 2: "merge"}[model.trainer_spec.model_type], model.normalizer_spec.add_dummy_prefix, text_of)


class Cutter:
    """Cuts texts into units at every place that no piece spans."""

    def __init__(self, pieces: Pieces) -> None:
        chars = sorted({ord(c) for p, _, _ in pieces.rows for c in p})
        self.kind = np.zeros(0x110000, dtype=np.int16)
        self.kind[chars] = np.arange(1, len(chars) + 1)
        joins = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
        for p, _, _ in pieces.rows:
            k = self.kind[[ord(c) for c in p]]
            joins[k[:-1], k[1:]] = True
        self.joins = np.packbits(joins, axis=1)  # one bit for each pair of characters
        self.prefix = SPACE if pieces.prefix else ""

    def units(self, text: str) -> list[str]:
        return Units([text], self).strings() if text else []


class Units:
    """Units of some texts: spans of the joined text, row by row, with their hashes and the distinct ones."""

    def __init__(self, texts: list[str | None], cutter: Cutter) -> None:
        rows = [cutter.prefix + t.replace(" ", SPACE) if t else "" for t in texts]
        self.text = "".join(rows)
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        edge = np.cumsum([0, *map(len, rows)])
        kind = cutter.kind[codes]
        cut = np.ones(len(codes) + 1, dtype=bool)
        cut[1:-1] = (cutter.joins[kind[:-1], kind[1:] >> 3] >> (7 - (kind[1:] & 7)).astype(np.uint8)) & 1 == 0
        cut[edge] = True
        at = np.flatnonzero(cut)
        self.start, self.end = at[:-1], at[1:]
        if not len(codes):
            self.start = self.end = np.zeros(0, np.int64)
        self.at = np.searchsorted(self.start, edge)
        self.which, self.known = pd.factorize(hash_codes(codes, self.start, self.end))
        self.first = np.zeros(len(self.known), dtype=np.int64)
        self.first[self.which[::-1]] = np.arange(len(self.which))[::-1]

    def strings(self) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)]

    def distinct(self, chosen: np.ndarray | slice = slice(None)) -> list[str]:
        """The strings of the distinct units (in the order of ``known``)."""
        k = self.first[chosen]
        return [self.text[a:b] for a, b in zip(self.start[k].tolist(), self.end[k].tolist(), strict=True)]


def hash_codes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hashes(lambda lo, hi: codes[lo:hi] + np.uint64(0x9E3779B97F4A7C15), start, end)


def hash_strings(strings: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.cumsum([0, *map(len, strings)])
    return hash_codes(codes, at[:-1], at[1:])


def _constants(values: Iterable, kind: str) -> Column:
    """An array literal, from one string (an element at a time costs a call to the JVM each)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _bits(start: Column, end: Column) -> tuple[Column, Column]:
    """As bits of a long: the two boundaries of an edge, and the boundaries between them."""
    lo, hi = (F.call_function("shiftleft", F.lit(1).cast("long"), x) for x in (start, end))
    return lo.bitwiseOR(hi), hi - lo - lo


def _merged(n: Column, merges: Column) -> Column:
    """Boundaries (bits) after all merges; edges of two characters or more, sorted by (-score, start)."""

    def step(cuts: Column, _: Column) -> Column:
        two = lambda e: (cuts.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(cuts.bitwiseAND(e["inner"])) == 1)
        best = F.get(F.filter(merges, two), F.lit(0))
        return F.coalesce(cuts.bitwiseAND(F.bitwise_not(best["inner"])), cuts)

    whole = F.call_function("shiftleft", F.lit(2).cast("long"), n) - 1
    return F.when(F.size(merges) == 0, whole).otherwise(F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(n - 1, F.lit(1)), F.size(merges))), whole, step))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: inside a lambda, an expression would be computed at each step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _viterbi(n: Column, several: Column, cost: Column) -> Column:
    """Per place of a unit the best (score, few, back) that leads there; of equal scores the one of the fewest pieces, then of the longest last piece.

    ``several`` holds the edges of two characters or more (start, end, score), ``cost`` gives the score of a single one (0: no piece); ``few`` is minus
    the number of pieces, ``back`` minus the place before.  A character without a piece that no edge ends at costs 10 more than the worst score.
    """
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("few"), F.lit(0).alias("back")))
    over = lambda best, start, score: F.struct((F.get(best, start)["score"] + score).alias("score"), (F.get(best, start)["few"] - 1).alias("few"), (-start).alias("back"))
    lone = F.filter(F.transform(F.sequence(F.lit(0), n - 1), cost), lambda x: x < 0)
    worst = F.least(F.array_min(F.transform(several, lambda e: e["score"])), F.coalesce(F.array_min(lone), F.lit(0.0))) - 10.0

    def step(best: Column, j: Column) -> Column:
        into = F.array_max(F.transform(F.filter(several, lambda e: e["end"] == j), lambda e: over(best, e["start"], e["score"])))
        alone = cost(j - 1)
        one = F.when(alone < 0, over(best, j - 1, alone))
        return F.concat(best, F.array(F.coalesce(F.greatest(into, one), over(best, j - 1, worst))))

    return F.aggregate(F.sequence(F.lit(1), n), first, step)


def _cuts_of(n: Column, best: Column) -> Column:
    """Boundaries of the best path, from the end back."""
    back = lambda b: lambda cuts, _: F.when(F.get(cuts, F.lit(0)) <= 0, cuts).otherwise(F.concat(F.array(-F.get(b, F.get(cuts, F.lit(0)))["back"]), cuts))
    return _let(best, lambda b: F.aggregate(F.sequence(F.lit(1), n), F.array(n), back(b)))


def path_tables(pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Scores by rank, best first, and by code point (-inf: no piece of that one character)."""
    lone = {ord(p): score for p, _, score in pieces.rows if len(p) == 1}
    single = np.full(2 + max(lone, default=0), -np.inf)  # the last one stands for all characters beyond
    single[list(lone)] = list(lone.values())
    return np.array(sorted({score for _, _, score in pieces.rows}, reverse=True)), single


def path_lengths(units: list[str], lattice: pa.Array, scores: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Number of pieces of each unit's Viterbi path, by the rules of ``_viterbi``, place by place over all units (of at most ``FOLD_LIMIT`` characters).

    ``lattice`` lists the edges of two characters or more as (rank * 64 + start) * 64 + end.
    """
    size, (edges, packed) = np.array([len(u) for u in units], dtype=np.int64), _lists(lattice)
    unit, start, end, score = np.repeat(np.arange(len(units)), edges), packed >> 6 & 63, packed & 63, scores[packed >> 12]
    codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    alone = np.full((len(units), size.max(initial=0)), -np.inf)
    alone[np.arange(alone.shape[1]) < size[:, None]] = single[np.minimum(codes, len(single) - 1)]
    worst = np.where(np.isfinite(alone), alone, 0.0).min(axis=1, initial=0.0)
    np.minimum.at(worst, unit, score)
    best, few = np.zeros((alone.shape[1] + 1, len(units))), np.zeros((alone.shape[1] + 1, len(units)), dtype=np.int64)
    by = np.argsort(end, kind="stable")
    at = np.searchsorted(end[by], np.arange(alone.shape[1] + 2))
    for j in range(1, alone.shape[1] + 1):
        into = by[at[j] : at[j + 1]]
        u, total, steps = unit[into], best[start[into], unit[into]] + score[into], few[start[into], unit[into]] + 1
        one = best[j - 1] + alone[:, j - 1]
        most = one.copy()
        np.maximum.at(most, u, total)
        count = np.where(one == most, few[j - 1] + 1, FOLD_LIMIT + 1)
        equal = total == most[u]
        np.minimum.at(count, u[equal], steps[equal])
        none = np.isneginf(most)
        best[j], few[j] = np.where(none, best[j - 1] + worst - 10.0, most), np.where(none, few[j - 1] + 1, count)
    return few[size, np.arange(len(units))]


def _reach(pieces: Pieces) -> Column:
    """Longest piece by its first two characters (index 128 a + b; the word sign counts as 1, other characters as 0), at least 2."""
    at = lambda c: ord(c) if ord(c) < 128 else int(c == SPACE)
    table = np.zeros((128, 128), dtype=np.int32)
    for p, _, _ in pieces.rows:
        if len(p) > 1:
            k = at(p[0]), at(p[1])
            table[k] = max(table[k], len(p))
    table[0, :] = table[:, 0] = pieces.longest
    return _constants(table.ravel().tolist(), "int")


def single_tables(pieces: Pieces) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids by code point (-1: no piece of that one character), those of bytes, and that of the unknown piece."""
    lone = {ord(p): i for p, i, _ in pieces.rows if len(p) == 1}
    by_code = np.full(2 + max(lone, default=0), -1, dtype=np.int32)  # the last one stands for all characters beyond
    by_code[list(lone)] = list(lone.values())
    return by_code, np.array(pieces.byte_ids, dtype=np.int32), pieces.unknown


def ids_of(units: list[str], cuts: pa.Array, taken: pa.Array, by_code: np.ndarray, of_byte: np.ndarray, unknown: int) -> pa.Array:
    """Ids of each unit: of the edges taken (id * 64 + start), and of each character between two neighbouring boundaries; null for units of over FOLD_LIMIT characters."""
    size, bits = np.array([len(u) for u in units], dtype=np.int64), cuts.fill_null(0).to_numpy(zero_copy_only=False)
    long = size > FOLD_LIMIT
    codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    unit = np.repeat(np.arange(len(units)), size)
    start = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    alone = np.flatnonzero(~long[unit] & (bits[unit] >> np.minimum(start, FOLD_LIMIT) & 3 == 3))
    at, code = unit[alone] * 64 + start[alone], codes[alone].astype(np.int64)
    ids = by_code[np.minimum(code, len(by_code) - 1)]
    if len(of_byte):
        n = np.where(ids < 0, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
        raw = "".join(map(chr, code[ids < 0].tolist())).encode()
        at, ids = np.repeat(at, n), np.repeat(ids, n)
        ids[ids < 0] = of_byte[np.frombuffer(raw, np.uint8)]
    else:
        ids[ids < 0] = unknown
    edges, packed = _lists(taken)
    at = np.concatenate((at, np.repeat(np.arange(len(units)), edges) * 64 + (packed & 63)))
    order = np.argsort(at, kind="stable")  # the bytes of a character stay in order
    edge = np.searchsorted(at[order], np.arange(len(units) + 1) * 64)
    return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.concatenate((ids, packed >> 6))[order].astype(np.int32)), mask=pa.array(long) if long.any() else None)


def encode_units(units: DataFrame, pieces: Pieces, best: bool = False) -> DataFrame:
    """Distinct (unit, ...) to (unit, ..., ids); null ids for units of over FOLD_LIMIT characters.

    ``best`` adds ``lattice``, the edges as ``path_lengths`` takes them.
    """
    tables = units.sparkSession.sparkContext.broadcast(single_tables(pieces))
    folded = fold_units(units, pieces, best)
    kept = folded.drop("cuts", "taken")
    place, names = kept.columns.index("unit"), [*kept.columns, "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *same, cuts, taken = b.columns
            yield pa.RecordBatch.from_arrays([*same, ids_of(same[place].to_pylist(), cuts, taken, *tables.value)], names=names)

    return folded.mapInArrow(run, kept.withColumn("ids", F.lit(None).cast("array<int>")).schema)


def fold_units(units: DataFrame, pieces: Pieces, best: bool = False) -> DataFrame:
    """Distinct (unit, ...) to (unit, ...[, lattice], cuts, taken): the boundaries as bits, and the edges of two characters or more on the path as ``ids_of`` takes them.

    The piece table is a vocabulary, so it is broadcast; rows dealt by unit stay where they are.
    """
    spark, kept = units.sparkSession, units.columns
    order = sorted({score for _, _, score in pieces.rows}, reverse=True)
    rank = {score: k for k, score in enumerate(order)}
    table = spark.createDataFrame([(p, i, rank[s]) for p, i, s in pieces.rows if len(p) > 1], "piece string, id int, rank int")
    n = F.length("unit")
    start, k = F.col("start"), F.col("k")
    code = lambda s: F.ascii(F.substring(F.col("unit"), s + 1, F.lit(1)))
    ascii_ = lambda c: F.when(c < 128, c).otherwise((c == ord(SPACE)).cast("int"))
    reach = F.get(_reach(pieces), ascii_(code(start)) * 128 + ascii_(code(start + 1)))
    # one row stays of a unit without any piece, and of one that is too long
    starts = units.select(*kept, F.explode(F.sequence(F.lit(0), F.when(n > FOLD_LIMIT, 0).otherwise(F.greatest(n - 2, F.lit(0))))).alias("start"))
    starts = starts.withColumn("most", F.when(n > FOLD_LIMIT, 2).otherwise(F.least(reach, n - start))).where("most > 1 or start = 0")
    parts = starts.select(*kept, "start", F.explode(F.sequence(F.lit(2), F.greatest(F.col("most"), F.lit(2)))).alias("k"))
    found = parts.withColumn("piece", F.substring(F.col("unit"), start + 1, k)).join(F.broadcast(table), "piece", "left").where("id is not null or (start = 0 and k = 2)")
    ends, inner = _bits(start, start + k)
    # sorted, the edges of a unit stand in the order of (rank, start, end)
    fields = [((F.col("rank").cast("long") * 64 + start) * 64 + start + k).alias("order"), ends.alias("ends"), inner.alias("inner"), "id", "start"]
    if pieces.fold == "viterbi":
        fields += [(start + k).alias("end"), F.get(_constants(order, "double"), F.col("rank")).alias("score")]
    lattice = found.groupBy(*kept).agg(F.sort_array(F.collect_list(F.when(F.col("id").isNotNull() & (n <= FOLD_LIMIT), F.struct(*fields)))).alias("edges"))
    if pieces.fold == "merge":
        folded = lattice.withColumn("cuts", _merged(n, F.col("edges")))
    else:
        cost = [0.0] * (1 + max(ord(p) for p, _, _ in pieces.rows if len(p) == 1))
        for p, _, score in pieces.rows:
            if len(p) == 1:
                cost[ord(p)] = score
        costs = _constants(cost, "double")
        bit = lambda a, x: a + F.call_function("shiftleft", F.lit(1).cast("long"), x)
        path = _cuts_of(n, _viterbi(n, F.col("edges"), lambda i: F.get(costs, code(i))))
        folded = lattice.withColumn("path", F.when(n <= FOLD_LIMIT, path)).withColumn("cuts", F.aggregate("path", F.lit(0).cast("long"), bit))
    if best:
        folded, kept = folded.withColumn("lattice", F.col("edges")["order"]), [*kept, "lattice"]
    mine = lambda e: (F.col("cuts").bitwiseAND(e["ends"]) == e["ends"]) & (F.col("cuts").bitwiseAND(e["inner"]) == 0)
    return folded.select(*kept, "cuts", F.transform(F.filter("edges", mine), lambda e: e["id"].cast("long") * 64 + e["start"]).alias("taken"))


def best_spans(unit: str, pieces: Pieces, by_piece: dict[str, tuple[int, float]]) -> list[tuple[int, int]]:
    """The Viterbi path of one unit, from left to right."""
    n = len(unit)
    edges = [[(i, by_piece[unit[i:j]][1]) for i in range(max(0, j - pieces.longest), j) if unit[i:j] in by_piece] for j in range(n + 1)]
    worst = min((s for e in edges for _, s in e), default=0.0) - 10.0
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    for j in range(1, n + 1):
        best.append(max(((best[i][0] + s, best[i][1] - 1, -i) for i, s in edges[j]), default=(best[j - 1][0] + worst, best[j - 1][1] - 1, 1 - j)))
    spans, j = [], n
    while j > 0:
        spans.append((-best[j][2], j))
        j = -best[j][2]
    return spans[::-1]


def encode_long(unit: str, pieces: Pieces, by_piece: dict[str, tuple[int, float]]) -> list[int]:
    """The same rules for one very long unit: merges from a heap, or Viterbi from left to right."""
    n = len(unit)
    if pieces.fold == "merge":
        left, right = list(range(-1, n)), list(range(1, n + 2))
        end, alive, heap = list(range(1, n + 1)), [True] * n, []

        def offer(a: int) -> None:
            b = right[a]
            if a >= 0 and b < n and (p := by_piece.get(unit[a : end[b]])):
                heapq.heappush(heap, (-p[1], a, end[a], end[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, mid, stop = heapq.heappop(heap)
            if not alive[a] or end[a] != mid or mid >= n or not alive[mid] or end[mid] != stop:
                continue
            alive[mid] = False
            end[a], right[a] = stop, right[mid]
            if right[a] < n:
                left[right[a]] = a
            offer(a)
            if left[a] >= 0:
                offer(left[a])
        spans = [(a, end[a]) for a in range(n) if alive[a]]
    else:
        spans = best_spans(unit, pieces, by_piece)
    out: list[int] = []
    for a, b in spans:
        known = by_piece.get(unit[a:b])
        out += [known[0]] if known else [pieces.byte_ids[x] for x in unit[a:b].encode()] if pieces.byte_ids else [pieces.unknown]
    return out


def _slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose text column holds at most a chunk of bytes."""
    for b in batches:
        sizes = pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        for lo, hi in row_groups(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), limit):
            yield b.slice(lo, hi - lo)


def _pack(texts: pa.Array) -> pa.Array:
    """Texts as their size and zstd bytes, which makes the one shuffle of whole texts smaller."""
    codec = pa.Codec("zstd", compression_level=3)
    raw = [None if t is None else t.encode() for t in texts.to_pylist()]
    return pa.array([None if t is None else len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in raw], pa.binary())


def _unpack(packed: pa.Array) -> list[str | None]:
    codec = pa.Codec("zstd")
    return [None if p is None else codec.decompress(p[8:], int.from_bytes(p[:8], "little"), asbytes=True).decode() for p in packed.to_pylist()]


def _place(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value stands in the sorted hashes; -1 if it doesn't."""
    if not len(hashes):
        return np.full(len(wanted), -1)
    k = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return np.where(hashes[k] == wanted, k, -1)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a list column."""
    return pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def _count_units(texts: DataFrame, cutter) -> DataFrame:
    """(text) to (unit, n): occurrences of each unit, added up in each task over some megabytes of text at a time."""

    def add_up(parts: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> pa.RecordBatch:
        which, known = pd.factorize(np.concatenate([h for h, _, _ in parts]))
        first = np.zeros(len(known), dtype=np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        total = np.bincount(which, np.concatenate([n for _, n, _ in parts]), len(known)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.concat_arrays([u for _, _, u in parts]).take(pa.array(first)), pa.array(total)], names=["unit", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in _slices(batches, 0):
            u = Units(b.column(0).to_pylist(), cutter.value)
            parts.append((u.known, np.bincount(u.which, minlength=len(u.known)), pa.array(u.distinct(), pa.string())))
            size += parts[-1][2].nbytes + 16 * len(u.known)
            if size > HELD_BYTES:
                yield add_up(parts)
                parts, size = [], 0
        if parts:
            yield add_up(parts)

    return texts.mapInArrow(run, "unit string, n long")


def _lexicon(texts: DataFrame, pieces: Pieces, cutter, best: bool) -> DataFrame:
    """(text) to (hash, n, ids, best) of every distinct unit: 64-bit hash, occurrences, ids, pieces of the Viterbi path (null unless asked for)."""
    spark = texts.sparkSession
    width = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # the rows grow in number when exploded, so not by their bytes
    units = _count_units(texts, cutter).repartition(width, "unit").groupBy("unit").agg(F.sum("n").alias("n"))
    rules = spark.sparkContext.broadcast((pieces, {p: (i, s) for p, i, s in pieces.rows}))
    tables, singles = (spark.sparkContext.broadcast(x) for x in (path_tables(pieces), single_tables(pieces)))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units, paths = b.column(0).to_pylist(), pa.nulls(len(b), pa.int32())
            ids = ids_of(units, b.column(2), b.column(3), *singles.value)
            if best:
                # a long unit has no edges, and gets its own number below
                paths = pa.array(path_lengths([u[:FOLD_LIMIT] for u in units], b.column(4), *tables.value), pa.int32())
            if ids.null_count:
                long = [k for k, x in enumerate(ids.is_null().to_pylist()) if x]
                whole, counts = ids.to_pylist(), paths.to_pylist()
                for k in long:
                    whole[k] = encode_long(units[k], *rules.value)
                    counts[k] = len(best_spans(units[k], *rules.value)) if best else None
                ids, paths = pa.array(whole, pa.list_(pa.int32())), pa.array(counts, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(hash_strings(units).view(np.int64)), b.column(1), ids, paths], names=["hash", "n", "ids", "best"])

    folded = fold_units(units, pieces, best)
    return folded.select("unit", "n", "cuts", "taken", *(["lattice"] if best else [])).mapInArrow(named, "hash long, n long, ids array<int>, best int")


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", to: str = "piece_ids", decoded: str | None = None, common: int = COMMON, best: str | None = None) -> DataFrame:
    """Adds ``to``, the ids of each text; if ``decoded`` names a column, the text that they decode to; and if ``best`` names one, the
    number of pieces of the Viterbi paths (characters without a piece count once)."""
    spark = docs.sparkSession
    docs = without(docs, to, *[c for c in (decoded, best) if c])
    cutter = spark.sparkContext.broadcast(Cutter(pieces))
    content = F.col(f"`{text}`").cast("string")
    lexicon = written(_lexicon(docs.select(content.alias("text")), pieces, cutter, bool(best)), "lexicon")
    often = (F.col("n") > 1) & (count_bucket(F.col("n")) >= least_bucket(lexicon.where("n > 1"), common))
    top = lexicon.where(often).select("hash", "ids", "best").toArrow().combine_chunks()  # at most `common` rows
    sizes, values = _lists(top["ids"].combine_chunks() if isinstance(top["ids"], pa.ChunkedArray) else top["ids"])
    names = top["hash"].to_numpy().view(np.uint64)
    order = np.argsort(names)
    starts = np.cumsum(sizes) - sizes
    # sorted hashes of the common units, and where their ids lie in one array
    narrow = np.uint16 if max(i for _, i, _ in pieces.rows) < 1 << 16 else np.int32
    lengths = top["best"].combine_chunks().fill_null(0).to_numpy() if isinstance(top["best"], pa.ChunkedArray) else top["best"].fill_null(0).to_numpy()
    shared = spark.sparkContext.broadcast((names[order], starts[order].astype(np.int32), sizes[order].astype(np.int32), values.astype(narrow), lengths[order].astype(np.int32) if best else lengths[:0]))
    del top, names, starts, sizes, values, lengths
    pa.default_memory_pool().release_unused()

    key, own = free_name(docs, "_key"), free_name(docs, "_own")
    keyed = docs.withColumn(key, F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t]))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 1):
            u = Units(b.column(1).to_pylist(), cutter.value)
            new = np.flatnonzero(_place(shared.value[0], u.known) < 0)
            number = np.full(len(u.known), -1)
            number[new] = np.arange(len(new))
            row, k = np.repeat(np.arange(len(b)), np.diff(u.at)), number[u.which]
            pairs = np.unique(row[k >= 0] * (len(new) + 1) + k[k >= 0])
            units = pa.array(u.known[new].view(np.int64)[pairs % (len(new) + 1)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pairs // (len(new) + 1))), units], names=["key", "hash"])

    missing = keyed.select(F.col(key), content.alias("text")).mapInArrow(rare, "key long, hash long")
    found = missing.join(lexicon.where(~often).select("hash", "ids", "best"), "hash").groupBy("key").agg(F.collect_set(F.struct("hash", "ids", "best")).alias(own)).withColumnRenamed("key", key)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, place_of_text):
            yield pa.RecordBatch.from_arrays([_pack(b.column(i)) if i == place_of_text else b.column(i) for i in range(b.num_columns)], names=loose_names)

    place_of_text, loose_names = keyed.columns.index(text), keyed.columns
    loose = keyed.withColumn(text, content)
    packed = mapped(loose, pack, loose.withColumn(text, F.col(f"`{text}`").cast("binary")).schema)
    ready = packed.join(found, key, "left").withColumn(to, F.lit(None).cast("array<int>"))
    ready = ready.withColumn(decoded, F.lit(None).cast("string")) if decoded else ready
    ready = ready.withColumn(best, F.lit(None).cast("long")) if best else ready
    drop = {key, own}
    out = ready.withColumn(text, F.col(f"`{text}`").cast("string")).select(*[F.col(f"`{c}`") for c in ready.columns if c not in drop])
    columns, names_in, text_of, prefix = out.columns, ready.columns, pieces.text_of, pieces.prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, starts, sizes, values, lengths = shared.value
        words = _words(text_of)
        for b in _slices(batches, names_in.index(text), SLICE_BYTES // 2):
            names = names_in
            own_units = b.column(names.index(own)).flatten()
            more, flat = _lists(own_units.field("ids"))
            own_hash = own_units.field("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            by = np.argsort(own_hash)
            pool = np.concatenate((values, flat.astype(values.dtype)))
            at, n = np.concatenate((starts, (len(values) + np.cumsum(more) - more)[by])), np.concatenate((sizes, more[by]))
            texts = _unpack(b.column(names.index(text)))
            absent = pa.array([t is None for t in texts])
            u = Units(texts, cutter.value)
            place = _place(hashes, u.known)
            new = place < 0
            place[new] = len(hashes) + _place(own_hash[by], u.known[new])
            idx = place[u.which]
            ends = np.concatenate(([0], np.cumsum(n[idx])))
            ids = pool[np.arange(ends[-1]) + np.repeat(at[idx] - ends[:-1], n[idx])]
            lists = pa.ListArray.from_arrays(pa.array(ends[u.at], pa.int32()), pa.array(ids.astype(np.int32)), mask=absent if None in texts else None)
            new_columns = {to: lists, text: pa.array(texts, pa.string())} | ({decoded: _decoded(lists, words, prefix)} if decoded else {})
            if best:
                every = np.concatenate((lengths, own_units.field("best").to_numpy(zero_copy_only=False).astype(np.int32)[by]))
                total = np.concatenate(([0], np.cumsum(every[idx], dtype=np.int64)))
                new_columns[best] = pa.array(np.diff(total[u.at]), pa.int64(), mask=absent.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([new_columns.get(c, b.column(names.index(c))) for c in columns], names=columns)

    return mapped(ready, run, out.schema)


def _words(text_of: dict[int, bytes]) -> pa.Array:
    """The bytes of each id; the last one, without any, stands for all other ids."""
    return pa.array([text_of.get(i, b"") for i in range(2 + max(text_of, default=-1))], pa.large_binary())


def _decoded(lists: pa.Array, words: pa.Array, prefix: bool) -> pa.Array:
    ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    taken = words.take(pa.array(np.where((ids >= 0) & (ids < len(words)), ids, len(words) - 1)))
    # the bytes of all lists, one after another
    at = pc.binary_length(taken).to_numpy(zero_copy_only=False).cumsum() if len(ids) else np.zeros(0, np.int64)
    edge = np.concatenate(([0], at))[np.concatenate(([0], np.cumsum(_lists(lists)[0])))].tolist()
    raw, out = taken.buffers()[2].to_pybytes() if edge[-1] else b"", []
    for known, lo, hi in zip(lists.is_valid().to_pylist(), edge[:-1], edge[1:], strict=True):
        lo += prefix and raw[lo : min(lo + 1, hi)] == b" "
        out.append(raw[lo:hi].decode(errors="replace") if known else None)
    return pa.array(out, pa.string())


def decode(df: DataFrame, pieces: Pieces, ids: str = "piece_ids", to: str = "decoded") -> DataFrame:
    """Adds the text of the ids; null ids give null.  Bytes that are not UTF-8 become U+FFFD."""
    at = df.sparkSession.sparkContext.broadcast((pieces.text_of, pieces.prefix))
    plain = without(df, to)
    place, names = plain.columns.index(ids), [*plain.columns, to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of, prefix = at.value
        words = _words(text_of)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _decoded(b.column(place), words, prefix)], names=names)

    return mapped(plain, run, plain.withColumn(to, F.lit(None).cast("string")).schema)
