"""Alignment of two tokenizers' tokens (operator 13).

A is a byte-level BPE tokenizer, B a piece model.  A text with a space before it is encoded by both; the byte offsets at which
tokens of both end cut the tokens into groups.  The last tokens of a group end together: they are linked.

Most groups hold one token of either side with the same bytes.  For those an array from A's ids to B's ids of the same bytes is computed
beforehand; their links are counted in one vector of the length of A's vocabulary per task, and the vectors are added up.  Only the
links of all other groups are shuffled as pairs, counted before in each task.

The counts go back to the documents the same way: the vectors (bounded by the vocabularies) and the most frequent of
the other pairs (at most ``common``) are broadcast; the remaining pairs meet their counts in a join.  Each document carries its own distinct links with
their numbers, so it is encoded once.

Defined results: null and empty texts, and texts that either side does not reproduce byte by byte (such as those with the
character U+2581 or with unassigned pieces), have no tokens: zeros and an empty string.  Repeated rows count once each.
Tables without rows give none; columns of the output's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteBPE, Encoder, text_groups
from .common import count_bucket, free_name, least_bucket, mapped, without, written
from .pairindex import Merges
from .sentencepiece import Cutter, Pieces, Units

#: Pairs of the other groups whose counts are broadcast: a fixed number of the most frequent ones.
COMMON = 100_000

OWN = ["n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum"]


@dataclass(frozen=True)
class PieceBPE:
    """A piece model for the pair index: symbols are piece ids, then characters that are no pieces, then one for unknown characters."""

    merges: Merges
    pieces: Pieces
    codes: np.ndarray
    symbols: np.ndarray
    unknown: int
    n_ids: int
    cutter: Cutter


def piece_bpe(pieces: Pieces) -> PieceBPE:
    if pieces.fold != "merge":
        raise ValueError("the pair index merges; a unigram model has no merges")
    symbol = {p: i for p, i, _ in pieces.rows}
    size = 1 + max([*symbol.values(), *pieces.byte_ids, pieces.unknown])
    for c in sorted({c for p in symbol for c in p} - set(symbol)):
        symbol[c] = size + len([s for s in symbol.values() if s >= size])
    order = {score: k for k, score in enumerate(sorted({s for _, _, s in pieces.rows}, reverse=True))}
    pairs = [(symbol[p[:i]], symbol[p[i:]], order[s], symbol[p]) for p, _, s in pieces.rows for i in range(1, len(p)) if p[:i] in symbol and p[i:] in symbol]
    codes = np.array(sorted(ord(c) for c in symbol if len(c) == 1), dtype=np.uint32)
    return PieceBPE(Merges.build(pairs), pieces, codes, np.array([symbol[chr(c)] for c in codes.tolist()], dtype=np.int64), 1 + max(symbol.values()), size, Cutter(pieces))


class PieceEncoder(Encoder):
    """Encodes texts with a piece model in one task; units are cut where no piece spans, as in ``sentencepiece``."""

    def words(self, texts: list[str | None]) -> Units:
        return Units(texts, self.coder.cutter)

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = np.cumsum([0, *map(len, words)])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        k = np.minimum(np.searchsorted(self.coder.codes, codes), len(self.coder.codes) - 1)
        symbols = np.where(self.coder.codes[k] == codes, self.coder.symbols[k], self.coder.unknown)
        ids, began = self.index.merge(symbols, at)
        odd = ids >= self.coder.n_ids
        sizes = np.diff(np.searchsorted(began, at))
        if odd.any():  # characters without a piece become bytes
            own = [self.coder.pieces.byte_ids and [self.coder.pieces.byte_ids[x] for x in chr(c).encode()] or [self.coder.pieces.unknown] for c in codes[began[odd]].tolist()]
            width = np.ones(len(ids), dtype=np.int64)
            width[odd] = [len(x) for x in own]
            ends = np.concatenate(([0], np.cumsum(width)))
            out = np.repeat(ids, width)
            out[np.repeat(odd, width)] = np.concatenate(own)
            word = np.concatenate(([0], np.cumsum(sizes)))
            ids, sizes = out, np.diff(ends[word])
        return ids, sizes


def _bytes_of(pieces: Pieces, n_ids: int) -> list[bytes]:
    return [pieces.text_of.get(i, b"") for i in range(n_ids)]


def identity_map(a: ByteBPE, b: PieceBPE) -> np.ndarray:
    """For each id of A the id of B with the same bytes, or -1; a piece goes before a single byte."""
    of: dict[bytes, int] = {raw: i for i, raw in sorted(enumerate(_bytes_of(b.pieces, b.n_ids)), key=lambda x: (x[0] not in set(b.pieces.byte_ids), -x[0])) if raw}
    return np.array([of.get(raw, -1) if raw else -1 for raw in a.token_bytes], dtype=np.int64)


@dataclass(frozen=True)
class Tables:
    """What the tasks of the alignment look up."""

    a: ByteBPE
    b: PieceBPE
    a_size: np.ndarray
    b_size: np.ndarray
    same: np.ndarray

    @staticmethod
    def of(a: ByteBPE, b: PieceBPE) -> Tables:
        return Tables(a, b, np.array([len(x) for x in a.token_bytes]), np.array([len(x) for x in _bytes_of(b.pieces, b.n_ids)]), identity_map(a, b))


class Grouper:
    """Groups of one text from the ids of both sides."""

    def __init__(self, t: Tables) -> None:
        self.t = t
        self.b_bytes = _bytes_of(t.b.pieces, t.b.n_ids)
        n, m = len(t.a_size), len(t.b_size)
        # an id and the sign after it: within a group, and at its end
        self.names = [f"{i}," for i in range(n)] + [f"{i}|" for i in range(n)] + [f"{i}," for i in range(m)] + [f"{i};" for i in range(m)]

    def reproduced(self, raw: bytes, a: np.ndarray, b: np.ndarray) -> bool:
        return b"".join(map(self.b_bytes.__getitem__, b.tolist())) == raw and b"".join(map(self.t.a.token_bytes.__getitem__, a.tolist())) == raw

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
        """Where groups end among the tokens of A and of B (the last token's place), and the groups as text."""
        n, m = len(self.t.a_size), len(self.t.b_size)
        a_end, b_end = np.cumsum(self.t.a_size[a]), np.cumsum(self.t.b_size[b])
        k = np.minimum(np.searchsorted(b_end, a_end), len(b_end) - 1)
        shared = b_end[k] == a_end
        a_last, b_last = np.flatnonzero(shared), k[shared]
        # tokens of A stand before those of B in each group
        a_group = np.cumsum(shared) - shared
        b_ends = np.zeros(len(b), dtype=bool)
        b_ends[b_last] = True
        b_group = np.cumsum(b_ends) - b_ends
        b_before, a_before = np.concatenate(([0], b_last + 1)), a_last + 1
        line = np.empty(len(a) + len(b), dtype=np.int64)
        line[np.arange(len(a)) + b_before[a_group]] = a + n * shared
        line[np.arange(len(b)) + a_before[b_group]] = 2 * n + b + m * b_ends
        return a_last, b_last, "".join(map(self.names.__getitem__, line.tolist()))[:-1]


def aligned(docs: DataFrame, a: ByteBPE, b: Pieces, text: str = "text", exact: str = "exact", odd: str = "odd") -> DataFrame:
    """Adds n_a, n_b, n_groups, groups (``a1,a2|b1;a3|b2,b3``) and the distinct links of each text with their numbers.

    ``exact`` holds links of one-to-one groups with the same bytes as (a, n), ``odd`` all other links as (a, b, n).
    """
    names = ["n_a", "n_b", "n_groups", "groups", exact, odd]
    plain = without(docs, *names)
    kept, content = len(plain.columns), free_name(docs, "_content")
    shape = plain.select("*", *[F.lit(0).cast("long").alias(c) for c in names[:3]], F.lit("").alias("groups"), F.lit(None).cast("array<struct<a:int,n:int>>").alias(exact), F.lit(None).cast("array<struct<a:int,b:int,n:int>>").alias(odd))
    shared = docs.sparkSession.sparkContext.broadcast(Tables.of(a, piece_bpe(b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        left, right, grouper = Encoder(t.a, special=False), PieceEncoder(t.b), Grouper(t)
        for batch in batches:
            for group in text_groups(batch, kept):
                spaced = [[None if not x else " " + x for x in texts] for _, texts in group]
                coded = zip(group, spaced, left.encode(spaced), right.encode([texts for _, texts in group]), strict=True)
                for (part, _), texts, (a_ids, a_at), (b_ids, b_at) in coded:
                    yield pa.RecordBatch.from_arrays([*part.columns[:kept], *_rows(texts, a_ids, a_at, b_ids, b_at, t, grouper)], names=columns)

    def _rows(texts, a_ids, a_at, b_ids, b_at, t: Tables, grouper: Grouper) -> list[pa.Array]:
        counts, lines, same, other = [], [], [], []
        for i, x in enumerate(texts):
            p, q = a_ids[a_at[i] : a_at[i + 1]], b_ids[b_at[i] : b_at[i + 1]]
            if not x or not grouper.reproduced(x.encode(), p, q):
                counts.append((0, 0, 0))
                lines.append("")
                same.append(np.zeros((0, 2), np.int64))
                other.append(np.zeros((0, 3), np.int64))
                continue
            a_last, b_last, line = grouper.groups(p, q)
            la, lb = p[a_last], q[b_last]
            alone = (np.diff(a_last, prepend=-1) == 1) & (np.diff(b_last, prepend=-1) == 1) & (t.same[la] == lb)
            ids, n = np.unique(la[alone], return_counts=True)
            same.append(np.column_stack((ids, n)))
            pairs, n = np.unique(la[~alone].astype(np.int64) << 32 | lb[~alone], return_counts=True)
            other.append(np.column_stack((pairs >> 32, pairs & 0xFFFFFFFF, n)))
            counts.append((len(p), len(q), len(la)))
            lines.append(line)
        numbers = [pa.array([c[j] for c in counts], pa.int64()) for j in range(3)]
        return [*numbers, pa.array(lines, pa.string()), _lists(same, "an"), _lists(other, "abn")]

    def _lists(rows: list[np.ndarray], fields: str) -> pa.Array:
        at, flat = np.cumsum([0, *map(len, rows)]), np.concatenate([*rows, np.zeros((0, len(fields)), np.int64)])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, j], pa.int32()) for j in range(len(fields))], names=list(fields)))

    columns = shape.columns
    return mapped(plain.withColumn(content, F.col(f"`{text}`").cast("string")), run, shape.schema)


def exact_counts(links: DataFrame, size: int, exact: str = "exact") -> DataFrame:
    """(a, n): a vector of the vocabulary's length in each task, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            flat = b.column(0).flatten()
            np.add.at(total, flat.field("a").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False))
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids])], names=["a", "n"])

    return links.select(F.col(f"`{exact}`")).mapInArrow(run, "a int, n long").groupBy("a").agg(F.sum("n").alias("n"))


def odd_counts(links: DataFrame, odd: str = "odd") -> DataFrame:
    """(a, b, n) of the links of all other groups."""
    return links.select(F.explode(F.col(f"`{odd}`")).alias("x")).groupBy("x.a", "x.b").agg(F.sum("x.n").alias("n"))


def align(docs: DataFrame, a: ByteBPE, b: Pieces, text: str = "text", derive: dict | None = None, common: int = COMMON) -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, groups, n_links, n_best and count_sum.

    ``count_sum`` adds up, over the links of a text, how many links of all texts hold the same two ids; ``n_best`` counts the links for which no other
    id of A is linked more often with their id of B.  ``derive`` maps names to columns that take the place of ``groups``
    and ``text``, so that neither is written.
    """
    spark = docs.sparkSession
    docs = without(docs, *[c for c in OWN if c.lower() != text.lower()], *(derive or {}))
    exact, odd, key = (free_name(docs, x) for x in ("_exact", "_odd", "_key"))
    found = aligned(docs, a, b, text, exact, odd).withColumn(key, F.monotonically_increasing_id())
    found = found.withColumns(derive).drop("groups", text) if derive else found
    links = written(found, "links")
    same = identity_map(a, piece_bpe(b))
    vector = np.zeros(len(same), dtype=np.int64)
    for r in exact_counts(links, len(same), exact).collect():  # an entry for each id of A at most
        vector[r["a"]] = r["n"]
    pairs = written(odd_counts(links, odd), "pairs")
    best = np.zeros(1 + max(b.text_of), dtype=np.int64)
    np.maximum.at(best, same[same >= 0], vector[same >= 0])
    for r in pairs.groupBy("b").agg(F.max("n").alias("n")).collect():  # an entry for each id of B at most
        best[r["b"]] = max(best[r["b"]], r["n"])
    often = count_bucket(F.col("n")) >= least_bucket(pairs, common)
    top = pairs.where(often).toPandas()  # at most `common` rows
    packed = (top["a"].to_numpy(np.int64) << 32 | top["b"].to_numpy(np.int64)) if len(top) else np.zeros(0, np.int64)
    order = np.argsort(packed)
    shared = spark.sparkContext.broadcast((vector, same, best, packed[order], top["n"].to_numpy(np.int64)[order] if len(top) else packed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, same, best, packed, counts = shared.value
        for x in batches:
            e, o = x.column(1).flatten(), x.column(2).flatten()
            e_row, o_row = (np.repeat(np.arange(len(x)), x.column(j).value_lengths().to_numpy(zero_copy_only=False)) for j in (1, 2))
            ea, en = (e.field(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in range(2))
            oa, ob, on = (o.field(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in range(3))
            want = oa << 32 | ob
            k = np.minimum(np.searchsorted(packed, want), max(len(packed) - 1, 0))
            seen = packed[k] == want if len(packed) else np.zeros(len(want), dtype=bool)
            c = counts[k[seen]] if len(packed) else np.zeros(0, np.int64)
            rows = np.concatenate((e_row, o_row[seen]))
            number, count, most = np.concatenate((en, on[seen])), np.concatenate((vector[ea], c)), np.concatenate((best[same[ea]], best[ob[seen]]))
            total, top = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            np.add.at(total, rows, number * count)
            np.add.at(top, rows, number * (count == most))
            rest = np.flatnonzero(~seen)
            at = np.searchsorted(o_row[rest], np.arange(len(x) + 1))
            left = pa.StructArray.from_arrays([pa.array(v[rest], pa.int32()) for v in (oa, ob, on)], names=["a", "b", "n"])
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(top), pa.array(total), pa.ListArray.from_arrays(pa.array(at, pa.int32()), left)], names=["key", "n_best", "count_sum", "rest"])

    summed = written(links.select(key, exact, odd).mapInArrow(run, "key long, n_best long, count_sum long, rest array<struct<a:int,b:int,n:int>>"), "summed")
    # what is left are pairs that few links hold
    highest = spark.createDataFrame(pd.DataFrame({"b": np.arange(len(best)), "most": best}), "b int, most long")
    rare = summed.select("key", F.explode("rest").alias("x")).select("key", "x.*").join(pairs.where(~often).withColumnRenamed("n", "c"), ["a", "b"]).join(F.broadcast(highest), "b")
    rare = rare.select("key", F.when(F.col("c") == F.col("most"), F.col("n")).otherwise(0).cast("long").alias("n_best"), (F.col("c") * F.col("n")).alias("count_sum"))
    sums = summed.select("key", "n_best", "count_sum").unionByName(rare).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).withColumnRenamed("key", key)
    out = links.drop(exact, odd).join(sums, key)
    kept = [c for c in links.columns if c not in (exact, odd, key)]
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col("n_groups").alias("n_links"), "n_best", "count_sum")
