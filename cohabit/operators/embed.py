"""Random-projection embeddings of taxa and datasets.  Rows with a null abundance, or without the other id, add nothing.

The sign of dimension i for a key is a hex digit of md5(key # block): 32 dimensions per block, below 8
is -1.  So signs need no table and are the same for any partitioning.  Each task makes the signs of the
distinct keys of a slice of rows as a matrix and adds up whole vectors; rows never become one row per dimension before they are sums.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohabit.schemas import need

#: Rows whose signed values are held as a matrix at once, and bytes of sums that a task holds before it passes them on.
SLICE, HELD_BYTES = 2048, 32 << 20
#: Cells of a matrix of keys and others for each row, up to which a product is cheaper than sums of rows.
DENSE = 32


def _signature(key: Column, dims: int) -> Column:
    blocks = [F.md5(F.concat(key.cast("string"), F.lit(f"#{b}"))) for b in range(-(-dims // 32))]
    return F.substring(F.concat(*blocks), 1, dims)


def sign_table(df: DataFrame, key: str, dims: int = 512) -> DataFrame:
    """(key, dim, sign) of the distinct keys."""
    digits = F.split(_signature(F.col(key), dims), "")
    long = df.select(key).distinct().select(key, F.posexplode(F.slice(digits, 1, dims)).alias("dim", "digit"))
    return long.select(key, "dim", F.when(F.col("digit") < "8", -1).otherwise(1).alias("sign"))


def signs(keys: list[str], dims: int) -> np.ndarray:
    """A row of 1 and -1 for each key: the upper bit of every hex digit of its md5 blocks."""
    blocks = range(-(-dims // 32))
    raw = np.frombuffer(b"".join(hashlib.md5(f"{k}#{b}".encode()).digest() for k in keys for b in blocks), np.uint8).reshape(len(keys), len(blocks) * 16)
    up = np.empty((len(keys), len(blocks) * 32), dtype=bool)
    up[:, 0::2], up[:, 1::2] = raw & 0x80, raw & 0x08
    return np.where(up[:, :dims], 1.0, -1.0)


def _signed(b: pa.RecordBatch, dims: int) -> np.ndarray:
    """x times the signs of the other id, a row for each row of (key, other, x)."""
    other = b.column(1).dictionary_encode()
    return b.column(2).to_numpy(zero_copy_only=False)[:, None] * signs(other.dictionary.to_pylist(), dims)[other.indices.to_numpy()]


def _sums(keys: pa.Array, totals: np.ndarray, over: float = 1.0) -> pa.RecordBatch:
    n, dims = totals.shape
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dims, pa.int32()), pa.array(((totals + 0.0) / over).ravel()))
    return pa.RecordBatch.from_arrays([keys, lists], names=["key", "sums"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, len(b), SLICE):
            yield b.slice(i, SLICE)


def _key_sums(b: pa.RecordBatch, dims: int) -> tuple[list, np.ndarray]:
    """Distinct keys of (key, other, x) and the sum of each: one product of matrices where keys and others repeat, else sums of sorted rows."""
    keys, other = b.column(0).dictionary_encode(null_encoding="encode"), b.column(1).dictionary_encode()
    at, to, x = keys.indices.to_numpy(), other.indices.to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
    t, u = len(keys.dictionary), len(other.dictionary)
    if t * u <= DENSE * len(b):
        return keys.dictionary.to_pylist(), np.bincount(at.astype(np.int64) * u + to, x, t * u).reshape(t, u) @ signs(other.dictionary.to_pylist(), dims)
    order = np.argsort(at, kind="stable")
    starts = np.flatnonzero(np.diff(at[order], prepend=-1))
    return [keys.dictionary[k].as_py() for k in at[order][starts].tolist()], np.add.reduceat(_signed(b, dims)[order], starts)


def _accumulated(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Sums of each key in a task, in one dense matrix that is passed on when it reaches its bound."""
    place: dict[object, int] = {}
    totals, kind = np.zeros((16, dims)), None
    for b in _slices(batches):
        kind = b.schema.field(0).type
        keys, sums = _key_sums(b, dims)
        mine = np.array([place.setdefault(k, len(place)) for k in keys])
        if len(place) > len(totals):
            totals = np.vstack((totals, np.zeros((max(len(totals), len(place) - len(totals)), dims))))
        totals[mine] += sums
        if totals.nbytes >= HELD_BYTES:
            yield _sums(pa.array(list(place), kind), totals[: len(place)])
            place, totals = {}, np.zeros((16, dims))
    if place:
        yield _sums(pa.array(list(place), kind), totals[: len(place)])


def _run_sums(batches: Iterator[pa.RecordBatch], summed: Callable[[pa.RecordBatch, np.ndarray], np.ndarray], over: float) -> Iterator[pa.RecordBatch]:
    """Sums of each run of equal keys, divided by ``over``; runs may go on in the next batch.  ``summed`` adds up a batch's runs, of which it gets the starts."""
    held: tuple[pa.Array, np.ndarray] | None = None
    for b in _slices(batches):
        at = b.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        totals, keys = summed(b, starts), b.column(0).take(pa.array(starts))
        if held is not None:
            if held[0].equals(keys.slice(0, 1)):
                totals[0] += held[1][0]
            else:
                yield _sums(*held, over)
        if len(keys) > 1:
            yield _sums(keys.slice(0, len(keys) - 1), totals[:-1], over)
        held = keys.slice(len(keys) - 1), totals[-1:].copy()
    if held is not None:
        yield _sums(*held, over)


def _rows(abundance: DataFrame, key: str, other: str) -> DataFrame:
    rows = need(abundance, key, other, "total_abundance").where(F.col("total_abundance").isNotNull() & F.col(other).isNotNull())
    return rows.select(F.col(key).alias("key"), F.col(other).cast("string").alias("other"), F.col("total_abundance").cast("double").alias("x"))


def _named(sums: DataFrame, key: str) -> DataFrame:
    return sums.select(F.col("key").alias(key), F.col("sums").alias("embedding"))


def taxon_vectors(abundance: DataFrame, dims: int = 512) -> DataFrame:
    """(tax_id, embedding): sum over the datasets of x * sign(acc, i) / sqrt(dims), as one array.

    A taxon may hold a large share of all rows, so each task adds up its part of every taxon; one vector per
    taxon and task is shuffled.
    """
    rows = _rows(abundance, "tax_id", "acc")
    shape = rows.select("key", F.array().cast("array<double>").alias("sums")).schema
    parts = rows.mapInArrow(lambda b: _accumulated(b, dims), shape).repartition("key").sortWithinPartitions("key")
    whole = lambda b, starts: np.add.reduceat(b.column(1).flatten().to_numpy().reshape(len(b), dims), starts)
    return _named(parts.mapInArrow(lambda b: _run_sums(b, whole, math.sqrt(dims)), shape), "tax_id")


def dataset_vectors(abundance: DataFrame, dims: int = 512, clustered: bool = False) -> DataFrame:
    """(acc, embedding): sum over the taxa of x * sign(tax_id, i) / sqrt(dims), as one array.

    Rows are dealt by dataset and added up as they stream by.  ``clustered`` says that they are so dealt already (a
    table bucketed by acc), which saves the shuffle.
    """
    rows = _rows(abundance, "acc", "tax_id")
    dealt = rows if clustered else rows.repartition("key")
    shape = rows.select("key", F.array().cast("array<double>").alias("sums")).schema
    sums = dealt.sortWithinPartitions("key", "other", "x").mapInArrow(lambda b: _run_sums(b, lambda x, _: _key_sums(x, dims)[1], math.sqrt(dims)), shape)
    return _named(sums, "acc")


def _long(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.select(key, F.posexplode("embedding").alias("dim", "value"))


def taxon_embeddings(abundance: DataFrame, dims: int = 512) -> DataFrame:
    """``taxon_vectors`` in long form: (tax_id, dim, value)."""
    return _long(taxon_vectors(abundance, dims), "tax_id")


def dataset_embeddings(abundance: DataFrame, dims: int = 512, clustered: bool = False) -> DataFrame:
    """``dataset_vectors`` in long form: (acc, dim, value)."""
    return _long(dataset_vectors(abundance, dims, clustered), "acc")


def as_vectors(long: DataFrame, key: str) -> DataFrame:
    """(key, embedding): the long form as one array of floats per key."""
    found = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("all"))
    return found.select(key, F.transform("all", lambda s: s["value"].cast("float")).alias("embedding"))


def as_columns(vectors: DataFrame, key: str, dims: int) -> DataFrame:
    """emb_0, emb_1, ... for a sink that wants columns."""
    return vectors.select(key, *[F.get("embedding", F.lit(i)).alias(f"emb_{i}") for i in range(dims)])


def taxa_ids(abundance: DataFrame) -> DataFrame:
    return abundance.select("tax_id").distinct()
