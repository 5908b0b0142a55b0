"""Sets of datasets as chunked bitmaps: the list form of the threshold grid without lists.

Datasets get dense numbers.  A taxon's datasets at one level are bitmaps of ``CHUNK`` numbers each (Spark's bitmap functions), so
a row holds at most one chunk however many datasets a taxon has.  The levels of a taxon are disjoint and the
set at threshold i is the union of the levels from i on.  Two sets are intersected chunk by chunk: bit-and and bit
count for all pairs of levels of a chunk at once, then sums over chunks and from the top levels down.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohabit.config import THRESHOLDS
from cohabit.operators.ranks import ranked
from cohabit.operators.thresholds import grid, levels_of, pair_cells
from cohabit.schemas import need
from cohabit.sources.io import arrow_rows, materialise

#: Numbers in a chunk: the size of Spark's bitmaps (4 KB).
CHUNK = 32_768
#: Rows of chunks that a task holds unpacked, or side by side, at once.
HELD = 64


def dataset_numbers(*frames: DataFrame) -> DataFrame:
    """(acc, number): 0-based numbers of the datasets of all frames, in their order."""
    every = need(frames[0], "acc")
    for df in frames[1:]:
        every = every.unionByName(need(df, "acc"))
    return ranked(every.where("acc is not null").distinct(), ["acc"], to="number", name="numbers")


def level_sets(abundance: DataFrame, ids: DataFrame, numbers: DataFrame, thresholds: Sequence[float] = THRESHOLDS, label: str | None = None) -> DataFrame:
    """(tax_id[, label], chunk, level, n, bits): the datasets in which a taxon passes exactly ``level`` thresholds."""
    keys = ["tax_id", *([label] if label else [])]
    placed = levels_of(abundance, ids, thresholds, label).join(numbers, "acc")
    one = F.col("number") + 1  # Spark's chunks begin at 1
    placed = placed.select(*keys, "level", (F.bitmap_bucket_number(one) - 1).alias("chunk"), F.bitmap_bit_position(one).alias("bit"))
    # one exchange serves this aggregation and whatever gathers the levels of a chunk
    return placed.repartition(*keys, "chunk").groupBy(*keys, "chunk", "level").agg(F.count("*").alias("n"), F.bitmap_construct_agg("bit").alias("bits"))


def threshold_sets(levels: DataFrame, thresholds: Sequence[float] = THRESHOLDS, keys: Sequence[str] = ("tax_id",)) -> DataFrame:
    """(keys, threshold, chunk, n, bits): the datasets in which a taxon passes each threshold; chunks without any are absent."""
    down = Window.partitionBy(*keys, "chunk").orderBy(F.desc("level"))
    whole = levels.withColumns({"bits": F.bitmap_or_agg("bits").over(down.rowsBetween(Window.unboundedPreceding, 0)), "lower": F.coalesce(F.lead("level").over(down), F.lit(0))})
    steps = whole.select(*keys, "chunk", "bits", F.explode(F.sequence(F.col("lower") + 1, F.col("level"))).alias("i"))
    out = steps.join(F.broadcast(grid(levels.sparkSession, thresholds)), "i")
    return out.select(*keys, "threshold", "chunk", F.bitmap_count("bits").alias("n"), "bits")


def members(sets: DataFrame, to: str = "members") -> DataFrame:
    """``bits`` as the ascending numbers that they hold (a chunk at most)."""
    kept = [c for c in sets.columns if c != "bits"]

    return sets.mapInArrow(lambda batches: _numbers(batches, kept, to), sets.select(*kept, F.array().cast("array<long>").alias(to)).schema)


def _numbers(batches: Iterator[pa.RecordBatch], kept: Sequence[str], to: str) -> Iterator[pa.RecordBatch]:
    """A few chunks at a time: a chunk of 4 KB may hold 256 KB of numbers."""
    for whole in batches:
        for k in range(0, len(whole), HELD):
            b = whole.slice(k, HELD)
            bits = np.unpackbits(np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint8), bitorder="little").reshape(len(b), CHUNK)
            row, bit = np.nonzero(bits)
            number = bit + b.column("chunk").to_numpy()[row] * CHUNK
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(b) + 1)), pa.int32()), pa.array(number, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], lists], names=[*kept, to])


def _counted(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows of two chunks (h and m: lists of level and bits) to the size of each intersection of their levels."""
    words = lambda x: np.frombuffer(b"".join(x), np.uint64).reshape(len(x), -1)
    for b in batches:
        rows, found = [], []
        for k, (h, m) in enumerate(zip(b.column("h").to_pylist(), b.column("m").to_pylist(), strict=True)):
            other = words([x["bits"] for x in m])
            n = np.stack([np.bitwise_count(one & other).sum(1, dtype=np.int64) for one in words([x["bits"] for x in h])])
            i, j = np.nonzero(n)
            rows.append(np.full(len(i), k))
            found.append(np.column_stack((np.array([x["level"] for x in h])[i], np.array([x["level"] for x in m])[j], n[i, j])))
        at, flat = pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)), np.concatenate([*found, np.zeros((0, 3), np.int64)])
        yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in names], pa.array(flat[:, 0], pa.int32()), pa.array(flat[:, 1], pa.int32()), pa.array(flat[:, 2], pa.int64())], names=[*names, "i", "j", "n"])


def shared_counts(hosts: DataFrame, microbes: DataFrame, pairs: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Sizes of the intersections of two ``level_sets`` for every pair and every two thresholds.

    ``pairs`` has host_tax_id, path_tax_id and, where the microbes' sets are kept by ``pathogen_type``, pathogen_root_label.
    """
    names = ["host_tax_id", "path_tax_id", *(["pathogen_root_label"] if "pathogen_root_label" in pairs.columns else [])]
    skeleton = pairs.select(*names).distinct()
    packed = lambda sets, *keys: sets.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list(F.struct("level", "bits"))).alias("sets"))  # noqa: E731  a row for each threshold at most
    h = packed(hosts, "tax_id").withColumnsRenamed({"tax_id": "host_tax_id", "sets": "h"})
    m = packed(microbes, "tax_id", *(["pathogen_type"] if len(names) > 2 else [])).withColumnsRenamed({"tax_id": "path_tax_id", "pathogen_type": "pathogen_root_label", "sets": "m"})
    both = skeleton.join(h, "host_tax_id").join(m, [*names[1:], "chunk"]).select(*names, "h", "m")
    shape = both.select(*names, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).cast("long").alias("n")).schema
    counted = both.mapInArrow(lambda batches: _counted(batches, names), shape).groupBy(*names, "i", "j").agg(F.sum("n").alias("n"))
    with arrow_rows(pairs.sparkSession, HELD):
        hist = materialise(counted, "shared")
    return pair_cells(hist, skeleton, thresholds).withColumnRenamed("both_dataset_count", "num_shared_datasets")


def listed_shared_counts(hosts: DataFrame, microbes: DataFrame, pairs: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """The list form for listed pairs: sizes of both sets and of their intersection; microbes of the pair's label only, repeated pairs kept."""
    names, label = ["host_tax_id", "path_tax_id", "pathogen_root_label"], "pathogen_type"
    listed = pairs.select(*names)
    numbers = dataset_numbers(hosts, microbes)
    h = materialise(level_sets(hosts, listed.select(F.col("host_tax_id").alias("tax_id")).distinct(), numbers, thresholds), "host-sets")
    m_ids = listed.select(F.col("path_tax_id").alias("tax_id"), F.col("pathogen_root_label").alias(label)).distinct()
    m = materialise(level_sets(microbes, m_ids, numbers, thresholds, label), "microbe-sets")
    sized = lambda sets, keys: threshold_sets(sets, thresholds, keys).groupBy(*keys, "threshold").agg(F.sum("n").alias("n"))
    hn = sized(h, ["tax_id"]).withColumnsRenamed({"tax_id": "host_tax_id", "threshold": "host_threshold", "n": "num_host_datasets"})
    mn = sized(m, ["tax_id", label]).withColumnsRenamed({"tax_id": "path_tax_id", label: "pathogen_root_label", "threshold": "path_threshold", "n": "num_pathogen_datasets"})
    both = listed.join(shared_counts(h, m, listed, thresholds), names)
    out = both.join(hn, ["host_tax_id", "host_threshold"], "left").join(mn, [*names[1:], "path_threshold"], "left").fillna(0, ["num_host_datasets", "num_pathogen_datasets"])
    return out.select(*names, "host_threshold", F.col("path_threshold").alias("pathogen_threshold"), "num_host_datasets", "num_pathogen_datasets", "num_shared_datasets")
