"""Exact positions within ordered groups, without a window over a whole group.

Rows are range-partitioned by group and order and written once (the ranges come from a sample, so they must not be drawn
twice).  Row numbers inside a range come from the write itself; a group's rows in the ranges before are
added from a table with one row per group and range.  So a group of any size is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohabit.sources.io import materialise

#: ``monotonically_increasing_id`` holds the partition above this many bits.
_ROW_BITS = 33


def sorted_rows(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), at: str = "_at", name: str = "sorted", done: Sequence[DataFrame] = ()) -> DataFrame:
    """The rows, written in the order of ``by`` and ``order``; ``at`` ascends with it and holds range and row."""
    keys = [F.col(c).asc_nulls_first() for c in by] + [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order]
    return materialise(df.orderBy(*keys).withColumn(at, F.monotonically_increasing_id()), name, done)


def range_of(at: str = "_at") -> Column:
    return F.shiftright(F.col(at), _ROW_BITS)


def before(parts: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Per group and range (``_part``): for each of ``sums``, what lies in the group's earlier ranges (``<name>_before``) and in the whole group (``<name>_all``).

    Group and range get names of their own, for ``join_parts``.
    """
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    summed = {f"{c}_before": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in sums} | {f"{c}_all": F.sum(c).over(whole) for c in sums}
    return parts.withColumns(summed).withColumnsRenamed({"_part": "_its_part"} | {c: f"_by{i}" for i, c in enumerate(by)})


def join_parts(rows: DataFrame, parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows (with ``_part``) and what ``before`` knows of their group and range; null groups are groups."""
    on = F.col("_part") == F.col("_its_part")
    for i, c in enumerate(by):
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(f"_by{i}"))
    return rows.join(parts, on)


def ranked(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), to: str = "rank", total: str | None = None, name: str = "ranks", done: Sequence[DataFrame] = ()) -> DataFrame:
    """Adds ``to``, the 0-based position of each row in its group (null groups are groups), and ``total``, the group's rows."""
    rows = sorted_rows(df, order, by, name=name, done=done).withColumn("_part", range_of())
    parts = before(rows.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")), by, ["_n"])
    added = [(F.col("_at") - F.col("_first") + F.col("_n_before")).alias(to), *([F.col("_n_all").alias(total)] if total else [])]
    return join_parts(rows, parts, by).select(*[F.col(f"`{c}`") for c in df.columns], *added)
