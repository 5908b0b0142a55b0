"""Sparse coordinate matrix: dense indices of keys, and the entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohabit.operators.ranks import ranked
from cohabit.schemas import need


def dense_index(df: DataFrame, key: str, to: str = "idx") -> DataFrame:
    """0-based index of the distinct keys in their order, without a global window."""
    return ranked(df.select(key).distinct(), [key], to=to)


def both_indices(df: DataFrame, row: str = "acc", col: str = "tax_id") -> DataFrame:
    """(axis, row, col, idx): dense indices of the distinct keys of both axes, from one pass over the rows."""
    ends = F.array(F.struct(F.lit("row").alias("axis"), F.col(row), F.lit(None).cast(df.schema[col].dataType).alias(col)), F.struct(F.lit("col").alias("axis"), F.lit(None).cast(df.schema[row].dataType).alias(row), F.col(col)))
    keys = df.select(F.explode(ends).alias("x")).select("x.*").distinct()
    return ranked(keys, [row, col], ["axis"], "idx")


def to_coo(abundance: DataFrame) -> DataFrame:
    """(row_idx, col_idx, value) for each row with a value above 0; every id has an index, also where no value is."""
    rows = need(abundance, "acc", "tax_id", "total_abundance")
    index = both_indices(rows)
    of = lambda axis, key, to: index.where(F.col("axis") == axis).select(key, F.col("idx").alias(to))
    found = rows.where("total_abundance > 0").join(of("row", "acc", "row_idx"), "acc").join(of("col", "tax_id", "col_idx"), "tax_id")
    return found.select("row_idx", "col_idx", F.col("total_abundance").alias("value"))
