"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohabit.sources.io import arrow_rows, discard, materialise, scope, scratch  # noqa: F401

#: Rows that jobs of this subpackage hand to Python at once: whole texts stand in them.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """Cuts the lineage: writes the rows as Parquet to the shared folder and reads them back.  Frames of ``done`` are deleted then."""
    with arrow_rows(df.sparkSession, ARROW_ROWS):
        return materialise(df, name, done, compression="snappy")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores added until no input column has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def without(df: DataFrame, *names: str) -> DataFrame:
    """The input without columns that an operator is about to add (output names win)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` for functions that take columns by place: names (which may hold dots) don't matter to it."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, schema)


def count_bucket(n: Column) -> Column:
    """Logarithmic bucket of a count, eight for each doubling: a few hundred at most, exact up to 11."""
    return F.floor(F.log2(n) * 8).cast("int")


def least_bucket(counts: DataFrame, most: int, n: str = "n") -> int:
    """The smallest bucket from which on there are at most ``most`` rows: the largest counts without a sort."""
    sizes = sorted(map(tuple, counts.groupBy(count_bucket(F.col(n)).alias("b")).count().collect()), reverse=True)
    least, total = 1 << 10, 0
    for b, size in sizes:
        total += size
        if total > most:
            break
        least = b
    return least
