"""Sources and sinks, all through Spark's own readers and writers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import cache
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, union_by_name: bool = False) -> DataFrame:
    """One file, a folder, a glob or several; ``union_by_name`` merges files whose columns differ."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.option("mergeSchema", str(union_by_name).lower()).parquet(*paths)
    return df.select(*columns) if columns else df


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; a column that one lacks is null there."""
    out, *rest = frames
    for df in rest:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def read_with_file(spark: SparkSession, folder: str, to: str = "filename") -> DataFrame:
    """Rows with the path of their file; partition folders are not turned into columns."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    return df.withColumn(to, F.col("_metadata.file_path"))


def read_by_name(spark: SparkSession, path: str) -> DataFrame:
    """SQL over a bare path."""
    return spark.sql(f"SELECT * FROM parquet.`{path}`")


def read_shard(spark: SparkSession, folder: str, column: str, value: object) -> DataFrame:
    """One partition of a partitioned folder; the others are pruned."""
    return spark.read.parquet(folder).where(F.col(column) == F.lit(value))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, by an explicit schema; column names stay as they are."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), rows_per_file: int = 0, mode: str = "errorifexists", compression: str = "zstd", order_by: Sequence[str] = (), rows_per_group: int = 0) -> None:
    """``order_by`` sorts the rows over all files, whose names then follow the order; ``rows_per_group`` bounds the rows of a row group.

    Both together give row groups with narrow, ascending statistics of the first sort key, so that a reader skips all but a few.
    """
    out = (df.orderBy(*order_by) if order_by else df).write.mode(mode).option("compression", compression)
    if rows_per_file:
        out = out.option("maxRecordsPerFile", rows_per_file)
    if rows_per_group:
        out = out.option("parquet.block.row.count.limit", rows_per_group)
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("delimiter", delimiter).csv(path)


def save_table(df: DataFrame, name: str, mode: str = "overwrite", bucket_by: Sequence[str] = (), buckets: int = 0, sort_by: Sequence[str] = ()) -> None:
    """CREATE OR REPLACE TABLE name AS; ``append`` adds to it.

    With ``bucket_by`` the rows are dealt into ``buckets`` by those columns once, as they are written; joins and aggregations by them
    (or by them and others) then need no exchange.
    """
    if bool(bucket_by) != bool(buckets):
        raise ValueError("bucket_by and buckets belong together")
    # one file for each bucket, not one for each bucket and task
    out = (df.repartition(buckets, *bucket_by) if bucket_by else df).write.mode(mode)
    if bucket_by:
        out = out.bucketBy(buckets, *bucket_by)
        out = out.sortBy(*sort_by) if sort_by else out
    out.saveAsTable(name)


def view(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """A named view over a projection."""
    out = df.select(*columns) if columns else df
    out.createOrReplaceTempView(name)
    return out


def update_from(df: DataFrame, other: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """UPDATE df SET c = other.c WHERE the keys are equal; columns that df lacks are added."""
    new = other.select(key, *[F.col(c).alias(f"{c}__new") for c in columns])
    joined = df.join(new, key, "left")
    kept = [F.coalesce(f"{c}__new", c).alias(c) if c in columns else F.col(c) for c in df.columns]
    return joined.select(*kept, *[F.col(f"{c}__new").alias(c) for c in columns if c not in df.columns])


def status(df: DataFrame, what: str = "rows") -> DataFrame:
    """One row: how many rows were loaded."""
    return df.agg(F.concat(F.lit("Loaded "), F.count("*").cast("string"), F.lit(f" {what}")).alias("status"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` named.

    Where neither is set a temporary folder serves on one machine only; on a cluster each executor would
    write to its own disk, so that is refused.
    """
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return at or _own_dir(context.applicationId)


@cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Where the rows of a materialised frame lie, and the scopes that are open, each with the frames it will discard.
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_SCOPES: list[list[DataFrame]] = []


def materialise(df: DataFrame, name: str, done: Sequence[DataFrame] = (), compression: str = "zstd") -> DataFrame:
    """Writes the rows to the shared folder and reads them back, which cuts the lineage; then discards ``done`` and the write's shuffle files."""
    path = scratch(df.sparkSession, name)
    with _shuffles_dropped(df.sparkSession), short_plans(df.sparkSession):
        write_parquet(df, path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    discard(*done)
    return out


def delete(spark: SparkSession, *paths: str) -> None:
    """Deletes folders wherever they are stored."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Deletes the files of materialised frames that nothing reads any more; other frames are left alone."""
    for df in frames:
        if path := _PLACES.pop(df, None):
            delete(df.sparkSession, path)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark drops the shuffle files of the writes inside at their end, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def short_plans(spark: SparkSession, chars: int = 4096) -> Iterator[None]:
    """Jobs inside describe their plans to the driver's listeners in so many characters; literal tables in a plan may be long."""
    key = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(key)
    spark.conf.set(key, str(chars))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs inside hand at most so many rows to Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Discards at its end whatever was materialised inside it, but for the frames given to the function that it yields."""
    mine: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        mine[:] = [x for x in mine if x is not df]
        return df

    _SCOPES.append(mine)
    try:
        yield keep
    finally:
        _SCOPES.pop()
        discard(*mine)
