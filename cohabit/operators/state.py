"""Threshold counts that grow by batches of new datasets.

What a batch adds is a histogram: how many of its datasets a taxon, or a pair, passes exactly i (and j) thresholds in.
Histograms of disjoint datasets add up, and the sums from the top levels down that give the counts are taken on reading; so a new batch
never reads what is stored but the names of the datasets seen, and those of earlier batches are left out of it.
A batch of a name that is stored already takes its place, so that it may be run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohabit.config import THRESHOLDS
from cohabit.operators.thresholds import joint_levels, level_counts, pair_cells, taxon_cells
from cohabit.schemas import need
from cohabit.sources.io import write_parquet

#: Tables of a state with their keys.
TABLES = {"hosts": ["tax_id", "i"], "microbes": ["tax_id", "i"], "pairs": ["host_tax_id", "path_tax_id", "i", "j"]}

State = dict[str, DataFrame]


def _ids(pairs: DataFrame, column: str) -> DataFrame:
    return pairs.select(F.col(column).alias("tax_id")).distinct()


def batch_state(hosts: DataFrame, microbes: DataFrame, pairs: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> State:
    """Histograms of the listed hosts, microbes, and all pairs of them over these datasets."""
    h, m = _ids(pairs, "host_tax_id"), _ids(pairs, "path_tax_id")
    return {"hosts": level_counts(hosts, h, thresholds), "microbes": level_counts(microbes, m, thresholds), "pairs": joint_levels(hosts, microbes, h, m, thresholds)}


def merged(*states: State) -> State:
    """Sums of the states of disjoint datasets."""
    out = {}
    for table, keys in TABLES.items():
        first, *rest = [s[table] for s in states]
        for df in rest:
            first = first.unionByName(df)
        out[table] = first.groupBy(*keys).agg(F.sum("n").alias("n"))
    return out


def _stored(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}")
    return spark.read.parquet(f"{folder}/{table}") if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def append_batch(folder: str, batch: str, hosts: DataFrame, microbes: DataFrame, pairs: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> None:
    """Stores what the datasets add that no other batch holds."""
    spark = hosts.sparkSession
    names = need(hosts, "acc").unionByName(need(microbes, "acc")).where("acc is not null").distinct()
    if (stored := _stored(spark, folder, "datasets")) is not None:
        seen = stored.where(F.col("batch") != batch).select("acc")
        hosts, microbes, names = (df.join(seen, "acc", "left_anti") for df in (hosts, microbes, names))
    # the names last: a batch counts as seen once all of it is stored
    for table, df in (batch_state(hosts, microbes, pairs, thresholds) | {"datasets": names}).items():
        write_parquet(df, f"{folder}/{table}/batch={batch}", mode="overwrite")


def read_state(spark: SparkSession, folder: str) -> State:
    """Sums over all stored batches."""
    return merged({table: spark.read.parquet(f"{folder}/{table}").select(*keys, "n") for table, keys in TABLES.items()})


def threshold_summary(state: State, pairs: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """What ``thresholds.threshold_summary`` gives for all datasets of the state."""
    ids = [_ids(pairs, c) for c in ("host_tax_id", "path_tax_id")]
    skeleton = ids[0].toDF("host_tax_id").crossJoin(ids[1].toDF("path_tax_id"))
    h = taxon_cells(state["hosts"], ids[0], thresholds).toDF("host_tax_id", "host_threshold", "host_dataset_count")
    m = taxon_cells(state["microbes"], ids[1], thresholds).toDF("path_tax_id", "path_threshold", "pathogen_dataset_count")
    out = pair_cells(state["pairs"], skeleton, thresholds).join(h, ["host_tax_id", "host_threshold"]).join(m, ["path_tax_id", "path_threshold"])
    return out.select("host_tax_id", "path_tax_id", "host_threshold", "path_threshold", "host_dataset_count", "pathogen_dataset_count", "both_dataset_count")
