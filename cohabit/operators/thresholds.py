"""Datasets in which hosts and microbes pass abundance thresholds, over the whole grid.

A dataset passes threshold t if the taxon's largest abundance there is at least t, so each (taxon, dataset)
is reduced to the number of thresholds it passes.  Histograms over those numbers and
sums from the top then give all counts: one join and one aggregation instead of a row for
each of 900 combinations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohabit.config import THRESHOLDS
from cohabit.operators import deal
from cohabit.schemas import need


def grid(spark: SparkSession, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """(i, threshold), i from 1 in ascending order."""
    return spark.createDataFrame([(i, t) for i, t in enumerate(sorted(thresholds), 1)], "i int, threshold double")


def passed(x: Column, thresholds: Sequence[float]) -> Column:
    """How many of the thresholds a value passes (inclusive); null passes none."""
    out = F.lit(0)
    for i, t in enumerate(sorted(thresholds), 1):
        out = F.when(x >= F.lit(t), F.lit(i)).otherwise(out)
    return out


def levels_of(abundance: DataFrame, ids: DataFrame, thresholds: Sequence[float], label: str | None = None, width: int = 0) -> DataFrame:
    """(acc, tax_id[, label], level): how many thresholds a listed taxon passes in each dataset, where it passes any.

    The rows are dealt by dataset into ``width`` tasks, or as many as they need.
    """
    keys = ["tax_id", *([label] if label else [])]
    level, width = passed(F.col("total_abundance"), thresholds).alias("level"), width or deal.tasks(abundance)
    rows = deal.spread(deal.listed(need(abundance, "acc", *keys, "total_abundance"), ids, keys), width, "acc").select("acc", *keys, level).where("level > 0")
    return rows.repartition(width, "acc").groupBy("acc", *keys).agg(F.max("level").alias("level"))


def _at_least(counts: DataFrame, keys: list[str], level: str, value: str) -> DataFrame:
    """Sums from the top level down."""
    top = Window.partitionBy(*keys).orderBy(F.desc(level)).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn(value, F.sum(value).over(top))


def level_counts(abundance: DataFrame, ids: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """(tax_id, i, n): in how many datasets a listed taxon passes exactly i thresholds."""
    return levels_of(abundance, ids, thresholds).groupBy("tax_id", F.col("level").alias("i")).agg(F.count("*").alias("n"))


def taxon_cells(hist: DataFrame, ids: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """(tax_id, threshold, n) for each of the distinct ids and each threshold, from ``level_counts``."""
    full = ids.crossJoin(F.broadcast(grid(ids.sparkSession, thresholds))).join(hist, ["tax_id", "i"], "left").fillna(0, ["n"])
    return _at_least(full, ["tax_id"], "i", "n").select("tax_id", "threshold", "n")


def threshold_counts(abundance: DataFrame, ids: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """(tax_id, threshold, n) for each listed id and threshold; ids without data count 0."""
    ids = ids.select("tax_id").distinct()
    return taxon_cells(level_counts(abundance, ids, thresholds), ids, thresholds)


def pair_abundances(hosts: DataFrame, microbes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Host and microbe rows that meet in a dataset, restricted to listed ids."""
    h, m = (deal.listed(need(df, "tax_id", "acc", "total_abundance"), pairs.select(F.col(c).alias("tax_id")), ["tax_id"]) for df, c in ((hosts, "host_tax_id"), (microbes, "path_tax_id")))
    h = h.select("acc", F.col("tax_id").alias("host_tax_id"), F.col("total_abundance").alias("host_abundance"))
    m = m.select("acc", F.col("tax_id").alias("path_tax_id"), F.col("total_abundance").alias("path_abundance"))
    width = deal.tasks(hosts, microbes, each=4)  # a row of one side meets several of the other
    return h.repartition(width, "acc").join(m.repartition(width, "acc"), "acc").select("host_tax_id", "path_tax_id", "acc", "host_abundance", "path_abundance")


def joint_counts(hosts: DataFrame, microbes: DataFrame, skeleton: DataFrame, thresholds: Sequence[float] = THRESHOLDS, label: bool = False) -> DataFrame:
    """Datasets in which both members of each pair of ``skeleton`` pass, for every pair of thresholds.

    ``label`` also asks the microbe's ``pathogen_type`` to equal the pair's ``pathogen_root_label``.
    """
    names = ["host_tax_id", "path_tax_id", *(["pathogen_root_label"] if label else [])]
    skeleton, width = skeleton.select(*names).distinct(), deal.tasks(hosts, microbes)
    h = levels_of(hosts, skeleton.select(F.col("host_tax_id").alias("tax_id")).distinct(), thresholds, width=width).withColumnsRenamed({"tax_id": "host_tax_id", "level": "i"})
    ids = skeleton.select(F.col("path_tax_id").alias("tax_id"), *([F.col("pathogen_root_label").alias("pathogen_type")] if label else [])).distinct()
    m = levels_of(microbes, ids, thresholds, "pathogen_type" if label else None, width).withColumnsRenamed({"tax_id": "path_tax_id", "level": "j", "pathogen_type": "pathogen_root_label"})
    hist = h.join(m, "acc").groupBy(*names, "i", "j").agg(F.count("*").alias("n"))
    return pair_cells(hist, skeleton, thresholds)


def joint_levels(hosts: DataFrame, microbes: DataFrame, host_ids: DataFrame, microbe_ids: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """(host_tax_id, path_tax_id, i, j, n): in how many datasets a host passes exactly i and a microbe exactly j thresholds."""
    width = deal.tasks(hosts, microbes)
    h = levels_of(hosts, host_ids, thresholds, width=width).withColumnsRenamed({"tax_id": "host_tax_id", "level": "i"})
    m = levels_of(microbes, microbe_ids, thresholds, width=width).withColumnsRenamed({"tax_id": "path_tax_id", "level": "j"})
    return h.join(m, "acc").groupBy("host_tax_id", "path_tax_id", "i", "j").agg(F.count("*").alias("n"))


def pair_cells(hist: DataFrame, skeleton: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Counts for every pair of ``skeleton`` and every two thresholds, from a histogram over levels (i, j, n) of each pair."""
    names, steps = skeleton.columns, grid(skeleton.sparkSession, thresholds)
    cells = skeleton.crossJoin(F.broadcast(steps.select("i", F.col("threshold").alias("host_threshold")))).crossJoin(F.broadcast(steps.select(F.col("i").alias("j"), F.col("threshold").alias("path_threshold"))))
    full = cells.join(hist, [*names, "i", "j"], "left").fillna(0, ["n"])
    # one exchange by pair serves both sums
    full = full.repartition(*names)
    return _at_least(_at_least(full, [*names, "i"], "j", "n"), [*names, "j"], "i", "n").select(*names, "host_threshold", "path_threshold", F.col("n").alias("both_dataset_count"))


def threshold_summary(hosts: DataFrame, microbes: DataFrame, pairs: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Host, microbe and joint counts of all hosts x all microbes x thresholds x thresholds."""
    h_ids, m_ids = (pairs.select(F.col(c).alias("tax_id")).distinct() for c in ("host_tax_id", "path_tax_id"))
    # both id lists come from the pair list, so the product is the declared output
    skeleton = h_ids.select(F.col("tax_id").alias("host_tax_id")).crossJoin(m_ids.select(F.col("tax_id").alias("path_tax_id")))
    h = threshold_counts(hosts, h_ids, thresholds).toDF("host_tax_id", "host_threshold", "host_dataset_count")
    m = threshold_counts(microbes, m_ids, thresholds).toDF("path_tax_id", "path_threshold", "pathogen_dataset_count")
    both = joint_counts(hosts, microbes, skeleton, thresholds)
    out = both.join(h, ["host_tax_id", "host_threshold"]).join(m, ["path_tax_id", "path_threshold"])
    return out.select("host_tax_id", "path_tax_id", "host_threshold", "path_threshold", "host_dataset_count", "pathogen_dataset_count", "both_dataset_count")


def expected_rows(pairs: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Rows that the summary of the listed hosts and microbes must have."""
    return pairs.agg((F.count_distinct("host_tax_id") * F.count_distinct("path_tax_id") * len(thresholds) ** 2).alias("expected_rows"))


def shared_counts(hosts: DataFrame, microbes: DataFrame, pairs: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """What intersecting the sets of all hosts and all microbes gives (``bitmaps`` keeps the sets), joined by dataset."""
    h, m = (pairs.select(c).distinct() for c in ("host_tax_id", "path_tax_id"))
    return joint_counts(hosts, microbes, h.crossJoin(m), thresholds).withColumnRenamed("both_dataset_count", "num_shared_datasets")


def listed_shared_counts(hosts: DataFrame, microbes: DataFrame, pairs: DataFrame, thresholds: Sequence[float] = THRESHOLDS, dedupe_pairs: bool = False) -> DataFrame:
    """The older form: listed pairs only, microbes of the pair's label only, repeated pairs kept unless ``dedupe_pairs``."""
    names = ["host_tax_id", "path_tax_id", "pathogen_root_label"]
    listed = pairs.select(*names)
    listed = listed.distinct() if dedupe_pairs else listed
    h = threshold_counts(hosts, listed.select(F.col("host_tax_id").alias("tax_id")), thresholds).toDF("host_tax_id", "host_threshold", "num_host_datasets")
    ids = listed.select(F.col("path_tax_id").alias("tax_id"), F.col("pathogen_root_label").alias("pathogen_type")).distinct()
    hist = levels_of(microbes, ids, thresholds, "pathogen_type").groupBy("tax_id", "pathogen_type", F.col("level").alias("i")).agg(F.count("*").alias("n"))
    full = ids.crossJoin(F.broadcast(grid(hosts.sparkSession, thresholds))).join(hist, ["tax_id", "pathogen_type", "i"], "left").fillna(0, ["n"])
    m = _at_least(full, ["tax_id", "pathogen_type"], "i", "n").select(F.col("tax_id").alias("path_tax_id"), F.col("pathogen_type").alias("pathogen_root_label"), F.col("threshold").alias("path_threshold"), F.col("n").alias("num_pathogen_datasets"))
    both = joint_counts(hosts, microbes, listed, thresholds, label=True).withColumnRenamed("both_dataset_count", "num_shared_datasets")
    out = listed.join(both, names).join(h, ["host_tax_id", "host_threshold"]).join(m, ["path_tax_id", "pathogen_root_label", "path_threshold"])
    return out.select(*names, "host_threshold", F.col("path_threshold").alias("pathogen_threshold"), "num_host_datasets", "num_pathogen_datasets", "num_shared_datasets")
