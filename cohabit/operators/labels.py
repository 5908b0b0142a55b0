"""Interaction labels of pairs: duplicates, priority, balanced sample, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohabit.config import PRIORITY

PAIR = ["host_tax_id", "path_tax_id"]


def duplicate_pairs(meta: DataFrame, keys: Sequence[str] = ("host_tax_id", "path_tax_id", "Interaction_type")) -> DataFrame:
    return meta.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def resolve_labels(meta: DataFrame, priority: Sequence[str] = PRIORITY) -> DataFrame:
    """One label per pair: the first in ``priority``, others after it by name."""
    place = F.nullif(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("Interaction_type")), F.lit(0))
    best = Window.partitionBy(*PAIR).orderBy(place.asc_nulls_last(), F.col("Interaction_type").asc_nulls_last())
    return meta.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").select(*PAIR, "Interaction_type")


def attach_labels(df: DataFrame, labels: DataFrame, missing: str = "Random") -> DataFrame:
    return df.join(labels, PAIR, "left").fillna(missing, ["Interaction_type"])


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("Interaction_type").agg(F.count("*").alias("n"))


def sample_pairs(df: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """At most n pairs of each label: those with the smallest md5 of seed, label and pair."""
    dice = F.md5(F.concat_ws("|", F.lit(seed), "Interaction_type", *PAIR))
    first = Window.partitionBy("Interaction_type").orderBy(dice, *PAIR)
    pairs = df.select(*PAIR, "Interaction_type").distinct()
    return pairs.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= n).drop("_rank")


def sampled_rows(df: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """All rows of the sampled pairs."""
    return df.join(sample_pairs(df, n, seed), [*PAIR, "Interaction_type"])


def coverage_report(meta: DataFrame, data: DataFrame, path_data: DataFrame | None = None) -> DataFrame:
    """For hosts and microbes: ids in both inputs, and in one only.  ``path_data`` holds the microbes where they are apart from the hosts."""
    out = []
    for key, seen in zip(PAIR, (data, data if path_data is None else path_data), strict=True):
        m, d = meta.select(key).distinct(), seen.select(key).distinct()
        both = m.withColumn("_m", F.lit(1)).join(d.withColumn("_d", F.lit(1)), key, "full")
        has = lambda c: F.count(c)
        out.append(both.agg(F.lit(key).alias("key"), has("_m").alias("in_meta"), has("_d").alias("in_data"), F.count_if(F.col("_d").isNull()).alias("only_meta"), F.count_if(F.col("_m").isNull()).alias("only_data")))
    return out[0].unionByName(out[1])
