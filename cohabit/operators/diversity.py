"""Alpha diversity of each dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohabit.schemas import need


def alpha_diversity(abundance: DataFrame, prefix_len: int = 3, clustered: bool = False) -> DataFrame:
    """Richness, Shannon, Simpson, Pielou and Berger-Parker of each dataset, with a prefix to partition by.

    ``shannon`` and ``pielou_evenness`` are the sums of p ln p, so negative; ``shannon_entropy`` and ``pielou_j``
    have the usual sign.  Both aggregations share one shuffle, by dataset; ``clustered`` says that the rows are
    dealt by dataset already (a table bucketed by acc), which saves it.
    """
    clean = need(abundance, "acc", "tax_id", "total_abundance").where("total_abundance > 0")
    clean = clean if clustered else clean.repartition("acc")
    taxa = clean.groupBy("acc", "tax_id").agg(F.sum(F.col("total_abundance").cast("double")).alias("x"))
    x, t, a, b = (F.col(c) for c in ("x", "t", "a", "b"))
    sums = taxa.groupBy("acc").agg(F.sum(x).alias("t"), F.sum(x * F.ln(x)).alias("a"), F.sum(x * x).alias("b"), F.max(x).alias("m"), F.count("*").alias("richness"))
    shannon = a / t - F.ln(t)
    even = F.when(F.col("richness") > 1, shannon / F.ln(F.col("richness").cast("double")))
    return sums.select(
        "acc", "richness", shannon.alias("shannon"), (1 - b / (t * t)).alias("simpson_1_minus_D"), (t * t / b).alias("inverse_simpson"), even.alias("pielou_evenness"),
        (F.col("m") / t).alias("berger_parker_dominance"), F.substring("acc", 1, prefix_len).alias("acc_prefix"), (-shannon).alias("shannon_entropy"), (-even).alias("pielou_j"),
    )
