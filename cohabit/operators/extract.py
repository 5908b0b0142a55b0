"""Abundance of listed pairs in their listed datasets, and those datasets' metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohabit.operators.prefilter import hash_bitmap, may_hold
from cohabit.schemas import need


def exploded(pairs: DataFrame, interaction: str | None = None) -> DataFrame:
    """(host_tax_id, microbe_tax_id, acc), one row per listed dataset."""
    chosen = pairs.where(F.col("interaction_type") == interaction) if interaction else pairs
    return need(chosen, "host_tax_id", "microbe_tax_id", "SRA_datasets").select("host_tax_id", "microbe_tax_id", F.explode("SRA_datasets").alias("acc"))


def unique_accessions(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.size("SRA_datasets") > 0).select(F.explode("SRA_datasets").alias("acc")).distinct()


def pair_abundance(pairs: DataFrame, abundance: DataFrame, interaction: str | None = None) -> DataFrame:
    """Largest abundance of host and microbe of each pair in each listed dataset, where either is known."""
    wanted = exploded(pairs, interaction).distinct()
    # one row for each member, so that the join's keys are dataset and taxon
    roles = F.array(*[F.struct(F.lit(c).alias("role"), F.col(c).alias("tax_id")) for c in ("host_tax_id", "microbe_tax_id")])
    members = wanted.select("host_tax_id", "microbe_tax_id", "acc", F.explode(roles).alias("member")).select("host_tax_id", "microbe_tax_id", "acc", "member.*")
    keys = ["acc", "tax_id"]
    # of the abundance table only rows that some pair may ask for reach a shuffle
    found = may_hold(need(abundance, *keys, "total_abundance").where("total_abundance is not null"), hash_bitmap(members, keys), keys)
    best = found.groupBy(*keys).agg(F.max("total_abundance").alias("x"))
    both = members.join(best, ["acc", "tax_id"])
    of = lambda role: F.max(F.when(F.col("role") == role, F.col("x")))
    rows = both.groupBy("host_tax_id", "microbe_tax_id", "acc").agg(of("host_tax_id").alias("host_abundance"), of("microbe_tax_id").alias("microbe_abundance"))
    return rows.select("host_tax_id", "microbe_tax_id", "host_abundance", "microbe_abundance", F.col("acc").alias("SRA_accession"))


def pair_abundance_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("n_rows"), F.count_distinct("host_tax_id").alias("n_hosts"), F.count_distinct("microbe_tax_id").alias("n_microbes"), F.count_distinct("SRA_accession").alias("n_accessions"),
        F.avg("host_abundance").alias("avg_host_abundance"), F.avg("microbe_abundance").alias("avg_microbe_abundance"),
    )


def accession_metadata(pairs: DataFrame, meta: DataFrame, with_pairs: bool = False) -> DataFrame:
    """Metadata rows, all columns untouched, of every listed dataset; ``with_pairs`` gives a row per pair."""
    wanted = unique_accessions(pairs)
    near = may_hold(meta, hash_bitmap(wanted, ["acc"]), ["acc"])
    if with_pairs:
        return near.join(exploded(pairs).distinct(), "acc")
    return near.join(wanted, "acc", "left_semi")


def metadata_summary(rows: DataFrame) -> DataFrame:
    """Rows, datasets and pairs of metadata that was joined with its pairs."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct("acc").alias("n_accessions"), F.count_distinct("host_tax_id", "microbe_tax_id").alias("n_pairs"))
