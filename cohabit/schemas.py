"""Explicit schemas of the text inputs, and a check for the columns an operator needs."""

from __future__ import annotations

from pyspark.sql import DataFrame

ABUNDANCE = "acc string, tax_id bigint, total_abundance double"
HOST = "tax_id bigint, acc string, total_abundance double"
MICROBE = HOST + ", pathogen_type string"
PAIRS = "host_tax_id bigint, path_tax_id bigint, pathogen_root_label string, Host_Name string, Pathogen_Name string"
PAIR_META = PAIRS + ", Interaction_type string"
PAIR_LISTS = "host_tax_id bigint, microbe_tax_id bigint, SRA_datasets array<string>"
SUMMARY = "host_tax_id bigint, path_tax_id bigint, host_threshold double, path_threshold double, host_dataset_count bigint, pathogen_dataset_count bigint, both_dataset_count bigint"
COMPARISON = "comparison string, pos_class string, neg_class string"


def need(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns only; says which are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)} (there are {', '.join(df.columns)})")
    return df.select(*columns)
