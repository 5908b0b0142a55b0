"""The study's queries over the fixture views, one for each operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohabit.config import Study
from cohabit.operators import bitmaps, diversity, embed, evaluate, extract, labels, matrix, scores, state, thresholds
from cohabit.sources import io
from cohabit.sources.fixtures import frames, population

STUDY = Study()


def _rounded(df: DataFrame, digits: int = 6, exact: bool = False, **other: int) -> DataFrame:
    """Rounds sums and logarithms.  Ratios of counts may be ties at any number of digits and are equal in both engines as they are: ``exact`` leaves all but the columns of ``other``."""
    kept = lambda c, t: t != "double" or (exact and c not in other)
    return df.select(*[F.col(c) if kept(c, t) else F.round(c, other.get(c, digits)).alias(c) for c, t in df.dtypes])


def _whole_millionths(x: Column) -> Column:
    """Sums over a root are never ties, so plain arithmetic rounds them as the decimals of ``round`` do, at a small part of its cost."""
    return F.rint(x * 1_000_000)


def alpha_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(diversity.alpha_diversity(frames(spark, sf_dir)["fx_abundance"], 5), 9)


def host_threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = frames(spark, sf_dir)
    return thresholds.threshold_counts(fx["fx_host"], fx["fx_meta"].select(F.col("host_tax_id").alias("tax_id")))


def microbe_threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = frames(spark, sf_dir)
    return thresholds.threshold_counts(fx["fx_microbe"], fx["fx_meta"].select(F.col("path_tax_id").alias("tax_id")))


def pair_abundances(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = frames(spark, sf_dir)
    rows = thresholds.pair_abundances(fx["fx_host"], fx["fx_microbe"], fx["fx_meta"])
    return rows.groupBy("host_tax_id", "path_tax_id").agg(F.count("*").alias("n_rows"), F.count_distinct("acc").alias("n_acc"), F.round(F.max("host_abundance"), 6).alias("max_host"), F.round(F.max("path_abundance"), 6).alias("max_path"))


def joint_threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = frames(spark, sf_dir)
    hosts, microbes = (fx["fx_meta"].select(c).distinct() for c in ("host_tax_id", "path_tax_id"))
    return thresholds.joint_counts(fx["fx_host"], fx["fx_microbe"], hosts.crossJoin(microbes))


def threshold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = frames(spark, sf_dir)
    return thresholds.threshold_summary(fx["fx_host"], fx["fx_microbe"], fx["fx_meta"])


def threshold_summary_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stored state: the datasets arrive in three batches, and one batch arrives again."""
    fx = frames(spark, sf_dir)
    folder, third = io.scratch(spark, "state"), F.pmod(F.crc32("acc"), F.lit(3))
    for batch, which in (("base", 0), ("second", 1), ("third", 2), ("second", 1)):
        state.append_batch(folder, batch, fx["fx_host"].where(third == which), fx["fx_microbe"].where(third == which), fx["fx_meta"])
    out = io.materialise(state.threshold_summary(state.read_state(spark, folder), fx["fx_meta"]), "summary")
    io.delete(spark, folder)
    return out


def clustered_alpha_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a table bucketed by dataset: no exchange after the write."""
    name = f"abundance_{uuid.uuid4().hex}"
    io.save_table(frames(spark, sf_dir)["fx_abundance"], name, bucket_by=["acc"], buckets=16, sort_by=["acc", "tax_id"])
    out = io.materialise(_rounded(diversity.alpha_diversity(spark.table(name), 5, clustered=True), 9), "diversity")
    spark.sql(f"DROP TABLE {name}")
    return out


def row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written in order, in groups of 100,000 at most, and read back."""
    path = io.scratch(spark, "row-groups")
    io.write_parquet(frames(spark, sf_dir)["fx_abundance"], path, order_by=["tax_id", "acc"], rows_per_group=100_000)
    out = io.materialise(io.read_parquet(spark, path, ["acc", "tax_id", "total_abundance"]), "read-back")
    io.delete(spark, path)
    return out


def pair_abundance_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one kind of interaction only; the kind here follows from the ids."""
    fx = frames(spark, sf_dir)
    kind = F.when((F.col("host_tax_id") + F.col("microbe_tax_id")) % 3 == 0, "PHI-Base").otherwise("Commensal")
    return extract.pair_abundance(fx["fx_pairs_lists"].withColumn("interaction_type", kind), fx["fx_abundance"], interaction="PHI-Base")


def expected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.expected_rows(frames(spark, sf_dir)["fx_meta"])


def listed_pair_shared_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = frames(spark, sf_dir)
    return thresholds.listed_shared_counts(fx["fx_host"], fx["fx_microbe"], fx["fx_meta"])


def threshold_set_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = frames(spark, sf_dir)
    return thresholds.shared_counts(fx["fx_host"], fx["fx_microbe"], fx["fx_meta"])


def threshold_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every host's and microbe's datasets at each threshold, chunk by chunk, as numbers."""
    fx = frames(spark, sf_dir)
    numbers = bitmaps.dataset_numbers(fx["fx_host"], fx["fx_microbe"])
    sets = [bitmaps.threshold_sets(bitmaps.level_sets(fx[t], fx["fx_meta"].select(F.col(c).alias("tax_id")).distinct(), numbers)) for t, c in (("fx_host", "host_tax_id"), ("fx_microbe", "path_tax_id"))]
    listed = F.array_join(F.col("members").cast("array<string>"), ",")
    return bitmaps.members(sets[0].unionByName(sets[1])).select("tax_id", "threshold", "chunk", "n", F.sha2(listed, 256).alias("members_sha256"))


def shared_by_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = frames(spark, sf_dir)
    numbers = bitmaps.dataset_numbers(fx["fx_host"], fx["fx_microbe"])
    ids = [fx["fx_meta"].select(c).distinct() for c in ("host_tax_id", "path_tax_id")]
    sets = [bitmaps.level_sets(fx[t], i.toDF("tax_id"), numbers) for t, i in zip(("fx_host", "fx_microbe"), ids, strict=True)]
    return bitmaps.shared_counts(*sets, ids[0].crossJoin(ids[1]))


def listed_pairs_by_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = frames(spark, sf_dir)
    return bitmaps.listed_shared_counts(fx["fx_host"], fx["fx_microbe"], fx["fx_meta"])


def pair_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = frames(spark, sf_dir)
    return extract.pair_abundance(fx["fx_pairs_lists"], fx["fx_abundance"])


def pair_abundance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(extract.pair_abundance_summary(pair_abundance(spark, sf_dir)))


def unique_accessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.unique_accessions(frames(spark, sf_dir)["fx_pairs_lists"])


def _plain_date(df: DataFrame) -> DataFrame:
    return df.withColumn("releasedate", F.date_format("releasedate", "yyyy-MM-dd"))


def accession_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = frames(spark, sf_dir)
    return _plain_date(extract.accession_metadata(fx["fx_pairs_lists"], fx["fx_sra_meta"]))


def accession_metadata_with_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = frames(spark, sf_dir)
    return _plain_date(extract.accession_metadata(fx["fx_pairs_lists"], fx["fx_sra_meta"], with_pairs=True))


def metadata_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.metadata_summary(accession_metadata_with_pairs(spark, sf_dir))


def coo_index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.dense_index(frames(spark, sf_dir)["fx_abundance"], "acc", "row_idx")


def coo_index_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.dense_index(frames(spark, sf_dir)["fx_abundance"], "tax_id", "col_idx")


def coo_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.to_coo(frames(spark, sf_dir)["fx_abundance"])


def taxon_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = embed.taxon_embeddings(frames(spark, sf_dir)["fx_abundance"], STUDY.dims)
    return long.withColumn("value", _whole_millionths(F.col("value")) / 1_000_000 + 0.0)


def dataset_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = embed.dataset_embeddings(frames(spark, sf_dir)["fx_abundance"], STUDY.dims)
    return long.withColumn("value", _whole_millionths(F.col("value")) / 1_000_000 + 0.0)


def taxon_embedding_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row per taxon, as a sink of columns wants it."""
    return _rounded(embed.as_columns(embed.taxon_vectors(frames(spark, sf_dir)["fx_abundance"], STUDY.dims), "tax_id", STUDY.dims))


def dataset_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector per dataset, here as a text of its values in millionths."""
    vectors = embed.dataset_vectors(frames(spark, sf_dir)["fx_abundance"], STUDY.dims)
    whole = F.transform("embedding", lambda x: _whole_millionths(x).cast("long").cast("string"))
    return vectors.select("acc", F.size("embedding").cast("long").alias("dims"), F.array_join(whole, ",").alias("millionths"))


def sign_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.sign_table(frames(spark, sf_dir)["fx_abundance"], "tax_id", STUDY.dims)


def taxa_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.taxa_ids(frames(spark, sf_dir)["fx_abundance"])


def _grid(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    fx = frames(spark, sf_dir)
    # several operators read it more than once
    return fx, io.materialise(thresholds.threshold_summary(fx["fx_host"], fx["fx_microbe"], fx["fx_meta"]), "grid")


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = frames(spark, sf_dir)
    hosts, microbes = (fx[t].select(F.col("tax_id").alias(c)) for t, c in (("fx_host", "host_tax_id"), ("fx_microbe", "path_tax_id")))
    return labels.coverage_report(fx["fx_meta"], hosts, microbes)


def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.duplicate_pairs(frames(spark, sf_dir)["fx_meta"], labels.PAIR)


def duplicate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.duplicate_pairs(frames(spark, sf_dir)["fx_meta"])


def resolve_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.resolve_labels(frames(spark, sf_dir)["fx_meta"])


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx, grid = _grid(spark, sf_dir)
    return labels.attach_labels(grid, labels.resolve_labels(fx["fx_meta"]))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_counts(_labelled(spark, sf_dir))


def sample_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.sample_pairs(_labelled(spark, sf_dir), STUDY.sample_n, STUDY.seed)


def hypergeom_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, grid = _grid(spark, sf_dir)
    return _rounded(scores.hypergeom_score(grid, population(spark, sf_dir)), neg_log_p=4, host_threshold=9, path_threshold=9)


def hypergeom_log_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the full population of datasets, in logarithms."""
    _, grid = _grid(spark, sf_dir)
    return _rounded(scores.hypergeom_score(grid, STUDY.n_total, log_space=True).drop("hyp_geo_score"), neg_log_p=3, host_threshold=9, path_threshold=9)


def fisher_p_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against all datasets instead of the pair's own."""
    _, grid = _grid(spark, sf_dir)
    return _rounded(scores.fisher_p(grid, population(spark, sf_dir)), host_threshold=9, path_threshold=9)


def log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, grid = _grid(spark, sf_dir)
    return _rounded(scores.log_odds(grid, population(spark, sf_dir)), exact=True, log_odds=9, host_threshold=9, path_threshold=9)


def log_odds_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, grid = _grid(spark, sf_dir)
    return _rounded(scores.log_odds_local(grid), exact=True, log_odds_2=9, host_threshold=9, path_threshold=9)


def cooccurrence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, grid = _grid(spark, sf_dir)
    return _rounded(scores.cooccurrence_metrics(grid, population(spark, sf_dir)), exact=True, mutual_info=9, host_threshold=9, path_threshold=9)


def fisher_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, grid = _grid(spark, sf_dir)
    return _rounded(scores.fisher_p(grid), host_threshold=9, path_threshold=9)


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scores.log_odds(_labelled(spark, sf_dir), population(spark, sf_dir))
    # equal scores must stay equal in both engines
    return io.materialise(labels.sampled_rows(scored.withColumn("log_odds", F.round("log_odds", 9)), STUDY.sample_n, STUDY.seed), "sampled")


def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = evaluate.roc_points(_sampled(spark, sf_dir))
    finite = F.when(F.abs("cutoff") < float("inf"), F.col("cutoff"))
    return _rounded(points.withColumn("cutoff", finite), exact=True, host_threshold=9, path_threshold=9)


def auc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.auc_summary(_sampled(spark, sf_dir)), exact=True, host_threshold=9, path_threshold=9)


def auc_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.auc_grid(_sampled(spark, sf_dir)), exact=True, host_threshold=9, path_threshold=9)


def auc_grid_all_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All best cutoffs of a combination where several tie."""
    return _rounded(evaluate.auc_grid(_sampled(spark, sf_dir), ties="all"), exact=True, host_threshold=9, path_threshold=9)


def auc_grid_unsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid over all pairs instead of a sample of each label."""
    scored = scores.log_odds(_labelled(spark, sf_dir), population(spark, sf_dir)).withColumn("log_odds", F.round("log_odds", 9))
    return _rounded(evaluate.auc_grid(scored), exact=True, host_threshold=9, path_threshold=9)


def class_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians of the scores of either class over all pairs."""
    scored = scores.log_odds(_labelled(spark, sf_dir), population(spark, sf_dir)).withColumn("log_odds", F.round("log_odds", 9))
    return _rounded(evaluate.class_medians(scored), exact=True, host_threshold=9, path_threshold=9)


def roc_label_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.roc_label_text(evaluate.auc_summary(_sampled(spark, sf_dir))).select("comparison", *evaluate.COMBO, "label")


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score_histogram(_sampled(spark, sf_dir))


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.status(frames(spark, sf_dir)["fx_meta"], "pairs")


def _kept(df: DataFrame, *paths: str) -> DataFrame:
    """The rows written apart, so that the folders they come from can go."""
    out = io.materialise(df, "kept")
    io.delete(df.sparkSession, *paths)
    return out


def scan_with_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a partitioned folder with their file, partition folders left alone."""
    path = io.scratch(spark, "files")
    io.write_parquet(frames(spark, sf_dir)["fx_abundance"].withColumn("kind", F.col("tax_id") > 1000), path, ["kind"])
    rows = io.read_with_file(spark, path)
    return _kept(rows.select("acc", "tax_id", "total_abundance", F.regexp_extract("filename", "/kind=([a-z]+)/[^/]*[.]parquet$", 1).alias("folder")), path)


def scan_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = io.scratch(spark, "named")
    io.write_parquet(frames(spark, sf_dir)["fx_meta"], path)
    return _kept(io.read_by_name(spark, path), path)


def scan_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shard of a table by itself, then all of them together."""
    path = io.scratch(spark, "shards")
    io.write_parquet(frames(spark, sf_dir)["fx_abundance"].withColumn("shard", F.pmod(F.crc32("acc"), F.lit(4)).cast("int")), path, ["shard"])
    return _kept(io.union_by_name([io.read_shard(spark, path, "shard", k).select("acc", "tax_id", "total_abundance", "shard") for k in range(4)]), path)


def table_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table created from hosts to which microbes are added."""
    fx, name = frames(spark, sf_dir), f"appended_{uuid.uuid4().hex}"
    for t, mode in (("fx_host", "overwrite"), ("fx_microbe", "append")):
        io.save_table(fx[t].select("acc", "tax_id", "total_abundance"), name, mode)
    out = io.materialise(spark.table(name), "kept")
    spark.sql(f"DROP TABLE {name}")
    return out


def update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata whose center is replaced, and which gets a count, where a dataset has host rows."""
    fx = frames(spark, sf_dir)
    found = fx["fx_host"].groupBy("acc").agg(F.count("*").alias("n_rows"), F.max("tax_id").cast("string").alias("center"))
    return _plain_date(io.update_from(fx["fx_sra_meta"], found, "acc", ["center", "n_rows"]).fillna(0, ["n_rows"]))


def named_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projection under a name, asked by SQL."""
    name = f"meta_{uuid.uuid4().hex}"
    io.view(frames(spark, sf_dir)["fx_meta"], name, "host_tax_id", "Interaction_type")
    return spark.sql(f"SELECT host_tax_id, count(*) AS n, count(DISTINCT Interaction_type) AS n_types FROM {name} GROUP BY host_tax_id")


def io_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitioned zstd Parquet, read with merged schemas, then CSV, read with its schema."""
    rows = frames(spark, sf_dir)["fx_abundance"]
    parquet, csv = io.scratch(spark, "roundtrip-parquet"), io.scratch(spark, "roundtrip-csv")
    io.write_parquet(rows.withColumn("acc_prefix", F.substring("acc", 1, 5)), parquet, ["acc_prefix"], 100_000)
    io.write_csv(io.read_parquet(spark, parquet, ["acc", "tax_id", "total_abundance"], union_by_name=True), csv)
    out = io.materialise(io.read_csv(spark, csv, "acc string, tax_id bigint, total_abundance double"), "roundtrip")
    io.delete(spark, parquet, csv)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        alpha_diversity, clustered_alpha_diversity, host_threshold_counts, microbe_threshold_counts, pair_abundances, joint_threshold_counts, threshold_summary, threshold_summary_incremental, expected_rows, listed_pair_shared_counts,
        threshold_set_intersections, threshold_sets, shared_by_bitmaps, listed_pairs_by_bitmaps, pair_abundance, pair_abundance_interaction, pair_abundance_summary, unique_accessions, accession_metadata, accession_metadata_with_pairs, metadata_summary,
        coo_index_rows, coo_index_cols, coo_matrix, taxon_embeddings, taxon_embedding_columns, dataset_embeddings, dataset_vectors, sign_table, taxa_ids, coverage_report, duplicate_pairs, duplicate_labels, resolve_labels,
        label_counts, sample_pairs, hypergeom_score, hypergeom_log_score, log_odds, log_odds_local, cooccurrence_metrics, fisher_p, fisher_p_universe, roc_points, auc_summary, auc_grid, auc_grid_all_ties, auc_grid_unsampled, class_medians, roc_label_text, score_histogram, status, scan_with_file, scan_by_name, scan_shards, table_append, update_from, named_view, row_groups, io_roundtrip,
    )
}
