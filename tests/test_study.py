"""Hand goldens, invariants and edge cases of the study operators."""

import math
import os
from itertools import product

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cohabit import schemas
from cohabit.functions.stats import fisher, log_pmf, upper_tail
from cohabit.operators import bitmaps, diversity, embed, evaluate, extract, labels, matrix, scores, thresholds
from cohabit.sources import io


def abundance(spark, rows):
    return spark.createDataFrame(rows, schemas.ABUNDANCE)


def test_alpha_diversity_goldens(spark):
    rows = [("A", 1, 50.0), ("A", 2, 50.0), ("B", 1, 10.0), ("C", 1, 20.0), ("C", 1, 30.0), ("C", 2, 50.0), ("D", 1, 0.0), ("D", 2, -1.0), ("D", 3, None)]
    got = {r["acc"]: r for r in diversity.alpha_diversity(abundance(spark, rows)).collect()}
    assert set(got) == {"A", "B", "C"}
    for k in "AC":
        assert got[k]["richness"] == 2 and got[k]["shannon"] == pytest.approx(-math.log(2)) and got[k]["shannon_entropy"] == pytest.approx(math.log(2))
        assert got[k]["simpson_1_minus_D"] == pytest.approx(0.5) and got[k]["inverse_simpson"] == pytest.approx(2)
        assert got[k]["pielou_evenness"] == pytest.approx(-1) and got[k]["berger_parker_dominance"] == pytest.approx(0.5)
    assert got["B"]["richness"] == 1 and got["B"]["pielou_evenness"] is None and got["B"]["inverse_simpson"] == pytest.approx(1)


def test_threshold_equality_counts_360_of_900(spark):
    h = spark.createDataFrame([(1, "X", 0.01)], schemas.HOST)
    m = spark.createDataFrame([(2, "X", 0.1, "V")], schemas.MICROBE)
    pairs = spark.createDataFrame([(1, 2, "V", "h", "p")], schemas.PAIRS)
    rows = thresholds.threshold_summary(h, m, pairs).collect()
    assert len(rows) == 900 and sum(r["both_dataset_count"] for r in rows) == 360
    assert thresholds.expected_rows(pairs).first()[0] == len(rows)
    assert all(r["both_dataset_count"] <= min(r["host_dataset_count"], r["pathogen_dataset_count"]) for r in rows)


def test_threshold_counts_ignore_repeats_and_keep_absent_ids(spark):
    a = spark.createDataFrame([(1, "X", 0.5), (1, "X", 0.5), (1, "Y", None)], schemas.HOST)
    ids = spark.createDataFrame([(1,), (9,)], "tax_id bigint")
    got = {(r["tax_id"], r["threshold"]): r["n"] for r in thresholds.threshold_counts(a, ids, (0.1, 0.5, 1.0)).collect()}
    assert got == {(1, 0.1): 1, (1, 0.5): 1, (1, 1.0): 0, (9, 0.1): 0, (9, 0.5): 0, (9, 1.0): 0}


def test_listed_pairs_keep_repeats_and_ask_for_the_label(spark):
    h = spark.createDataFrame([(1, "X", 1.0)], schemas.HOST)
    m = spark.createDataFrame([(2, "X", 1.0, "V")], schemas.MICROBE)
    pairs = spark.createDataFrame([(1, 2, "V", "h", "p"), (1, 2, "V", "h", "p"), (1, 2, "F", "h", "p")], schemas.PAIRS)
    got = thresholds.listed_shared_counts(h, m, pairs, (0.5,)).collect()
    assert sorted((r["pathogen_root_label"], r["num_shared_datasets"]) for r in got) == [("F", 0), ("V", 1), ("V", 1)]
    assert thresholds.listed_shared_counts(h, m, pairs, (0.5,), dedupe_pairs=True).count() == 2


def test_shared_counts_brute_force(spark):
    h = [(t, f"S{k % 17}", (k * t % 7) / 10) for t in (1, 2) for k in range(40)] + [(1, "S1", None), (8, "S1", 1.0)]
    m = [(t, f"S{k % 13}", (k * t % 5) / 10, "V") for t in (3, 4) for k in range(30)]
    hosts, microbes = spark.createDataFrame(h, schemas.HOST), spark.createDataFrame(m, schemas.MICROBE)
    pairs = spark.createDataFrame([(1, 3, "V", "h", "p"), (2, 4, "V", "h", "p"), (9, 4, "V", "h", "p")], schemas.PAIRS)
    levels = (0.1, 0.3, 0.6)
    keep = lambda rows, t, x: {r[1] for r in rows if r[0] == t and r[2] is not None and r[2] >= x}
    want = {(a, b, x, y): len(keep(h, a, x) & keep(m, b, y)) for a, b, x, y in product((1, 2, 9), (3, 4), levels, levels)}
    assert {tuple(r)[:4]: r[4] for r in thresholds.shared_counts(hosts, microbes, pairs, levels).collect()} == want
    numbers = bitmaps.dataset_numbers(hosts, microbes)
    sets = [bitmaps.level_sets(df, pairs.select(pairs[c].alias("tax_id")).distinct(), numbers, levels) for df, c in ((hosts, "host_tax_id"), (microbes, "path_tax_id"))]
    every = pairs.select("host_tax_id").distinct().crossJoin(pairs.select("path_tax_id").distinct())
    assert {tuple(r)[:4]: r[4] for r in bitmaps.shared_counts(*sets, every, levels).collect()} == want
    name = {r["number"]: r["acc"] for r in numbers.collect()}
    for rows, s in ((h, sets[0]), (m, sets[1])):
        got = {(r["tax_id"], r["threshold"]): {name[k] for k in r["members"]} for r in bitmaps.members(bitmaps.threshold_sets(s, levels)).collect()}
        assert got == {(t, x): keep(rows, t, x) for t in {r[0] for r in rows} - {8} for x in levels if keep(rows, t, x)}


def test_accession_lists(spark):
    pairs = spark.createDataFrame([(1, 2, None), (1, 3, []), (1, 4, ["X", "X"]), (1, 5, ["unknown"]), (7, 7, ["X"])], schemas.PAIR_LISTS)
    a = abundance(spark, [("X", 4, 2.0), ("X", 4, 3.0), ("X", 7, 3.0), ("X", 1, None)])
    got = sorted(map(tuple, extract.pair_abundance(pairs, a).collect()))
    assert got == [(1, 4, None, 3.0, "X"), (7, 7, 3.0, 3.0, "X")]
    assert sorted(r[0] for r in extract.unique_accessions(pairs).collect()) == ["X", "unknown"]
    typed = pairs.withColumn("interaction_type", F.when(F.col("host_tax_id") == 7, "PHI-Base").otherwise("Commensal"))
    assert [tuple(r) for r in extract.pair_abundance(typed, a, interaction="PHI-Base").collect()] == [(7, 7, 3.0, 3.0, "X")]
    meta = spark.createDataFrame([("X", 1), ("Z", 2)], "acc string, anything int")
    assert [tuple(r) for r in extract.accession_metadata(pairs, meta).collect()] == [("X", 1)]
    assert extract.accession_metadata(pairs, meta, with_pairs=True).count() == 2


def test_label_priority_and_sample(spark):
    meta = spark.createDataFrame([(1, 2, "V", "h", "p", "Commensal"), (1, 2, "V", "h", "p", "Positive Control"), (1, 3, "V", "h", "p", "Other")], schemas.PAIR_META)
    assert sorted(map(tuple, labels.resolve_labels(meta).collect())) == [(1, 2, "Positive Control"), (1, 3, "Other")]
    df = spark.createDataFrame([(h, m, "A" if h else "B") for h, m in product(range(2), range(30))], "host_tax_id bigint, path_tax_id bigint, Interaction_type string")
    one, two = labels.sample_pairs(df, 7), labels.sample_pairs(df.repartition(3), 7)
    assert {r["Interaction_type"]: r["count"] for r in one.groupBy("Interaction_type").count().collect()} == {"A": 7, "B": 7}
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_coverage_with_gaps(spark):
    meta = spark.createDataFrame([(1, 1001), (2, 1008), (2, 1015)], "host_tax_id long, path_tax_id long")
    hosts = spark.createDataFrame([(1,), (2,), (3,), (3,)], "host_tax_id long")
    microbes = spark.createDataFrame([(1001,), (1008,), (1009,)], "path_tax_id long")
    got = {r["key"]: tuple(r)[1:] for r in labels.coverage_report(meta, hosts, microbes).collect()}
    assert got == {"host_tax_id": (2, 3, 0, 1), "path_tax_id": (3, 3, 1, 1)}
    assert {r["key"]: r["only_data"] for r in labels.coverage_report(meta, meta).collect()} == {"host_tax_id": 0, "path_tax_id": 0}


def counts(spark, rows):
    return spark.createDataFrame(rows, "host_dataset_count bigint, pathogen_dataset_count bigint, both_dataset_count bigint")


def test_pair_score_goldens(spark):
    df = counts(spark, [(3, 3, 2), (0, 0, 0), (2, 2, 3)])
    got = {tuple(r)[:3]: r for r in scores.hypergeom_score(df, 10).collect()}
    assert got[(3, 3, 2)]["hyp_geo_score"] == pytest.approx(22 / 120) and got[(0, 0, 0)]["hyp_geo_score"] == 1
    assert got[(2, 2, 3)]["neg_log_p"] == pytest.approx(323.0051853474518)
    m = {tuple(r)[:3]: r for r in scores.cooccurrence_metrics(df, 10).collect()}[(3, 3, 2)]
    assert (m["jaccard"], m["sorensen_dice"], m["c_score"]) == (pytest.approx(0.5), pytest.approx(4 / 6), 1)
    assert abs(m["phi"]) <= 1 and m["mutual_info"] >= -1e-12
    f = {tuple(r)[:3]: r for r in scores.fisher_p(df).collect()}
    assert f[(3, 3, 2)]["fisher_p"] == pytest.approx(1) and f[(2, 2, 3)]["fisher_p"] is None
    local = {tuple(r)[:3]: r for r in scores.log_odds_local(df).collect()}
    assert local[(0, 0, 0)]["log_odds_2"] is None


def test_scores_in_log_space_and_with_a_universe(spark):
    df = counts(spark, [(9_000, 9_000, 9_000), (9_000, 9_000, 8_999), (3, 3, 2)])
    plain = {tuple(r)[:3]: r["neg_log_p"] for r in scores.hypergeom_score(df).collect()}
    deep = {tuple(r)[:3]: r["neg_log_p"] for r in scores.hypergeom_score(df, log_space=True).collect()}
    assert plain[(9_000, 9_000, 9_000)] == plain[(9_000, 9_000, 8_999)] and deep[(9_000, 9_000, 9_000)] > deep[(9_000, 9_000, 8_999)] > 10_000
    assert deep[(3, 3, 2)] == pytest.approx(plain[(3, 3, 2)])
    for u in (4, 10):  # a 2x2 table of u datasets: all tables with the same margins
        white, black = 3, u - 3
        pmf = [math.comb(white, k) * math.comb(black, 3 - k) / math.comb(u, 3) for k in range(4) if black >= 3 - k]
        seen = math.comb(3, 2) * math.comb(black, 1) / math.comb(u, 3)
        got = scores.fisher_p(df.where("host_dataset_count = 3"), n_universe=u).first()["fisher_p"]
        assert got == pytest.approx(sum(p for p in pmf if p <= seen * (1 + 1e-7)))


def test_exact_tests_against_integers():
    for white, black, draws in ((5, 7, 6), (30, 12, 20), (1, 50, 25)):
        total = math.comb(white + black, draws)
        pmf = {x: math.comb(white, x) * math.comb(black, draws - x) / total for x in range(max(0, draws - black), min(white, draws) + 1)}
        for x in pmf:
            assert math.exp(log_pmf(x, white, black, draws)) == pytest.approx(pmf[x], rel=1e-12)
            assert upper_tail(x, white, black, draws) == pytest.approx(sum(p for k, p in pmf.items() if k >= x), rel=1e-11)
            a, b, c = x, white - x, draws - x
            want = sum(p for p in pmf.values() if p <= pmf[x] * (1 + 1e-7))
            assert fisher(a, b, c, black - c) == pytest.approx(want, rel=1e-11)
    n, m, k, x = 29_289_124, 20_000, 15_000, 60
    tail = sum(math.comb(m, i) * math.comb(n - m, k - i) for i in range(x, 90))
    whole = math.comb(n, k)
    shift = max(0, whole.bit_length() - 900)
    assert upper_tail(x, m, n - m, k) == pytest.approx((tail >> shift) / (whole >> shift), rel=1e-9)


def test_roc_with_ties_and_one_class(spark):
    rows = [(1.0, 1.0, "PHI-Base", s) for s in (3.0, 2.0, 2.0)] + [(1.0, 1.0, "Negative Control", s) for s in (2.0, 1.0, 1.0)] + [(2.0, 1.0, "PHI-Base", 1.0), (2.0, 1.0, "PHI-Base", None)]
    df = spark.createDataFrame(rows, "host_threshold double, path_threshold double, Interaction_type string, log_odds double")
    got = {r["host_threshold"]: r for r in evaluate.auc_summary(df).collect()}
    assert got[1.0]["auc"] == pytest.approx(8 / 9) and got[1.0]["n_total"] == 6 and got[1.0]["n_correct"] == 5
    assert got[2.0]["auc"] is None and got[2.0]["n_total"] == 1 and got[2.0]["n_correct"] is None
    points = evaluate.roc_points(df).collect()
    found = sorted((r["specificity"], r["sensitivity"]) for r in points)
    want = [(0.0, 1.0), (2 / 3, 1.0), (1.0, 0.0), (1.0, 1 / 3)]
    assert len(found) == 4 and all(a == pytest.approx(b) for a, b in zip(found, want, strict=True))
    flipped = df.withColumn("log_odds", -df["log_odds"])
    assert {r["host_threshold"]: r["auc"] for r in evaluate.auc_summary(flipped).collect()}[1.0] == pytest.approx(8 / 9)
    # specificity + sensitivity is 5/3 at (2/3, 1) only; with a symmetric curve two cutoffs tie
    even = spark.createDataFrame([(1.0, 1.0, "PHI-Base", x) for x in (1.0, 3.0)] + [(1.0, 1.0, "Negative Control", x) for x in (0.0, 2.0)], df.schema)
    rows = [evaluate.auc_grid(even, (("PHI vs Neg", "PHI-Base", "Negative Control"),), ties=t).collect() for t in ("one", "all")]
    assert len(rows[0]) == 1 and len(rows[1]) == 2 and {r["n_correct"] for r in rows[1]} == {3}
    text = {r["host_threshold"]: r["label"] for r in evaluate.roc_label_text(evaluate.auc_summary(df)).collect()}
    assert text == {1.0: "AUC = 0.89\nN = 6", 2.0: "AUC = NA\nN = 1"}


def test_matrix_index_is_dense_and_independent_of_partitions(spark):
    a = abundance(spark, [(f"S{i % 13:02}", i % 5, float(i % 3)) for i in range(60)])
    for df in (a, a.repartition(7)):
        assert sorted((r["acc"], r["idx"]) for r in matrix.dense_index(df, "acc").collect()) == [(f"S{i:02}", i) for i in range(13)]
    assert matrix.to_coo(a).count() == 40


def test_projection_is_linear(spark):
    rows = [("A", 1, 1.0), ("A", 2, 2.0), ("B", 1, 3.0)]
    one = {(r[0], r[1]): r[2] for r in embed.dataset_embeddings(abundance(spark, rows), 40).collect()}
    two = {(r[0], r[1]): r[2] for r in embed.dataset_embeddings(abundance(spark, [(a, t, 2 * x) for a, t, x in rows]), 40).collect()}
    assert len(one) == 80 and all(two[k] == pytest.approx(2 * v) for k, v in one.items())
    vectors = embed.as_vectors(embed.dataset_embeddings(abundance(spark, rows), 40), "acc")
    assert {len(r["embedding"]) for r in vectors.collect()} == {40} and len(embed.as_columns(vectors, "acc", 40).columns) == 41


def test_io(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2, 0.5)], "i int, d double")
    io.write_parquet(a, f"{tmp_path}/p/k=1", rows_per_file=1)
    io.write_parquet(b, f"{tmp_path}/p/k=2")
    assert sorted(io.read_parquet(spark, f"{tmp_path}/p", union_by_name=True).columns) == ["d", "i", "k", "s"]
    assert io.union_by_name([a, b]).count() == 2
    named = io.read_with_file(spark, f"{tmp_path}/p/k=1")
    assert "k" not in named.columns and named.first()["filename"].endswith(".parquet")
    assert io.read_shard(spark, f"{tmp_path}/p", "k", 2).count() == 1 and io.read_by_name(spark, f"{tmp_path}/p/k=1").count() == 1
    io.write_csv(a, f"{tmp_path}/c", ";")
    new = io.update_from(spark.createDataFrame([(1, "old"), (2, "keep")], "i int, s string"), spark.createDataFrame([(1, "new", 7)], "i int, s string, t int"), "i", ["s", "t"])
    assert sorted(map(tuple, new.collect()), key=str) == [(1, "new", 7), (2, "keep", None)]
    assert io.status(a, "pairs").first()[0] == "Loaded 1 pairs"
    io.save_table(a, "kept_rows")
    io.save_table(a, "kept_rows", mode="append")
    assert spark.table("kept_rows").count() == 2
    io.save_table(b, "kept_rows")
    assert spark.table("kept_rows").columns == ["i", "d"]
    io.view(a, "only_s", "s")
    assert spark.sql("SELECT * FROM only_s").columns == ["s"]
    io.write_parquet(spark.range(1000).repartition(5), f"{tmp_path}/sorted", order_by=["id"])
    files = sorted(f for f in os.listdir(f"{tmp_path}/sorted") if f.endswith(".parquet"))
    assert [x for f in files for x in pq.read_table(f"{tmp_path}/sorted/{f}")["id"].to_pylist()] == list(range(1000))
    with pytest.raises(ValueError, match="missing columns: x"):
        schemas.need(a, "x")


def test_scratch_is_discarded(spark):
    def folders():
        at = io.shared_dir(spark).removeprefix("file:")
        return set(os.listdir(at)) if os.path.isdir(at) else set()

    before = folders()
    one = io.materialise(spark.range(3).toDF("id"), "one")
    two = io.materialise(one.where("id > 0"), "two", done=[one])
    assert two.count() == 2 and {x.split("-")[0] for x in folders() - before} == {"two"}
    with io.scope() as keep:
        inner = io.materialise(two, "inner")
        out = keep(io.materialise(inner, "out"))
    io.discard(two, two, spark.range(1))
    assert out.count() == 2 and {x.split("-")[0] for x in folders() - before} == {"out"}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "local-cluster[2,1,512]", "none"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        io.shared_dir(Session())
    Context.master = "local[2]"
    assert os.path.isdir(io.shared_dir(Session()))


def test_index_and_embeddings_do_not_depend_on_cached_blocks_or_exploded_shuffles(spark):
    a = abundance(spark, [(f"S{i % 13:02}", i % 5, float(i % 3)) for i in range(60)])
    assert "InMemoryTableScan" not in matrix.dense_index(a, "acc")._jdf.queryExecution().executedPlan().toString()
    plan = embed.dataset_embeddings(a, 64)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate posexplode" in plan[: plan.index("Exchange hashpartitioning")]
