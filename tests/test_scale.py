"""Mechanisms that keep the study's operators bounded: ranks by ranges, bitmaps, prefilters, states, layouts."""

import glob
import math
import os
import random
from collections import defaultdict
from statistics import median

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cohabit import schemas
from cohabit.functions import stats
from cohabit.operators import bitmaps, deal, diversity, embed, evaluate, extract, matrix, prefilter, ranks, scores, state, thresholds
from cohabit.plans import queries
from cohabit.sources import io

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_of_hot_null_and_repeated_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", None, f"g{rng.randrange(30)}"]), rng.choice([None, rng.randrange(50)]), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, k int, row int").repartition(5)
    got = ranks.ranked(df, ["k", "row"], ["g"], "pos", "n").collect()
    want = defaultdict(list)
    for g, k, i in rows:
        want[g].append((k is not None, k or 0, i))
    assert len(got) == 5000 and all(r["n"] == len(want[r["g"]]) and sorted(want[r["g"]])[r["pos"]][2] == r["row"] for r in got)
    assert sorted(r["rank"] for r in ranks.ranked(df, ["k"]).collect()) == list(range(5000))
    assert ranks.ranked(df.limit(0), ["k"], ["g"]).count() == 0


def test_both_indices_in_one_pass(spark):
    a = spark.createDataFrame([(f"S{i % 13:02}", i % 5, 1.0) for i in range(60)], schemas.ABUNDANCE)
    got = {(r["axis"], r["acc"] or r["tax_id"]): r["idx"] for r in matrix.both_indices(a).collect()}
    assert got == {("row", f"S{i:02}"): i for i in range(13)} | {("col", i): i for i in range(5)}


def test_rank_statistics_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(t, 1.0, rng.choice(["PHI-Base", "Negative Control", "Random"]), rng.choice([None, float("nan"), round(rng.gauss(0, 1), 1)])) for t in (1.0, 2.0) for _ in range(700)]
    df = spark.createDataFrame(rows, "host_threshold double, path_threshold double, Interaction_type string, log_odds double")
    which = (("PHI vs Neg", "PHI-Base", "Negative Control"), ("PHI vs Random", "PHI-Base", "Random"))
    seen = {tuple(r)[:2]: r for r in evaluate.class_medians(df, which).collect()}
    for r in evaluate.auc_grid(df, which).collect():
        pos, neg = ([s for t, _, c, s in rows if t == r["host_threshold"] and c == k and s is not None and not math.isnan(s)] for k in next(w[1:] for w in which if w[0] == r["comparison"]))
        sign = 1 if median(neg) <= median(pos) else -1
        assert (seen[r["comparison"], r["host_threshold"]]["case_median"], seen[r["comparison"], r["host_threshold"]]["control_median"]) == (pytest.approx(median(pos)), pytest.approx(median(neg)))
        auc = sum((p * sign > q * sign) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
        cuts = [-math.inf, *{s * sign for s in (*pos, *neg)}]
        right = {c: (sum(p * sign > c for p in pos), sum(q * sign <= c for q in neg)) for c in cuts}
        best = max(right.values(), key=lambda x: (x[0] * len(neg) + x[1] * len(pos), x[0]))
        assert r["auc"] == pytest.approx(auc) and r["n_total"] == len(pos) + len(neg) and r["n_correct"] == sum(best)
    points = evaluate.roc_points(df, which[:1]).where("host_threshold = 1").orderBy("sensitivity", F.desc("specificity")).collect()
    scores_seen = sorted({s for t, _, c, s in rows if t == 1.0 and c != "Random" and s is not None and not math.isnan(s)})
    assert len(points) == len(scores_seen) + 1
    inner = sorted(p["cutoff"] for p in points if abs(p["cutoff"]) < math.inf)
    assert inner == pytest.approx([(a + b) / 2 for a, b in zip(scores_seen[:-1], scores_seen[1:], strict=True)])


def test_rank_statistics_take_no_group_into_one_task(spark):
    df = spark.createDataFrame([(1.0, 1.0, "PHI-Base", 1.0), (1.0, 1.0, "Negative Control", 0.5)], "host_threshold double, path_threshold double, Interaction_type string, log_odds double")
    for found in (evaluate.auc_grid(df), evaluate.roc_points(df)):
        text = found._jdf.queryExecution().optimizedPlan().toString()
        assert "median" not in text and "collect" not in text
        # windows by group exist over the table of ranges only, which is an aggregate; rows of scores are windowed by range
        lines = text.splitlines()
        for i, line in enumerate(lines):
            if "windowspecdefinition(comparison" in line:
                below = next(x for x in lines[i + 1 :] if not any(w in x for w in ("Window", "Project")))
                assert "Aggregate [comparison" in below and "_part" in below.split("]")[0]


def test_bitmaps_over_several_chunks(spark):
    n = 70_000
    h = spark.range(n).select(F.lit(1).cast("long").alias("tax_id"), F.format_string("S%06d", F.col("id")).alias("acc"), (F.col("id") % 3).cast("double").alias("total_abundance"))
    m = spark.range(n).where("id % 2 = 0").select(F.lit(2).cast("long").alias("tax_id"), F.format_string("S%06d", F.col("id")).alias("acc"), F.lit(1.5).alias("total_abundance"))
    levels, numbers = (1.0, 2.0), bitmaps.dataset_numbers(h, m)
    ids = [spark.createDataFrame([(i,)], "tax_id long") for i in (1, 2)]
    sets = [bitmaps.level_sets(df, i, numbers, levels) for df, i in zip((h, m), ids, strict=True)]
    assert {(r["chunk"], r["level"]) for r in sets[0].collect()} == {(c, k) for c in range(3) for k in (1, 2)} and {len(r["bits"]) for r in sets[0].collect()} == {4096}
    pairs = spark.createDataFrame([(1, 2), (1, 9)], "host_tax_id long, path_tax_id long")
    got = {tuple(r)[1:4]: r[4] for r in bitmaps.shared_counts(*sets, pairs, levels).collect()}
    both = lambda x: sum(1 for i in range(0, n, 2) if i % 3 >= x)
    assert got == {(2, 1.0, 1.0): both(1), (2, 2.0, 1.0): both(2), (2, 1.0, 2.0): 0, (2, 2.0, 2.0): 0} | {(9, x, y): 0 for x in levels for y in levels}
    full = bitmaps.members(bitmaps.threshold_sets(sets[0], levels)).where("threshold = 1").collect()
    assert sorted(k for r in full for k in r["members"]) == [i for i in range(n) if i % 3]


def test_prefilter_stands_below_the_first_exchange_and_loses_nothing(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 2, ["A", "B"]), (3, 2, ["B", None])], schemas.PAIR_LISTS)
    spark.createDataFrame([(f"X{i}", i % 7, 1.0) for i in range(20_000)] + [("A", 1, 0.5), ("B", 3, 2.0), (None, 1, 1.0)], schemas.ABUNDANCE).write.parquet(f"{tmp_path}/a")
    a = spark.read.parquet(f"{tmp_path}/a")
    found = extract.pair_abundance(pairs, a)
    lines = plan(found).splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan parquet" in x and "total_abundance" in x)
    above = [x.strip(" :+-*()0123456789") for x in reversed(lines[:scan])]
    first = next(i for i, x in enumerate(above) if x.startswith("Exchange"))
    assert any("BroadcastHashJoin" in x and "LeftSemi" in x for x in above[:first])
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 2, 0.5, None, "A"), (3, 2, 2.0, None, "B")]
    keys = a.where("tax_id = 3").select("acc", "tax_id")
    for chunks in (1, 64):
        bitmap = prefilter.hash_bitmap(keys, ["acc", "tax_id"], chunks)
        assert bitmap.count() <= chunks
        passed = prefilter.may_hold(a, bitmap, ["acc", "tax_id"], chunks)
        assert passed.where("tax_id = 3").count() == keys.count() and (chunks == 1 or passed.count() < keys.count() + 300)
    assert prefilter.may_hold(a, prefilter.hash_bitmap(keys.limit(0), ["acc"]), ["acc"]).count() == 0


def test_state_grows_by_batches(spark, tmp_path):
    rng = random.Random(2)
    h = spark.createDataFrame([(rng.randrange(4), f"S{rng.randrange(200)}", rng.choice([None, 0.0, 0.1, 0.5, 2.0])) for _ in range(900)], schemas.HOST)
    m = spark.createDataFrame([(10 + rng.randrange(3), f"S{rng.randrange(200)}", rng.choice([0.1, 0.5, 2.0]), "V") for _ in range(700)], schemas.MICROBE)
    pairs = spark.createDataFrame([(i, 10 + j, "V", "h", "p") for i in range(4) for j in range(4)], schemas.PAIRS)
    levels = (0.1, 0.4, 1.0)
    want = sorted(map(tuple, thresholds.threshold_summary(h, m, pairs, levels).collect()))
    part = F.crc32("acc") % 3
    folder = str(tmp_path / "state")
    # the second batch comes twice, and the third brings datasets of the first again
    for batch, which in (("a", part == 0), ("b", part == 1), ("b", part == 1), ("c", part != 1)):
        state.append_batch(folder, batch, h.where(which), m.where(which), pairs, levels)
    assert sorted(map(tuple, state.threshold_summary(state.read_state(spark, folder), pairs, levels).collect())) == want
    two = state.merged(*[state.batch_state(h.where(w), m.where(w), pairs, levels) for w in (part == 0, part != 0)])
    assert sorted(map(tuple, state.threshold_summary(two, pairs, levels).collect())) == want


def test_bucketed_tables_need_no_exchange(spark):
    rng = random.Random(3)
    a = spark.createDataFrame([(f"S{rng.randrange(60)}", rng.randrange(9), rng.random()) for _ in range(800)], schemas.ABUNDANCE)
    io.save_table(a, "dealt_abundance", bucket_by=["acc"], buckets=6, sort_by=["acc"])
    t = spark.table("dealt_abundance")
    dealt = [diversity.alpha_diversity(t, clustered=True), embed.dataset_vectors(t, 32, clustered=True)]
    plain = [diversity.alpha_diversity(a), embed.dataset_vectors(a, 32)]
    for x, y in zip(dealt, plain, strict=True):
        assert "Exchange" not in plan(x) and "Exchange" in plan(y)
    close = lambda df: sorted((r["acc"], round(r["shannon"], 9)) for r in df.collect())
    assert close(dealt[0]) == close(plain[0])
    vectors = lambda df: {r["acc"]: r["embedding"] for r in df.collect()}
    got, want = vectors(dealt[1]), vectors(plain[1])
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    with pytest.raises(ValueError, match="belong together"):
        io.save_table(a, "dealt_abundance", buckets=3)


def test_row_groups_of_a_given_number_of_rows(spark, tmp_path):
    io.write_parquet(spark.range(25_000).withColumn("x", F.rand(1)).repartition(3), f"{tmp_path}/g", order_by=["id"], rows_per_group=2_000)
    groups = []
    for f in sorted(glob.glob(f"{tmp_path}/g/*.parquet")):
        meta = pq.ParquetFile(f).metadata
        for i in range(meta.num_row_groups):
            s = meta.row_group(i).column(0).statistics
            groups.append((s.min, s.max, meta.row_group(i).num_rows))
    assert sum(g[2] for g in groups) == 25_000 and max(g[2] for g in groups) <= 2_000
    assert all(a[1] < b[0] for a, b in zip(groups[:-1], groups[1:], strict=True))


@pytest.mark.parametrize("dense", [0, 32])
def test_vectors_do_not_depend_on_batches_and_bounds(spark, monkeypatch, dense):
    monkeypatch.setattr(embed, "DENSE", dense)
    rng = random.Random(5)
    rows = [(rng.choice(["hot", f"S{rng.randrange(50)}", None]), rng.choice([None, *range(12)]), rng.choice([None, rng.random()])) for _ in range(3000)]
    want_t, want_d = defaultdict(lambda: np.zeros(40)), defaultdict(lambda: np.zeros(40))
    for acc, tax, x in rows:
        if x is not None and acc is not None:
            want_t[tax] += x * embed.signs([acc], 40)[0]
        if x is not None and tax is not None:
            want_d[acc] += x * embed.signs([str(tax)], 40)[0]
    monkeypatch.setattr(embed, "SLICE", 7)
    monkeypatch.setattr(embed, "HELD_BYTES", 1)
    df = spark.createDataFrame(rows, schemas.ABUNDANCE).repartition(5)
    for got, want, key in ((embed.taxon_vectors(df, 40), want_t, "tax_id"), (embed.dataset_vectors(df, 40), want_d, "acc")):
        found = {r[key]: r["embedding"] for r in got.collect()}
        assert set(found) == set(want) and all(found[k] == pytest.approx((want[k] / math.sqrt(40)).tolist(), abs=1e-9) for k in want)
    assert embed.taxon_vectors(df.limit(0), 40).count() == 0 and embed.dataset_vectors(df.limit(0), 40).count() == 0


def test_tails_share_terms_and_equal_exact_integers(spark):
    n = 29_289_124
    rng = random.Random(6)
    margins = [(20_000, 15_000), (3_000, 2_500_00), (700, 900)]
    rows = sorted({(h, m, max(0, min(h, m, round(h * m / n + rng.gauss(0, 4) * (h * m / n) ** 0.5 + rng.choice([0, 3]))))) for h, m in margins for _ in range(12)})
    df = spark.createDataFrame(rows, "host_dataset_count bigint, pathogen_dataset_count bigint, both_dataset_count bigint")
    got = {tuple(r)[:3]: r["log_p"] for r in scores.hypergeom_tails(df.repartition(3), n).collect()}
    assert set(got) == set(rows)
    for h, m in margins:
        mine = [r for r in rows if r[:2] == (h, m)]
        low = min(s for *_, s in mine)
        # pmf(x) = C(h, x) C(n - h, m - x) / C(n, m), as integers over one denominator, far enough out
        most = min(h, m, max(s for *_, s in mine) + 150)
        pmf = {low: math.comb(h, low) * math.comb(n - h, m - low)}
        for x in range(low, most):
            pmf[x + 1] = pmf[x] * (h - x) * (m - x) // ((x + 1) * (n - h - m + x + 1))
        whole = math.comb(n, m)
        shift = max(0, whole.bit_length() - 900)
        for *_, s in mine:
            tail = sum(pmf[x] for x in range(s, most + 1))
            if s > 0:
                assert math.exp(got[h, m, s]) == pytest.approx((tail >> shift) / (whole >> shift), rel=1e-9)
            else:
                assert got[h, m, s] == 0
    h, m, s = (np.array(x, dtype=float) for x in zip(*[r for r in rows if r[2] > 0], strict=True))
    side = np.where(s * n <= h * m, -1, 1)
    order = np.lexsort((-s * side, side, m, h))
    shared, alone = stats.MarginTails(n), []
    shared(s[order], h[order], m[order], side[order])
    for sign in (-1, 1):
        k = side == sign
        stats._log_tail(s[k] - (sign < 0), h[k], n - h[k], m[k], sign > 0, None, alone)
    assert sum(shared.count) < 0.7 * sum(alone)
    assert os.path.isdir(io.shared_dir(spark).removeprefix("file:"))


def test_members_are_unpacked_a_few_chunks_at_a_time():
    n = 5 * bitmaps.HELD + 3
    rows = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([bytes([k % 256]) + bytes(4094) + b"\x80" for k in range(n)])], names=["chunk", "bits"])
    got = list(bitmaps._numbers(iter([rows]), ["chunk"], "members"))
    assert max(len(b) for b in got) <= bitmaps.HELD
    found = [m for b in got for m in b.column("members").to_pylist()]
    assert found == [[k * bitmaps.CHUNK + i for i in range(8) if k >> i & 1] + [(k + 1) * bitmaps.CHUNK - 1] for k in range(n)]


def test_threshold_tasks_grow_in_number_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(deal, "ROWS", 100)
    rng = random.Random(3)
    # one host and one microbe hold nearly all rows; some taxa are not listed
    h = [(1 if rng.random() < 0.9 else rng.choice([2, 5]), f"S{rng.randrange(900)}", rng.choice([None, 0.0, 0.1, 0.5, 2.0])) for _ in range(3000)]
    m = [(11 if rng.random() < 0.9 else rng.choice([12, 15]), f"S{rng.randrange(900)}", rng.choice([0.1, 0.5, 2.0]), "V") for _ in range(2000)]
    hosts, microbes = spark.createDataFrame(h, schemas.HOST), spark.createDataFrame(m, schemas.MICROBE)
    pairs, levels = spark.createDataFrame([(i, 10 + j, "V", "h", "p") for i in (1, 2, 3) for j in (1, 2)], schemas.PAIRS), (0.1, 0.4)
    for few in (deal.IDS, 1):
        monkeypatch.setattr(deal, "IDS", few)
        joint, met = thresholds.shared_counts(hosts, microbes, pairs, levels), thresholds.pair_abundances(hosts, microbes, pairs)
        counts = thresholds.threshold_counts(hosts, pairs.select(F.col("host_tax_id").alias("tax_id")), levels)
        for df, times in ((joint, 2), (met, 2), (counts, 1)):
            assert plan(df).count("hashpartitioning(acc") == times
        assert plan(joint).count(", 30), REPARTITION_BY_NUM") >= 2 and plan(met).count(", 120), REPARTITION_BY_NUM") == 2
        passing = lambda rows, t, x: {r[1] for r in rows if r[0] == t and r[2] is not None and r[2] >= x}
        assert {(r["tax_id"], r["threshold"]): r["n"] for r in counts.collect()} == {(t, x): len(passing(h, t, x)) for t in (1, 2, 3) for x in levels}
        assert {tuple(r)[:4]: r[4] for r in joint.collect()} == {(i, j, x, y): len(passing(h, i, x) & passing(m, j, y)) for i in (1, 2, 3) for j in (11, 12) for x in levels for y in levels}
        by = defaultdict(list)
        for t, acc, x, _ in m:
            by[acc].append((t, x))
        want = [(i, j, acc, x, y) for i, acc, x in h if i in (1, 2) for j, y in by[acc] if j in (11, 12)]
        assert sorted(map(str, map(tuple, met.collect()))) == sorted(map(str, want))


def test_every_table_of_the_grid_is_dealt_by_dataset(spark, monkeypatch):
    monkeypatch.setattr(deal, "ROWS", 100)
    fx = queries.frames(spark, SF)
    n = -(-fx["fx_host"].count() // 100)
    text = thresholds.threshold_summary(fx["fx_host"], fx["fx_microbe"], fx["fx_meta"])._jdf.queryExecution().optimizedPlan().toString()
    # hosts, microbes, and both again for the joint counts
    assert n > 50 and text.count("RepartitionByExpression [acc#") == len([x for x in text.splitlines() if "RepartitionByExpression [acc#" in x and x.rstrip().endswith(f", {n}")]) == 4
    counts = queries.microbe_threshold_counts(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len([x for x in counts.splitlines() if "RepartitionByExpression [acc#" in x and x.rstrip().endswith(f", {n}")]) == 1


def test_deals_into_many_tasks_hold_no_file_split(spark, monkeypatch, tmp_path):
    rng = random.Random(8)
    h = [(rng.choice([1, 1, 2, 5]), f"S{rng.randrange(300)}", rng.choice([None, 0.0, 0.1, 0.5, 2.0])) for _ in range(3000)]
    m = [(rng.choice([11, 11, 12, 15]), f"S{rng.randrange(300)}", rng.choice([0.1, 0.5, 2.0]), "V") for _ in range(2000)]
    for rows, schema, name in ((h, schemas.HOST, "h"), (m, schemas.MICROBE, "m")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    hosts, microbes = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("h", "m"))
    pairs, levels = spark.createDataFrame([(i, 10 + j, "V", "h", "p") for i in (1, 2, 3) for j in (1, 2)], schemas.PAIRS), (0.1, 0.4)
    passing = lambda rows, t, x: {r[1] for r in rows if r[0] == t and r[2] is not None and r[2] >= x}
    monkeypatch.setattr(deal, "ROWS", 10)  # 300 tasks
    for direct, coarse in ((200, 1), (300, 0)):
        monkeypatch.setattr(deal, "DIRECT", direct)
        joint, counts = thresholds.shared_counts(hosts, microbes, pairs, levels), thresholds.threshold_counts(hosts, pairs.select(F.col("host_tax_id").alias("tax_id")), levels)
        for df, times in ((joint, 2), (counts, 1)):
            deals = [x for x in plan(df).splitlines() if "Exchange hashpartitioning(acc" in x]
            assert [sum(f", {n}), REPARTITION_BY_NUM" in x for x in deals) for n in (200, 300)] == [coarse * times, times]
            # whatever passes no threshold is dropped below the first deal
            assert "Filter" in plan(df).split("Exchange hashpartitioning(acc")[-1]
        assert {(r["tax_id"], r["threshold"]): r["n"] for r in counts.collect()} == {(t, x): len(passing(h, t, x)) for t in (1, 2, 3) for x in levels}
        assert {tuple(r)[:4]: r[4] for r in joint.collect()} == {(i, j, x, y): len(passing(h, i, x) & passing(m, j, y)) for i in (1, 2, 3) for j in (11, 12) for x in levels for y in levels}


def test_vectors_are_summed_as_products_and_rounded_without_decimals(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"S{rng.randrange(60):02}", rng.randrange(9), rng.choice([None, rng.random()])) for _ in range(4000)]
    a = spark.createDataFrame(rows, schemas.ABUNDANCE).repartition(3)
    got = {r["acc"]: np.array(r["embedding"]) for r in embed.dataset_vectors(a, 70).collect()}
    want = defaultdict(lambda: np.zeros(70))
    for acc, t, x in rows:
        want[acc] += (x or 0.0) * embed.signs([str(t)], 70)[0] / math.sqrt(70)
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
    text = plan(queries.QUERIES["dataset_embeddings"](spark, SF)) + plan(queries.QUERIES["dataset_vectors"](spark, SF))
    assert "round(" not in text and text.count("lambdafunction") == 1
