"""Every study query equals its direct SQL on the smallest tables."""

import os

import duckdb
import pytest

from cohabit.config import THRESHOLDS
from cohabit.plans.oracles import ORACLES
from cohabit.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("lineitem", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def norm(rows, order):
    show = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(show(r[i]) for i in order) for r in rows), key=str)


def test_same_names():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    sql = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    names = sorted(df.columns)
    assert norm(df.collect(), [df.columns.index(c) for c in names]) == norm(sql.fetchall(), [sql.columns.index(c) for c in names])


@pytest.mark.parametrize("name", ["threshold_set_intersections", "hypergeom_score", "log_odds", "log_odds_local", "cooccurrence_metrics", "fisher_p", "auc_summary", "auc_grid", "roc_label_text"])
def test_whole_grid(spark, name):
    combos = QUERIES[name](spark, SF).select("host_threshold", "path_threshold").distinct().count()
    assert combos == len(THRESHOLDS) ** 2 == 900


def test_whole_projection(spark):
    for name in ("taxon_embeddings", "dataset_embeddings", "sign_table"):
        assert QUERIES[name](spark, SF).agg({"dim": "max"}).first()[0] == 511


def test_whole_sample(spark):
    sampled = {r[0]: r[1] for r in QUERIES["sample_pairs"](spark, SF).groupBy("Interaction_type").count().collect()}
    pairs = {r[0]: r[1] // 900 for r in QUERIES["label_counts"](spark, SF).collect()}
    assert sampled == {k: min(n, 100) for k, n in pairs.items()} and max(sampled.values()) > 20


def test_coverage_sees_every_taxon(spark):
    got = {r["key"]: (r["in_meta"], r["in_data"], r["only_meta"], r["only_data"]) for r in QUERIES["coverage_report"](spark, SF).collect()}
    assert got == {"host_tax_id": (20, 20, 0, 0), "path_tax_id": (10, 10, 0, 0)}


def test_intersections_collect_no_lists(spark):
    plan = QUERIES["threshold_set_intersections"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "array_intersect" not in plan
