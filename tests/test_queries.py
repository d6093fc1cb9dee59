"""Registered queries against their SQL on the smallest tables, and the shape of the plans."""

import pytest

from check import connect, differences
from poolgrade.catalog import load
from poolgrade.operators import ranks

FOLDER = "/root/testdata/sf0.001"
ENTRIES = load()
CHECKED = [n for n, e in ENTRIES.items() if e.sql is not None]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, con, name):
    rows, problem = differences(spark, con, FOLDER, ENTRIES[name])
    assert problem == "" and rows > 0


@pytest.mark.parametrize(
    "name", ["w1_dense_percentile", "w5_mean_percentile_of_score", "w8_sequential_rank", "n1_clipped_z", "n15_legacy_rating", "n20_fullback_ratings"]
)
def test_query_matches_sql_with_many_cuts(spark, con, monkeypatch, name):
    monkeypatch.setattr(ranks, "BUCKET_VALUES", 50)
    monkeypatch.setattr(ranks, "FREQUENT", 100)
    assert differences(spark, con, FOLDER, ENTRIES[name])[1] == ""


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql is None])
def test_query_without_sql_has_rows(spark, name):
    assert ENTRIES[name].run(spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", ["w1_dense_percentile", "n4_block_composites", "a8_label_shares", "f4_server_search", "j14_enrichment_cascade"])
def test_plans_have_no_cartesian_product_or_python(spark, name):
    plan = ENTRIES[name].run(spark, FOLDER)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


@pytest.mark.parametrize("name", ["w1_dense_percentile", "w8_sequential_rank", "a4_pool_statistics", "p10_identity"])
def test_no_window_holds_a_whole_pool_of_values(spark, monkeypatch, name):
    """Windows over values are cut into buckets; only tables of bucket totals have one window per pool."""
    plans = []
    write = ranks.settle
    monkeypatch.setattr(ranks, "settle", lambda df, *a: plans.append(df) or write(df, *a))
    plans.append(ENTRIES[name].run(spark, FOLDER))
    for df in plans:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line and "_rows0" not in line and "_values0" not in line and "sum(_rows" not in line:
                assert "_bucket" in line.rsplit("], [", 2)[-2], line


def test_search_reaches_the_scan(spark):
    from poolgrade.operators.search import Filters, search_index
    from poolgrade.sources.tables import table

    rows = table(spark, FOLDER, "customer").selectExpr(
        "c_custkey AS player_id", "c_mktsegment AS position_family", "c_acctbal AS rating", "c_name AS label", "c_name AS club"
    )
    plan = search_index(rows, Filters(family="BUILDING", rating=(0, 9000)))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(c_mktsegment)" in plan or "EqualTo(c_mktsegment,BUILDING)" in plan
    assert "c_nationkey" not in plan.split("ReadSchema")[1]


def test_share_sums_and_ranks(spark):
    from pyspark.sql import functions as F

    rated = ENTRIES["n7_family_ratings"].run(spark, FOLDER)
    assert rated.groupBy("family").agg(F.min("rank_geral").alias("m")).where("m <> 1").count() == 0
    shares = ENTRIES["c1_profile_by_margin"].run(spark, FOLDER)
    total = sum(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(1, 5))
    assert shares.where(F.abs(total - 1) > 1e-5).count() == 0
