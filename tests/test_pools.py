"""Hand-computed pools for ranks, z-scores, residuals and scales, with few and with many cuts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from poolgrade.functions.scalar import best_label, exact_round, row_median, row_sd, softmax_shares
from poolgrade.operators import pools, ranks
from poolgrade.plans.common import minutes_confidence, shrink
from poolgrade.plans.centrebacks import balance_bonus, legacy_component, stepped_bonus


@pytest.fixture(params=["as set", "many cuts", "no broadcast"])
def way(request, monkeypatch):
    if request.param == "many cuts":
        monkeypatch.setattr(ranks, "BUCKET_VALUES", 2)
        monkeypatch.setattr(ranks, "FREQUENT", 5)
    if request.param == "no broadcast":
        monkeypatch.setattr(ranks, "BROADCAST_ROWS", 0)
    return request.param


def frame(spark, values, pool="p"):
    rows = [(i, pool, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, pool string, v double")


def ranked(spark, values, kind):
    out = ranks.rank_columns(frame(spark, values), ["pool"], "id", {"out": ("v", kind)})
    return [r["out"] for r in out.orderBy("id").collect()]


@pytest.mark.parametrize(
    "values, kind, expected",
    [
        ([10, 20, 20, 40], "dense", [0, 50, 50, 100]),
        ([5, 5, 5], "dense", [100, 100, 100]),
        ([7], "dense", [100]),
        ([10, 20, 20, 40], "reversed", [100, 100 / 3, 100 / 3, 0]),
        ([5, 5, 5], "reversed", [100, 100, 100]),
        ([1, 2, 2, 4], "mean", [12.5, 50, 50, 87.5]),
        ([1, 2, 2, 4], "average", [0.25, 0.625, 0.625, 1.0]),
        ([9, 9, 8], "rank", [1, 1, 3]),
        ([9, 9, 8], "normalised", [100, 100, 0]),
        ([1, 2, 2, 4], "ecdf", [0.25, 0.75, 0.75, 1.0]),
    ],
)
def test_rank_kinds(spark, way, values, kind, expected):
    assert ranked(spark, values, kind) == pytest.approx(expected)


def test_null_values_have_no_rank(spark, way):
    assert ranked(spark, [1, None, 3], "dense") == [0, None, 100]


def test_rank_against_brute_force_with_a_hot_value(spark, way):
    rng = random.Random(7)
    pools_ = {"a": 3000, "b": 40}
    rows = []
    for pool, size in pools_.items():
        for _ in range(size):
            value = 0.0 if rng.random() < 0.34 else rng.gauss(0, 1e6) if rng.random() < 0.5 else rng.randint(-5, 5)
            rows.append((len(rows), pool, float(value)))
    df = spark.createDataFrame(rows, "id long, pool string, v double").repartition(7)
    out = ranks.rank_columns(
        df, ["pool"], "id", {"dense": ("v", "dense"), "place": ("v", "rank"), "share": ("v", "average")}
    )
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for pool in pools_:
        values = sorted(v for _, p, v in rows if p == pool)
        levels = sorted(set(values))
        below = {v: values.index(v) for v in levels}
        upto = {v: len(values) - values[::-1].index(v) for v in levels}
        at = {v: i for i, v in enumerate(levels)}
        for i, p, v in rows:
            if p == pool:
                assert got[i]["dense"] == pytest.approx(100 * at[v] / (len(levels) - 1))
                assert got[i]["place"] == len(values) - upto[v] + 1
                assert got[i]["share"] == pytest.approx((below[v] + 1 + upto[v]) / 2 / len(values))


def test_finer_cuts_give_the_same_ranks(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_VALUES", 1)
    values = [float((i * 37) % 211) for i in range(500)]
    want = [100.0 * sorted(set(values)).index(v) / (len(set(values)) - 1) for v in values]
    assert ranked(spark, values, "dense") == pytest.approx(want)


def test_ordinal_has_no_ties(spark, way):
    out = ranks.ordinal(frame(spark, [5, 7, 7, 1]), ["pool"], [-F.col("v"), F.col("id")], "id")
    assert [r["rank"] for r in out.orderBy("id").collect()] == [3, 1, 2, 4]


def test_quantiles(spark, way):
    df = frame(spark, [1, 2, 3, 4, 100])
    row = pools.exact_quantiles(df, ["pool"], {"v": "v"}, {"median": 0.5, "p95": 0.95, "low": 0.0}).first()
    assert (row["median"], row["low"]) == (3, 1)
    assert row["p95"] == pytest.approx(80.8)


def test_clipped_z(spark, way):
    out = pools.clipped_z(frame(spark, [0, 0, 0, 0, 10]), ["pool"], {"v": "v"})
    assert [r["z_v"] for r in out.orderBy("id").collect()] == [0, 0, 0, 0, 2]


@pytest.mark.parametrize("values", [[3, 3], [3]])
def test_z_without_spread_is_zero(spark, way, values):
    z = pools.clipped_z(frame(spark, values), ["pool"], {"v": "v"})
    m = pools.mean_z(z, ["pool"], {"v": "v"})
    assert {(r["z_v"], r["mz_v"]) for r in m.collect()} == {(0.0, 0.0)}


def test_linear_scale(spark):
    out = pools.linear_100(frame(spark, [1, 2, 3]), ["pool"], {"out": "v"})
    assert [r["out"] for r in out.orderBy("id").collect()] == [35, 50, 65]


@pytest.mark.parametrize(
    "xs, ys, expected",
    [([1, 1], [2, 3], [-0.5, 0.5]), ([1, 2, 3, 4], [2, 3.5, 3, 7], [0.3, 0.35, -1.6, 0.95])],
)
def test_residuals(spark, xs, ys, expected):
    rows = [(i, "p", float(x), float(y)) for i, (x, y) in enumerate(zip(xs, ys))]
    df = spark.createDataFrame(rows, "id long, pool string, x double, y double")
    out = pools.residuals(df, ["pool"], {"out": ("y", "x")})
    assert [r["out"] for r in out.orderBy("id").collect()] == pytest.approx(expected)


def test_row_expressions(spark):
    row = spark.range(1).select(
        row_median([F.lit(x) for x in (5.0, 1.0, 9.0)]).alias("median"),
        row_sd([F.lit(x) for x in (2.0, 4.0)]).alias("sd"),
        balance_bonus([F.lit(50.0)] * 5).alias("bonus"),
        stepped_bonus(F.lit(80.0)).alias("b80"),
        stepped_bonus(F.lit(85.0)).alias("b85"),
        stepped_bonus(F.lit(95.0)).alias("b95"),
        legacy_component(F.lit(85.0)).alias("twice"),
        best_label([("a", F.lit(1.0)), ("b", F.lit(1.0))]).alias("first"),
        exact_round(F.lit(6.35), 1).alias("exact"),
        *[s.alias(f"s{i}") for i, s in enumerate(softmax_shares([F.lit(1.0), F.lit(0.0), F.lit(0.0)]))],
    ).first()
    assert (row["median"], row["sd"], row["bonus"], row["b80"]) == (5, 1, 3, 80)
    assert (row["b85"], row["b95"]) == pytest.approx((89.25, 104.5))
    assert row["twice"] == pytest.approx(5 + 89.25 * 1.05 * 0.045)
    assert (row["first"], row["exact"]) == ("a", 6.3)
    assert [round(row[f"s{i}"], 1) for i in range(3)] == [57.6, 21.2, 21.2]


def test_shrinkage_and_confidence(spark):
    row = spark.range(1).select(
        shrink(F.lit(80.0), F.lit(1.0), 50.0).alias("full"),
        shrink(F.lit(80.0), F.lit(0.0), 50.0).alias("none"),
        *[minutes_confidence(F.lit(x)).alias(f"c{i}") for i, x in enumerate((0.0, 75.0, 75.1, 100.0))],
    ).first()
    assert (row["full"], row["none"]) == (80, 50)
    assert [row[f"c{i}"] for i in range(4)] == pytest.approx([0.70, 1.0, 1.0, 1.0])


def test_shrinkage_stays_between_value_and_mean(spark):
    df = spark.range(0, 200).select((F.col("id") % 101).cast("double").alias("x"), (F.rand(3)).alias("s"))
    out = df.select("x", shrink(F.col("x"), F.col("s"), 50.0).alias("y"))
    assert out.where("abs(y - 50) > abs(x - 50) + 1e-9").count() == 0


def test_quadratic_fit_matches_normal_equations(spark):
    import numpy as np

    from poolgrade.plans.studies import expected, quadratic_fits, with_fits

    rng = np.random.default_rng(3)
    v = rng.uniform(1, 9, 60)
    y = 3 + 0.7 * v - 0.05 * v * v + rng.normal(0, 0.1, 60)
    df = spark.createDataFrame([("p", float(a), float(b)) for a, b in zip(v, y)], "family string, v double, y double")
    fits = {"m": (F.col("v"), F.col("y"))}
    coefficients = quadratic_fits(df, ["family"], fits)
    row = coefficients.first()
    want = np.polyfit(v, y, 2)
    assert [row["b2_m"], row["b1_m"], row["b0_m"]] == pytest.approx(list(want))
    line = spark.createDataFrame([("p", 1.0, 2.0), ("p", 3.0, 6.0)], "family string, v double, y double")
    two = with_fits(line, quadratic_fits(line, ["family"], fits), ["family"])
    assert [r[0] for r in two.select(F.col("y") - expected("m", F.col("v"))).collect()] == pytest.approx([0, 0], abs=1e-9)


def test_agreement_of_identical_and_crossed_labels(spark):
    from poolgrade.operators.clusters import label_agreement

    same = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "b")], "x string, y string")
    row = label_agreement(same, "x", "y").first()
    assert (row["agree_pct"], row["ari"]) == (100, 1) and math.isclose(row["nmi"], 1)
    cross = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")], "x string, y string")
    row = label_agreement(cross, "x", "y").first()
    assert (row["agree_pct"], row["ari"]) == pytest.approx((50, -0.5)) and math.isclose(row["nmi"], 0, abs_tol=1e-12)
