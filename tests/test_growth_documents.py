"""What the documents of all families cost: ranks by lookup, text by arithmetic, seasons of the families that read them."""

import random

import pytest
from pyspark.sql import functions as F

from poolgrade.catalog import backs
from poolgrade.functions.scalar import comma_text, exact_text
from poolgrade.operators import ranks
from poolgrade.sources import tables


def ranked_rows(spark):
    rng = random.Random(4)
    rows = [(i, "ab"[i % 3 == 0], float(rng.randint(0, 6)), rng.random(), None if i % 5 else 1.0) for i in range(600)]
    rows += [(600, None, 1.0, 2.0, 3.0), (None, "a", 3.0, 0.5, 1.0), (7, "a", 6.0, 0.1, None)]
    df = spark.createDataFrame(rows, "id long, pool string, few double, many double, gaps double").repartition(4)
    wanted = {"a": ("few", "dense"), "b": ("many", "rank"), "c": ("gaps", "average"), "d": ("few", "mean"), "e": ("many", "reversed")}
    return df, wanted


def test_ranks_by_lookup_and_by_join_agree(spark, monkeypatch):
    df, wanted = ranked_rows(spark)
    told = []
    for most in (1_000_000, 60, 0):  # all columns looked up, those of few values, none
        monkeypatch.setattr(ranks, "BROADCAST_ROWS", most)
        out = ranks.rank_columns(df, ["pool"], "id", wanted)
        told.append(sorted(map(tuple, out.collect()), key=repr))
        assert ("_seek" in out._jdf.queryExecution().optimizedPlan().toString()) == (most < 1_000_000)
    assert told[0] == told[1] == told[2] and len(told[0]) == 602  # a row without an id is left out
    assert {r[5:] for r in told[0] if r[0] == 600} == {(None,) * 5}
    assert len({r[5] for r in told[0] if r[0] == 7}) == 1  # rows of one id share the greater rank


def test_values_are_written_once_per_distinct_value(spark, monkeypatch):
    sizes = {}
    write = ranks.settle_measured

    def counted(df, name, measures):
        out, seen = write(df, name, measures)
        sizes[name] = out.count()
        return out, seen

    monkeypatch.setattr(ranks, "settle_measured", counted)
    df = spark.range(900).select("id", F.lit("p").alias("pool"), (F.col("id") % 9).cast("double").alias("v"))
    assert ranks.rank_columns(df, ["pool"], "id", {"out": ("v", "dense")}).agg(F.max("out")).first()[0] == 100
    assert sizes == {"values": 9}


def test_fixed_decimals_are_those_of_the_formatter(spark):
    rng = random.Random(9)
    values = [rng.gauss(0, 400) for _ in range(3000)] + [k / 8 + e for k in range(-60, 60) for e in (0.0, 1e-12)]
    values += [0.05, 0.04, 6.35, 99.95, 999.95, 0.0, -0.0, 1234567.891, 1e9 + 0.25, 3e15, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (0, 1, 2):
        text = F.replace(F.format_number("v", places), F.lit(","), F.lit(""))
        got = df.select("v", exact_text(F.col("v"), places).alias("a"), text.alias("b"), comma_text(F.col("v"), places).alias("c"))
        assert [(r["v"], r["a"], r["b"]) for r in got.collect() if r["a"] != r["b"] or (r["a"] or "").replace(".", ",") != (r["c"] or "")] == []
    assert "rint" in df.select(exact_text(F.col("v"), 1))._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("known", [4_000_000, 0])
def test_seasons_of_one_family_are_those_of_all(spark, monkeypatch, tmp_path, known):
    kinds = ["ECONOMY", "ECONOMY", "PROMO", "LARGE", "MEDIUM", None]
    parts = [(i, f"rod {i}", "Brand#1", kinds[i % 6], 10 + 5 * (i % 7)) for i in range(24)]
    spark.createDataFrame([*parts, (None, "bolt", "b", "ECONOMY", 9)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(9000).selectExpr(
        "if(id % 97 = 0, NULL, id % 25) AS l_partkey", "cast(id % 7 + 1 AS int) AS l_linenumber", "cast(20 + id % 31 + id % 25 AS double) AS l_quantity",
        "0.01D * (id % 11) AS l_discount", "0.01D * (id % 9) AS l_tax", "substr('ARN', cast(id % 3 AS int) + 1, 1) AS l_returnflag", "if(id % 8 = 0, 'O', 'F') AS l_linestatus",
        "if(id % 89 = 0, NULL, make_timestamp(1992 + cast(id % 4 AS int), 1, 1, 0, 0, 0)) AS l_shipdate",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(backs, "STUDY_MINUTES", 500)
    monkeypatch.setattr(tables, "KNOWN_PARTS", known)
    whole, _ = backs.season_frames(spark, str(tmp_path))
    some, _ = backs.season_frames(spark, str(tmp_path), ["zagueiros"])
    want = sorted(map(repr, whole.where("family = 'zagueiros'").select(*some.columns).collect()))
    assert sorted(map(repr, some.collect())) == want and 0 < len(want) < whole.count()
    plan = tables.season_counts(spark, str(tmp_path), ["zagueiros"])._jdf.queryExecution().optimizedPlan().toString()
    assert ("LeftSemi" in plan) == (known > 0)
