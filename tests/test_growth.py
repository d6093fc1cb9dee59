"""Work that must not grow with repeated rows: kinds of players, names of files, centres of many models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolgrade.catalog import backs, load
from poolgrade.functions.scalar import exact_round
from poolgrade.operators import lloyd, matching
from poolgrade.plans import centrebacks as cb
from poolgrade.sources import seasons, tables

BORN, TALL = "birth_year", "height"


def test_players_alike_are_compared_once(spark, monkeypatch):
    sizes = {}
    settle = matching.settle

    def counted(df, name="stage"):
        out = settle(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(matching, "settle", counted)
    rows = [(q, "r bolt", "x", 1990, 180) for q in range(40)] + [(40, None, "x", None, None), (41, "r bolt", None, 1990, 180)]
    players = spark.createDataFrame([*rows, (None, "r bolt", "x", 1990, 180)], f"q long, name string, club string, {BORN} int, {TALL} int")
    roster = spark.createDataFrame([(7, "red bolt", "x", 1990, 180), (9, "blue rod", "x", 1990, 180)], f"c long, name string, club string, {BORN} int, {TALL} int")
    found = matching.match_roster(players, roster).collect()
    assert {(r["q"], r["match_id"]) for r in found} == {(q, 7) for q in range(40)}
    assert sizes["player-kinds"] == 3 and sizes["roster-pairs"] == 2


def test_a_repeated_key_takes_the_best_of_its_kinds(spark):
    players = spark.createDataFrame([(1, "r bolt", "x", 1990, 180), (1, "b rod", "x", 1990, 180), (2, "b rod", "x", 1990, 180)], f"q long, name string, club string, {BORN} int, {TALL} int")
    roster = spark.createDataFrame([(7, "red bolt", "x", 1990, 180), (9, "blue rod", "x", 1990, 180)], f"c long, name string, club string, {BORN} int, {TALL} int")
    found = {r["q"]: r["match_id"] for r in matching.match_roster(players, roster).collect()}
    assert found == {1: 7, 2: 9}  # 111 against 107 for 1, which leads by just 4


def test_without_a_club_players_alike_are_compared_once(spark, monkeypatch):
    sizes = {}
    settle = matching.settle

    def counted(df, name="stage"):
        out = settle(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(matching, "settle", counted)
    players = spark.createDataFrame([(q, "Red Bolt", 1990) for q in range(30)], "q long, name string, birth_year int")
    people = spark.createDataFrame([(5, "red bolt", 36), (6, "blue rod", 36)], "c long, name string, age int")
    found = matching.match_without_club(players, people, 2026).collect()
    assert {(r["q"], r["match_id"]) for r in found} == {(q, 5) for q in range(30)}
    assert sizes["player-kinds"] == 1 and sizes["variant-scores"] == 2


def test_file_names_are_read_once_per_file(spark):
    rows = spark.range(50).select("id", (F.lit(2020) + F.col("id") % 2).alias("y"), F.when(F.col("id") % 3 == 0, "B").otherwise("A").alias("l"))
    out = seasons.season_scan(spark, seasons.write_season_files(rows, "y", "l"))
    found = {(r["id"], r["season"], r["league"]) for r in out.select("id", "season", "league").collect()}
    assert found == {(i, 2020 + i % 2, "A" if i % 3 else "B") for i in range(50)}
    assert "try_url_decode" not in out.select("id", "season")._jdf.queryExecution().optimizedPlan().children().head().toString()


def test_nearest_is_the_first_of_equal_centres():
    draw = np.random.default_rng(1)
    x = np.round(draw.normal(size=(300, 11)), 9)
    centres = np.round(draw.normal(size=(40, 4, 11)), 9)
    centres[:, 3] = centres[:, 1]  # two clusters that began at the same row
    centres[:5, 2] = 2 * x[:5] - centres[:5, 0]  # as far from a row as another
    want = lloyd._distances(x, centres).argmin(axis=2)
    assert (lloyd.nearest(x, centres) == want).all() and not (want == 3).any()


def test_queries_alike_are_scored_once(spark, monkeypatch):
    sizes = {}
    settle = matching.settle

    def counted(df, name="stage"):
        out = settle(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(matching, "settle", counted)
    queries = spark.createDataFrame(
        [*[(q, "red bolt", "b1") for q in range(30)], (40, "red bolt", None), (41, "blue rod", "b9"), (41, "blue rod", "b9"), (None, "red bolt", "b1")],
        "q long, name string, club string",
    )
    fields = "name string, club string, c long, result_name string, result_club string"
    rows = [("red bolt", club, c, "red bolt", rc) for club in ("b1", None) for c, rc in ((5, "b1"), (3, "x"))]
    results = spark.createDataFrame([*rows, ("blue rod", "b9", 7, "blue rod", "x")], fields)
    found = {(r["q"], r["match_id"], r["score"]) for r in matching.pick_result(queries, results).collect()}
    assert found == {(q, 5, 125) for q in range(30)}  # 41 has two hits of 25 points, 40 no club
    assert sizes["result-kinds"] == 3


def test_axis_ratings_carry_only_what_they_read(spark, monkeypatch):
    seen = []
    made = {c: F.lit("p" if c in ("player_id", "family") else 1.0).alias(c) for c in (*cb.NEEDED, "xa", "crosses", "label")}
    monkeypatch.setattr(backs, "pool", lambda *_: spark.range(1).select(*made.values()))
    monkeypatch.setattr(backs, "settle", lambda df, name="stage": seen.append(df.columns) or df)
    monkeypatch.setattr(cb, "with_skill_indices", lambda df: (_ for _ in ()).throw(LookupError))
    with pytest.raises(LookupError):
        load()["n14_axis_ratings"].run(spark, "")
    assert seen == [list(cb.NEEDED)]


def test_a_part_is_identified_once_for_all_its_seasons(spark, tmp_path):
    spark.createDataFrame([(1, "Red Bolt", "Brand#1", "PROMO", 30), (2, "-Rod-", "Brand#2", "LARGE", 9)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    lines = spark.range(80).selectExpr(
        "id % 2 + 1 AS l_partkey", "cast(id % 7 + 1 AS int) AS l_linenumber", "cast(id AS double) AS l_quantity", "0.06D AS l_discount", "0.01D AS l_tax",
        "'A' AS l_returnflag", "'F' AS l_linestatus", "make_timestamp(1992 + cast(id % 4 AS int), 1, 1, 0, 0, 0) AS l_shipdate",
    )
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    counts = tables.season_counts(spark, str(tmp_path))
    join = counts._jdf.queryExecution().optimizedPlan().toString()
    assert join.index("Join") < join.index("regexp_replace")
    assert not {"passes", "duels_def_pct"} & set(counts.columns)
    rows = tables.season_sheet(counts).select("season", "league", "player_id", "position", "passes").collect()
    assert len(rows) == 4 and {(r["league"], r["player_id"]) for r in rows} == {("B", "red-bolt-brand-1-1"), ("A", "rod-brand-2-2")}


def test_rounding_leaves_the_text_only_near_ties(spark):
    draw = np.random.default_rng(2)
    values = [float(v) for v in draw.normal(scale=300, size=4000)] + [k / 8 + e for k in range(-80, 80) for e in (0.0, 1e-12)]
    values += [6.35, 84.95, -0.04, 0.0, -0.0, 1e9 + 0.25, 3e15, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (0, 1, 2):
        text = F.regexp_replace(F.format_number("v", places), ",", "").cast("double")
        shown = df.select(exact_round(F.col("v"), places).cast("string").alias("a"), text.cast("string").alias("b"))
        assert all(r["a"] == r["b"] for r in shown.collect())
    assert "rint" in df.select(exact_round(F.col("v"), 1))._jdf.queryExecution().optimizedPlan().toString().lower()
