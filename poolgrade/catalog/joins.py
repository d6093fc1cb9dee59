"""Enrichment joins on customers, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as j
from ..sources.tables import table
from . import query
from .base import pool, r, rounded, tidy, with_base

C = F.col


@query(
    "j1_score_join",
    "J1",
    f"SELECT c_custkey AS player_id, {r('coalesce(CASE WHEN o.total > 0 THEN o.total END, CASE WHEN c_acctbal > 0 THEN c_acctbal END, 50e0)', 'score')} FROM customer "
    "LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY 1) o ON o_custkey = c_custkey",
)
def _(spark, folder):
    players = table(spark, folder, "customer").selectExpr(
        "c_custkey AS player_id", "CASE WHEN c_acctbal > 0 THEN c_acctbal END AS score"
    )
    scores = (
        table(spark, folder, "orders")
        .where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
        .groupBy(C("o_custkey").alias("player_id"))
        .agg(F.max("o_totalprice").alias("score"))
    )
    return tidy(j.with_scores(players, scores, "player_id", ["score"]))


@query(
    "j2_outer_merge",
    "J2",
    "SELECT l_partkey, l_suppkey, "
    + ", ".join(r(f"max(l_extendedprice) FILTER (l_returnflag = '{flag}')", name) for name, flag in (("accepted", "A"), ("pending", "N"), ("returned", "R")))
    + " FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY l_partkey, l_suppkey",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem")
    frames = {
        name: lines.where(C("l_returnflag") == flag).groupBy("l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("score"))
        for name, flag in (("accepted", "A"), ("pending", "N"), ("returned", "R"))
    }
    return tidy(j.merge_metrics(frames, ["l_partkey", "l_suppkey"]))


@query(
    "j3_pool_with_raw",
    "J3 J4",
    with_base(
        select="SELECT player_id, p.p_partkey, pool.name, p.p_name AS name_raw, p.p_size, " + rounded("passes") + " FROM pool JOIN part p ON pool.p_partkey = p.p_partkey"
    ),
)
def _(spark, folder):
    people = pool(spark, folder).select("p_partkey", "player_id", "name", "passes")
    raw = table(spark, folder, "part").select("p_partkey", C("p_name").alias("name"), "p_size")
    kept = j.only_in(raw, people, "p_partkey")
    return tidy(j.with_raw_columns(people, kept, "p_partkey"), "player_id", "p_partkey", "name", "name_raw", "p_size", "passes")


@query(
    "j5_without_enrichment",
    "J5 U5",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') "
    "AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH')",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    people = table(spark, folder, "customer").select("c_custkey")
    first = orders.where("o_orderpriority = '1-URGENT'")
    second = orders.where("o_orderpriority = '2-HIGH'")
    return j.unresolved(people, "c_custkey", first, second)


CASCADE_SQL = """cache AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY 1),
 prim AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' GROUP BY 1),
 rost AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
 cas AS (SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 8000 THEN 'own' END, 'cache ' || cache.v, 'primary ' || prim.v, 'roster ' || rost.v) AS transfermarkt,
   CASE WHEN c_acctbal > 8000 THEN 'existing' WHEN cache.v IS NOT NULL THEN 'cache' WHEN prim.v IS NOT NULL THEN 'primary' WHEN rost.v IS NOT NULL THEN 'roster' END AS origin
   FROM customer LEFT JOIN cache ON cache.k = c_custkey LEFT JOIN prim ON prim.k = c_custkey LEFT JOIN rost ON rost.k = c_custkey)"""


def cascaded(spark, folder):
    players = table(spark, folder, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_acctbal > 8000 THEN 'own' END AS transfermarkt"
    )
    orders = table(spark, folder, "orders")
    rules = {
        "cache": "o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'",
        "primary": "o_orderpriority = '2-HIGH' AND o_orderstatus = 'O'",
        "roster": "o_orderstatus = 'P'",
    }
    sources = {
        name: orders.where(rule)
        .groupBy(C("o_custkey").alias("c_custkey"))
        .agg(F.concat(F.lit(f"{name} "), F.min("o_orderkey").cast("string")).alias("transfermarkt"))
        for name, rule in rules.items()
    }
    return j.cascade(players, sources, "c_custkey", "transfermarkt")


@query("j14_enrichment_cascade", "J14", f"WITH {CASCADE_SQL} SELECT * FROM cas")
def _(spark, folder):
    return cascaded(spark, folder)


@query(
    "j14_recovered",
    "J14",
    f"WITH {CASCADE_SQL} SELECT count(*) FILTER (origin = 'roster') AS recovered, count(*) AS players FROM cas",
)
def _(spark, folder):
    return j.recovered(cascaded(spark, folder), "roster")


@query(
    "j15_named_rows",
    "J15 U4",
    """WITH site AS (SELECT p_partkey AS player_id, p_name AS name, CASE WHEN p_size < 20 THEN 'brand#1' WHEN p_size < 40 THEN 'Brand#2 FC' ELSE 'Outro' END AS club FROM part),
     hit AS (SELECT site.player_id, min(t.p_partkey) FILTER (contains(lower(t.p_brand), lower(string_split(site.club, ' ')[1]))) AS near, min(t.p_partkey) AS anyone
       FROM site JOIN part t ON t.p_name = site.name GROUP BY site.player_id)
     SELECT player_id, coalesce(near, anyone) AS row_key FROM hit""",
)
def _(spark, folder):
    part = table(spark, folder, "part")
    site = part.selectExpr(
        "p_partkey AS player_id", "p_name AS name",
        "CASE WHEN p_size < 20 THEN 'brand#1' WHEN p_size < 40 THEN 'Brand#2 FC' ELSE 'Outro' END AS club",
    )
    rows = part.selectExpr("p_name AS name", "p_brand AS club", "p_partkey AS at")
    return j.match_named_rows(site, rows, "at")


@query(
    "j17_upsert",
    "J17",
    "SELECT c_custkey, coalesce(v, CASE WHEN c_acctbal > 0 THEN 'stored' END) AS transfermarkt FROM customer LEFT JOIN "
    "(SELECT o_custkey, 'new ' || count(*) AS v FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey HAVING count(*) >= 2) ON o_custkey = c_custkey",
)
def _(spark, folder):
    stored = table(spark, folder, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_acctbal > 0 THEN 'stored' END AS transfermarkt"
    )
    resolved = (
        table(spark, folder, "orders")
        .where("o_orderpriority = '1-URGENT'")
        .groupBy(C("o_custkey").alias("c_custkey"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n >= 2")
        .select("c_custkey", F.concat(F.lit("new "), C("n").cast("string")).alias("transfermarkt"))
    )
    return j.upsert(stored, resolved, "c_custkey", "transfermarkt")


@query(
    "u1_union_seasons",
    "U1 U4",
    "WITH s AS (SELECT o_custkey, o_orderkey, 'F' AS league, o_totalprice AS price, NULL AS pending FROM orders WHERE o_orderstatus = 'F' "
    "UNION ALL SELECT o_custkey, o_orderkey, 'P', NULL, o_orderpriority FROM orders WHERE o_orderstatus = 'P') "
    "SELECT o_custkey, o_orderkey, league, " + rounded("price") + ", pending FROM s QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY price DESC NULLS LAST, o_orderkey) = 1",
)
def _(spark, folder):
    from ..sources.seasons import union_seasons

    orders = table(spark, folder, "orders")
    done = orders.where("o_orderstatus = 'F'").selectExpr("o_custkey", "o_orderkey", "'F' AS league", "o_totalprice AS price")
    waiting = orders.where("o_orderstatus = 'P'").selectExpr("o_custkey", "o_orderkey", "'P' AS league", "o_orderpriority AS pending")
    stacked = union_seasons([done, waiting])
    order = [-F.coalesce("price", F.lit(-1.0)), C("o_orderkey")]
    return tidy(j.first_rows(stacked, ["o_custkey"], order), "o_custkey", "o_orderkey", "league", "price", "pending")
