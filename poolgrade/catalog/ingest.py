"""Scans, ingest rules and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.identity import outfield, with_row_index
from ..operators.measures import (
    MEASURES,
    adjusted_cost,
    style_ratio,
    successful_actions,
    with_feed_values,
    with_measures,
    with_minutes_share,
)
from ..operators.pools import eligible, study_rows
from ..sources import feed, pages, seasons, sheets
from ..sources.tables import match_feed, part_sheet, table
from . import query
from .base import BASE_SQL, rounded, sheet, tidy, with_base

C = F.col
MEASURE_NAMES = list(MEASURES)


@query(
    "p1_base_measures",
    "P1 P3 P4 P5 X13",
    with_base(
        select="SELECT player_id, "
        + rounded([n for n in MEASURE_NAMES if n not in ("interceptions", "clearances", "duel_efficiency")])
        + ", "
        + rounded(["minutes_share"])
        + ", round(interceptions_raw + 1e-10, 6) AS interceptions, round(clearances_raw + 1e-10, 6) AS clearances, "
        "round(duel_efficiency_sheet + 1e-10, 6) AS duel_efficiency FROM meas"
    ),
)
def _(spark, folder):
    df = with_measures(with_minutes_share(sheet(spark, folder)))
    return tidy(df, "player_id", "minutes_share", *MEASURE_NAMES)


@query(
    "p2_minutes_share",
    "P2 F1 F3",
    with_base(select="SELECT player_id, family, minutes, round(minutes_share + 1e-10, 6) AS minutes_share FROM pool"),
)
def _(spark, folder):
    df = eligible(outfield(with_minutes_share(sheet(spark, folder))))
    return tidy(df, "player_id", "family", "minutes", "minutes_share")


@query(
    "p5_feed_refresh",
    "P5 P6 P7 P8",
    with_base(
        "a AS (SELECT *, interception_won_p90 + total_clearance_p90 + duels_def * duels_def_rate + outfielder_block_p90 AS actions, "
        "duels_def * (1e0 - duels_def_rate) AS lost FROM meas)",
        "b AS (SELECT *, lost + greatest(0e0, fouls - 0.45e0 * lost) AS cost0, total_clearance_p90 + duels_air AS line FROM a)",
        select="SELECT player_id, round(interceptions + 1e-10, 6) AS interceptions, round(clearances + 1e-10, 6) AS clearances, "
        "round(duel_efficiency + 1e-10, 6) AS duel_efficiency, round(actions + 1e-10, 6) AS actions, "
        "round(CASE WHEN actions <> 0 THEN cost0 / actions ELSE cost0 END + 1e-10, 6) AS cost, "
        "round(CASE WHEN line <> 0 THEN (duels_def + interception_won_p90) / line ELSE 0e0 END + 1e-10, 6) AS style FROM b",
    ),
)
def _(spark, folder):
    df = with_feed_values(with_measures(part_sheet(spark, folder)))
    df = df.withColumn("actions", successful_actions())
    df = df.withColumns({"cost": adjusted_cost(C("actions")), "style": style_ratio()})
    return tidy(df, "player_id", "interceptions", "clearances", "duel_efficiency", "actions", "cost", "style")


@query(
    "f2_study_rows",
    "F2 P9",
    with_base(
        select="SELECT player_id, minutes, round(duels_def * (minutes / 90e0) + 1e-10, 6) AS n_duels FROM meas "
        "WHERE minutes >= 400 AND minutes_share > 0.2e0 AND foot_raw IS NOT NULL"
    ),
)
def _(spark, folder):
    df = study_rows(with_minutes_share(sheet(spark, folder)), ["duels_def", "duels_def_pct", "foot_raw"])
    return tidy(df.withColumn("n_duels", C("duels_def") * (C("minutes") / 90.0)), "player_id", "minutes", "n_duels")


@query(
    "p10_identity",
    "P10 P11 P12 P13 X2",
    "WITH " + BASE_SQL.strip() + " SELECT p_partkey, label, player_id, position, family, foot, birth_year, "
    "2030 - birth_year AS age_then, CAST(row_number() OVER (ORDER BY name, club, p_partkey) - 1 AS BIGINT) AS row_index FROM sheet",
)
def _(spark, folder):
    df = with_row_index(sheet(spark, folder), [C("name"), C("club"), C("p_partkey")], "p_partkey")
    return df.select(
        "p_partkey", "label", "player_id", "position", "family", "foot", "birth_year",
        (F.lit(2030) - C("birth_year")).alias("age_then"), "row_index",
    )


@query(
    "s1_sheet_with_fallback",
    "S1 S3 S4",
    "SELECT p_partkey AS k, p_name AS name, coalesce(p_brand, '') AS club, CAST(p_size AS DOUBLE) AS passes, "
    "p_retailprice AS duels_air, 0e0 AS crosses, 'alternate' AS source FROM part",
)
def _(spark, folder):
    raw = table(spark, folder, "part").select(
        C("p_partkey").cast("string").alias("k"),
        C("p_name").alias("Jogador"),
        F.when(C("p_size") > 25, C("p_brand")).alias("Equipa"),
        C("p_brand").alias("Equipa__1"),
        C("p_size").cast("string").alias("Passes/90"),
        C("p_retailprice").alias("Duelos aéreos/90"),
        C("p_type").alias("Cruzamentos/90"),
    )
    merged = sheets.merge_duplicate_headings(raw)
    typed, source = sheets.first_usable([("preferred", merged.limit(0)), ("alternate", merged)], 1, 50)
    out = sheets.resolve_headings(typed, ["name", "club", "passes", "duels_air", "crosses"], keep=["k"])
    return out.withColumn("source", F.lit(source)).withColumn("k", C("k").cast("bigint"))


@query(
    "s2_season_scan",
    "S2 U1 X12",
    "SELECT year(o_orderdate) AS season, CASE WHEN o_orderstatus = 'O' THEN 'B' ELSE 'A' END AS league, "
    "count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_custkey",
        F.year("o_orderdate").alias("y"),
        F.when(C("o_orderstatus") == "O", "B").otherwise("A").alias("l"),
    )
    files = seasons.write_season_files(orders, "y", "l")
    return seasons.season_scan(spark, files).groupBy("season", "league").agg(
        F.count(F.lit(1)).alias("orders"), F.countDistinct("o_custkey").alias("customers")
    )


FEED_SQL = """feed0 AS (SELECT user_id AS player_id, 'user ' || user_id AS player_name,
  strftime(ts, '%Y-%m-%d') AS event_id, CAST(floor(value / 10) AS BIGINT) AS minutes_played,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'away ' || event_type END AS team,
  CAST(floor(value) AS BIGINT) AS interception_won, CAST(event_type = 'click' AS BIGINT) AS total_clearance,
  CAST(value > 50 AS BIGINT) AS outfielder_block, CAST(length(props) AS BIGINT) AS ball_recovery FROM events),
feed AS (SELECT * FROM feed0 WHERE minutes_played > 0)"""


@query(
    "s5_feed_scan",
    "S5",
    f"WITH {FEED_SQL} SELECT team, count(*) AS rows_kept, CAST(sum(minutes_played) AS BIGINT) AS minutes FROM feed GROUP BY team",
)
def _(spark, folder):
    return feed.played(match_feed(spark, folder)).groupBy("team").agg(
        F.count(F.lit(1)).alias("rows_kept"), F.sum("minutes_played").alias("minutes")
    )


@query(
    "a1_feed_rollup",
    "A1 A2 A3 J6 U4",
    f"""WITH {FEED_SQL},
 teams AS (SELECT player_id, team, sum(minutes_played) AS m FROM feed GROUP BY ALL),
 main AS (SELECT player_id, team AS primary_team FROM teams QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY m DESC, team) = 1),
 agg AS (SELECT player_id, player_name, CAST(sum(minutes_played) AS BIGINT) AS minutes_played, count(DISTINCT event_id) AS matches,
   CAST(sum(interception_won) AS BIGINT) AS interception_won, CAST(sum(total_clearance) AS BIGINT) AS total_clearance,
   CAST(sum(outfielder_block) AS BIGINT) AS outfielder_block, CAST(sum(ball_recovery) AS BIGINT) AS ball_recovery
   FROM feed GROUP BY ALL)
 SELECT agg.*, primary_team, round(interception_won / CAST(minutes_played AS DOUBLE) * 90e0 + 1e-10, 6) AS interception_won_p90,
  round(total_clearance / CAST(minutes_played AS DOUBLE) * 90e0 + 1e-10, 6) AS total_clearance_p90,
  round(outfielder_block / CAST(minutes_played AS DOUBLE) * 90e0 + 1e-10, 6) AS outfielder_block_p90,
  round(ball_recovery / CAST(minutes_played AS DOUBLE) * 90e0 + 1e-10, 6) AS ball_recovery_p90
 FROM agg JOIN main USING (player_id)""",
)
def _(spark, folder):
    return tidy(feed.roll_up(match_feed(spark, folder)))


@query(
    "s6_stored_documents",
    "S6 U1",
    "SELECT 'F' || c_mktsegment AS position_family, count(*) AS players, round(max(c_acctbal) + 1e-10, 6) AS best "
    "FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY ALL",
)
def _(spark, folder):
    docs = table(spark, folder, "customer").select(
        C("c_custkey").cast("string").alias("player_id"),
        C("c_name").alias("name"),
        F.struct(C("c_acctbal").alias("geral")).alias("ratings"),
        F.concat(F.lit("F"), C("c_mktsegment")).alias("position_family"),
    )
    path = sheets.write_documents(docs, "position_family")
    family = sheets.read_documents(spark, path, docs.schema, family="FBUILDING")
    return family.groupBy("position_family").agg(
        F.count(F.lit(1)).alias("players"), F.round(F.max("ratings.geral"), 6).alias("best")
    )


@query(
    "s7_page_links",
    "S7 U4",
    """WITH hits AS (SELECT page_id, regexp_extract_all(html, '<a[^>]*href="/([^"?]+)"[^>]*>([^<]*)</a>', 1) AS ids,
   regexp_extract_all(html, '<a[^>]*href="/([^"?]+)"[^>]*>([^<]*)</a>', 2) AS labels FROM pages),
 flat AS (SELECT page_id, unnest(range(len(ids))) AS pos, ids, labels FROM hits),
 items AS (SELECT page_id, pos, ids[pos + 1] AS id, trim(labels[pos + 1]) AS label FROM flat)
 SELECT page_id, id, label FROM items WHERE label <> '' QUALIFY row_number() OVER (PARTITION BY page_id, id ORDER BY pos) = 1""",
)
def _(spark, folder):
    return pages.links(table(spark, folder, "pages"), "page_id", "html")
