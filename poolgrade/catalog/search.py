"""Search, facets, page aggregates, labels and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, text
from ..operators import search as s
from ..operators import stats
from ..operators.ranks import rank_columns
from ..sources.tables import table
from . import query
from .base import pct_ctes, pool, r, rounded, tidy, with_base

C = F.col
YEAR = 2026

INDEX_SQL = """ord AS (SELECT o_custkey, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o,
  count(*) FILTER (o_orderstatus = 'P') AS p, count(*) FILTER (o_orderpriority = '1-URGENT') AS u, count(*) FILTER (o_totalprice > 250000) AS big FROM orders GROUP BY o_custkey),
idx AS (SELECT CAST(c_custkey AS VARCHAR) AS player_id, c_name AS name, 'Clube ' || n_name AS club, c_name || ' (Clube ' || n_name || ')' AS label, n_name AS nationality,
  c_mktsegment AS position_family, CASE WHEN c_acctbal > 6000 THEN 'Construtor' WHEN c_acctbal > 2500 THEN 'Ofensivo' WHEN c_acctbal >= 0 THEN 'Defensivo' ELSE 'Híbrido' END AS profile,
  CASE WHEN c_nationkey < 10 THEN 'Destro' WHEN c_nationkey < 18 THEN 'Canhoto' END AS foot,
  CASE WHEN c_acctbal < -500 THEN NULL WHEN c_acctbal < 500 THEN 0 ELSE 160 + CAST(floor(c_acctbal / 250) AS INTEGER) END AS height,
  CASE WHEN c_acctbal >= 0 THEN 1985 + c_nationkey END AS birth_year,
  CAST(coalesce(orders, 0) * 90 AS INTEGER) AS minutes, 5e0 + c_acctbal / 2500e0 AS rating FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN ord ON o_custkey = c_custkey),
dos AS (SELECT CAST(o_custkey AS VARCHAR) AS player_id, CAST(f AS INTEGER) AS goals, CAST(u AS INTEGER) AS assists, 100e0 * f / orders AS construcao, 100e0 * o / orders AS ofensividade,
  100e0 * p / orders AS def1v1, 100e0 * u / orders AS contencao, 100e0 * big / orders AS duelo_aereo FROM ord)"""


def player_index(spark, folder):
    """Customers as the player index."""
    per = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    people = table(spark, folder, "customer").join(
        F.broadcast(table(spark, folder, "nation")), C("c_nationkey") == C("n_nationkey")
    )
    joined = people.join(per, C("o_custkey") == C("c_custkey"), "left")
    return joined.selectExpr(
        "cast(c_custkey AS string) AS player_id",
        "c_name AS name",
        "concat('Clube ', n_name) AS club",
        "concat(c_name, ' (Clube ', n_name, ')') AS label",
        "n_name AS nationality",
        "c_mktsegment AS position_family",
        "CASE WHEN c_acctbal > 6000 THEN 'Construtor' WHEN c_acctbal > 2500 THEN 'Ofensivo' WHEN c_acctbal >= 0 THEN 'Defensivo' ELSE 'Híbrido' END AS profile",
        "CASE WHEN c_nationkey < 10 THEN 'Destro' WHEN c_nationkey < 18 THEN 'Canhoto' END AS foot",
        "CASE WHEN c_acctbal < -500 THEN NULL WHEN c_acctbal < 500 THEN 0 ELSE 160 + cast(floor(c_acctbal / 250D) AS int) END AS height",
        "CASE WHEN c_acctbal >= 0 THEN 1985 + c_nationkey END AS birth_year",
        "cast(coalesce(orders, 0) * 90 AS int) AS minutes",
        "5D + c_acctbal / 2500D AS rating",
        "cast(NULL AS string) AS transfermarkt",
    )


def player_dossiers(spark, folder):
    """Order statistics as the stored dossiers of the customers that have orders."""
    per = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"),
        F.expr("count_if(o_orderstatus = 'F')").alias("f"),
        F.expr("count_if(o_orderstatus = 'O')").alias("o"),
        F.expr("count_if(o_orderstatus = 'P')").alias("p"),
        F.expr("count_if(o_orderpriority = '1-URGENT')").alias("u"),
        F.expr("count_if(o_totalprice > 250000)").alias("big"),
    )
    return per.selectExpr(
        "cast(o_custkey AS string) AS player_id",
        "cast(f AS int) AS goals",
        "cast(u AS int) AS assists",
        "named_struct('construcao', 100D * f / orders, 'ofensividade', 100D * o / orders, 'def1v1', 100D * p / orders,"
        " 'contencao', 100D * u / orders, 'duelo_aereo', 100D * big / orders) AS tendencies",
        "concat('value ', cast(big AS string)) AS transfermarkt",
    )


@query(
    "f4_server_search",
    "F4 F5",
    f"WITH {INDEX_SQL} SELECT player_id, label, " + rounded("rating")
    + """ FROM idx WHERE position_family = 'BUILDING' AND profile IN ('Construtor', 'Ofensivo', 'Híbrido')
    AND (height IS NULL OR height BETWEEN 0 AND 195) AND minutes BETWEEN 90 AND 1800 AND (birth_year IS NULL OR birth_year BETWEEN 1988 AND 2009)
    AND rating BETWEEN 4.5 AND 9 AND (contains(lower(label), 'nation_1') OR contains(lower(club), 'nation_1'))""",
)
def _(spark, folder):
    wanted = s.Filters(
        family="BUILDING", club="all", nationality="all", profiles=("Construtor", "Ofensivo", "Híbrido"),
        height=(0, 195), minutes=(90, 1800), birth_year=(1988, 2009), rating=(4.5, 9), search="NATION_1",
    )
    return tidy(s.search_index(player_index(spark, folder), wanted), "player_id", "label", "rating")


@query(
    "f6_tendency_search",
    "F6 J16",
    f"WITH {INDEX_SQL} SELECT idx.player_id, goals, assists, " + rounded("construcao contencao")
    + " FROM idx JOIN dos USING (player_id) WHERE construcao BETWEEN 20 AND 60 AND contencao BETWEEN 10 AND 100",
)
def _(spark, folder):
    rows = player_index(spark, folder).join(player_dossiers(spark, folder).drop("transfermarkt"), "player_id", "left")
    out = s.search_index(rows, s.Filters(tendencies={"construcao": (20, 60), "contencao": (10, 100)}))
    return tidy(out.select("player_id", "goals", "assists", "tendencies.construcao", "tendencies.contencao"))


@query(
    "f7_page_search",
    "F5 F7 P13 J16",
    f"WITH {INDEX_SQL} SELECT player_id, minutes, coalesce(goals, 0) AS goals, coalesce(assists, 0) AS assists, "
    + rounded(["rating"]) + ", " + r("coalesce(construcao, 0e0)", "construcao")
    + """, 'value ' || big AS transfermarkt FROM idx LEFT JOIN dos USING (player_id) LEFT JOIN (SELECT o_custkey, big FROM ord) ON CAST(o_custkey AS VARCHAR) = player_id
    WHERE (height IS NULL OR height = 0 OR height BETWEEN 170 AND 190) AND (birth_year IS NULL OR 2026 - birth_year BETWEEN 20 AND 35)
    AND foot = 'Destro' AND (contains(lower(name), '00') OR contains(lower(club), '00')) AND coalesce(construcao, 0) BETWEEN 0 AND 80""",
)
def _(spark, folder):
    rows = s.with_dossier_fields(player_index(spark, folder), player_dossiers(spark, folder))
    wanted = s.Filters(
        foot="Destro", height=(170, 190), age=(20, 35), search=" 00 ", tendencies={"construcao": (0, 80)}
    )
    out = s.search_rows(rows, wanted, YEAR)
    return tidy(
        out.select("player_id", "minutes", "goals", "assists", "rating", "tendencies.construcao", "transfermarkt")
    )


@query(
    "f8_cluster_filter",
    "F8",
    f"""WITH {INDEX_SQL}, cl AS (SELECT player_id, position_family IN ('BUILDING', 'MACHINERY') AS fb,
      CASE WHEN profile = 'Híbrido' THEN NULL WHEN position_family IN ('BUILDING', 'MACHINERY') THEN profile WHEN profile = 'Construtor' THEN 'Construtor' ELSE 'Combativo' END AS arch,
      CASE WHEN rating > 8 THEN 'Construtor Nato' WHEN rating > 7 THEN 'Construtor Âncora' END AS badge FROM idx)
    SELECT player_id, arch FROM cl WHERE arch IS NOT NULL AND CASE WHEN fb THEN arch IN ('Ofensivo', 'Construtor') ELSE badge IN ('Construtor Nato') END""",
)
def _(spark, folder):
    fullback = C("position_family").isin("BUILDING", "MACHINERY")
    rows = player_index(spark, folder).withColumns(
        {
            "arch": F.when(C("profile") != "Híbrido", F.when(fullback, C("profile")).when(C("profile") == "Construtor", "Construtor").otherwise("Combativo")),
            "badge": F.when(C("rating") > 8, "Construtor Nato").when(C("rating") > 7, "Construtor Âncora"),
        }
    )
    wanted = ["Construtor Nato", "Construtor", "Ofensivo"]
    return rows.where(s.cluster_test(wanted, fullback, C("arch"), C("badge"))).select("player_id", "arch")


def _sorted(order: str, filters: str = "TRUE", top: int = 50) -> str:
    return f"WITH {INDEX_SQL} SELECT player_id, name, minutes, birth_year, " + rounded("rating") + f" FROM idx WHERE {filters} ORDER BY {order} LIMIT {top}"


for _name, _order in {
    "rating": "rating DESC NULLS LAST, player_id",
    "minutes": "minutes DESC NULLS LAST, player_id",
    "age": "coalesce(birth_year, 0) DESC, player_id",
    "name": "lower(name), player_id",
}.items():

    def _page(spark, folder, sort=_name):
        out = s.search_page(player_index(spark, folder), s.Filters(nationality="all"), sort, 50)
        return tidy(out, "player_id", "name", "minutes", "birth_year", "rating")

    query(f"t1_sorted_by_{_name}", "T1 T2", _sorted(_order))(_page)


@query(
    "t4_groups_by_size",
    "T4 J5",
    f"WITH {INDEX_SQL} SELECT club, count(*) AS missing FROM idx ANTI JOIN (SELECT player_id FROM dos WHERE assists >= 3) USING (player_id) GROUP BY club ORDER BY missing DESC, club",
)
def _(spark, folder):
    enriched = player_dossiers(spark, folder).where(C("assists") >= 3)
    missing = player_index(spark, folder).join(enriched, "player_id", "left_anti")
    return missing.groupBy("club").agg(F.count(F.lit(1)).alias("missing")).orderBy(C("missing").desc(), C("club"))


@query(
    "a5_facets",
    "A5",
    f"WITH {INDEX_SQL} SELECT DISTINCT 'club' AS facet, club AS value FROM idx UNION SELECT DISTINCT 'nationality', nationality FROM idx UNION SELECT DISTINCT 'foot', foot FROM idx WHERE foot IS NOT NULL",
)
def _(spark, folder):
    return stats.facet_values(player_index(spark, folder), ["club", "nationality", "foot"])


@query(
    "a6_filter_bounds",
    "A6",
    f"WITH {INDEX_SQL} SELECT min(height) FILTER (height > 0) AS height_min, max(height) FILTER (height > 0) AS height_max, 0 AS minutes_min, max(minutes) AS minutes_max, "
    "min(birth_year) AS birth_min, max(birth_year) AS birth_max, round_even(min(rating), 1) AS rating_min, round_even(max(rating), 1) AS rating_max FROM idx",
)
def _(spark, folder):
    return stats.filter_bounds(player_index(spark, folder))


@query(
    "a6_page_bounds",
    "A6 P13",
    f"WITH {INDEX_SQL} SELECT 2026 - max(birth_year) AS age_min, 2026 - min(birth_year) AS age_max, floor(min(rating) * 10) / 10e0 AS rating_min, ceil(max(rating) * 10) / 10e0 AS rating_max FROM idx",
)
def _(spark, folder):
    return stats.page_bounds(player_index(spark, folder), YEAR)


@query(
    "a7_family_counts",
    "A7",
    f"WITH {INDEX_SQL} SELECT f AS position_family, count(player_id) AS players, (SELECT count(*) FROM idx) AS total FROM (VALUES ('BUILDING'), ('MACHINERY'), ('FURNITURE'), ('HOUSEHOLD'), ('AUTOMOBILE'), ('NONE')) v(f) "
    "LEFT JOIN idx ON position_family = f GROUP BY f",
)
def _(spark, folder):
    names = ["BUILDING", "MACHINERY", "FURNITURE", "HOUSEHOLD", "AUTOMOBILE", "NONE"]
    return stats.counts_over(player_index(spark, folder), "position_family", stats.family_dimension(spark, names))


@query(
    "a8_label_shares",
    "A8",
    f"WITH {INDEX_SQL} SELECT position_family, profile, count(*) AS players, "
    + "round(count(*) * 100e0 / sum(count(*)) OVER (PARTITION BY position_family) + 1e-10, 6) AS percent" + " FROM idx GROUP BY position_family, profile",
)
def _(spark, folder):
    return tidy(stats.label_shares(player_index(spark, folder), "profile", "position_family"))


@query(
    "a10_descriptives",
    "A10",
    with_base(
        select=" UNION ALL ".join(
            f"SELECT '{m}' AS metric, {r(f'avg({m})', 'mean')}, {r(f'stddev_samp({m})', 'sd')}, {r(f'min({m})', 'low')}, {r(f'max({m})', 'high')}, "
            f"{r(f'quantile_cont({m}, 0.25)', 'q1')}, {r(f'median({m})', 'median')}, {r(f'quantile_cont({m}, 0.75)', 'q3')} FROM pool"
            for m in ("duels_def", "passes", "crosses", "fouls")
        )
    ),
)
def _(spark, folder):
    names = ("duels_def", "passes", "crosses", "fouls")
    return tidy(stats.descriptives(pool(spark, folder), {n: n for n in names}))


DEFENCE = ("duels_def", "duels_air", "shots_blocked", "interceptions_raw", "clearances_raw", "fouls")
ATTACK = ("duels_off", "runs_prog", "passes_long", "passes_final", "passes_prog")


@query(
    "a11_correlations",
    "A11",
    with_base(
        select=" UNION ALL ".join(
            f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'r')} FROM pool"
            for i, a in enumerate(DEFENCE + ATTACK) for b in (DEFENCE + ATTACK)[i + 1 :]
        )
    ),
)
def _(spark, folder):
    return tidy(stats.correlations(pool(spark, folder), DEFENCE + ATTACK))


def _block_mean(pairs) -> str:
    return "(" + " + ".join(f"corr({a}, {b})" for a, b in pairs) + f") / {len(pairs)}e0"


@query(
    "a11_block_correlations",
    "A11",
    with_base(
        select="SELECT "
        + r(_block_mean([(a, b) for i, a in enumerate(DEFENCE) for b in DEFENCE[i + 1 :]]), "inside_first") + ", "
        + r(_block_mean([(a, b) for i, a in enumerate(ATTACK) for b in ATTACK[i + 1 :]]), "inside_second") + ", "
        + r(_block_mean([(a, b) for a in DEFENCE for b in ATTACK]), "between") + " FROM pool"
    ),
)
def _(spark, folder):
    pairs = stats.correlations(pool(spark, folder), DEFENCE + ATTACK)
    return tidy(stats.block_correlations(pairs, DEFENCE, ATTACK))


@query(
    "a12_quantile_bins",
    "A12",
    with_base(
        "q AS (SELECT quantile_cont(passes_long, 0.25) AS a, quantile_cont(passes_long, 0.5) AS b, quantile_cont(passes_long, 0.75) AS c FROM pool)",
        "w AS (SELECT passes_long, passes_long_pct, 1 + (passes_long > a)::INT + (passes_long > b)::INT + (passes_long > c)::INT AS bin FROM pool, q)",
        select="SELECT bin, " + r("avg(passes_long)", "volume_mean") + ", " + r("avg(passes_long_pct)", "value_mean") + ", "
        + r("stddev_samp(passes_long_pct)", "value_sd") + ", count(*) AS n FROM w GROUP BY bin",
    ),
)
def _(spark, folder):
    return tidy(stats.quantile_bins(pool(spark, folder), "passes_long", "passes_long_pct"))


@query(
    "a12_width_bins",
    "A12",
    with_base(
        "q AS (SELECT quantile_cont(passes_long, 0.02) AS lo, quantile_cont(passes_long, 0.98) AS hi FROM pool)",
        "w AS (SELECT passes_long, passes_long_pct, CAST(greatest(1, least(7, ceil((passes_long - lo) / ((hi - lo) / 7e0)))) AS INTEGER) AS bin FROM pool, q WHERE passes_long BETWEEN lo AND hi)",
        select="SELECT bin, " + r("avg(passes_long)", "volume_mean") + ", " + r("avg(passes_long_pct)", "value_mean") + ", "
        + r("stddev_samp(passes_long_pct)", "value_sd") + ", count(*) AS n FROM w GROUP BY bin",
    ),
)
def _(spark, folder):
    return tidy(stats.width_bins(pool(spark, folder), "passes_long", "passes_long_pct"))


@query(
    "a13_histogram",
    "A13",
    with_base(
        "e AS (SELECT greatest(0e0, min(passes_pct) - 2) AS lo, least(100e0, max(passes_pct) + 2) AS hi FROM pool)",
        select="SELECT CAST(least(16, floor((passes_pct - lo) / ((hi - lo) / 17e0))) AS INTEGER) AS bin, count(*) AS n FROM pool, e GROUP BY bin",
    ),
)
def _(spark, folder):
    return stats.histogram(pool(spark, folder), "passes_pct", 18, 0, 100)


@query(
    "a14_cap_hits",
    "A14",
    with_base(
        "w AS (SELECT family, passes_long_pct - avg(passes_long_pct) OVER (PARTITION BY family) AS res FROM pool)",
        select="SELECT family, " + r("avg(CASE WHEN abs(res) > 5 THEN 100e0 ELSE 0e0 END)", "hit_pct") + ", " + r("stddev_pop(res)", "sd") + " FROM w GROUP BY family",
    ),
)
def _(spark, folder):
    from ..operators.pools import pool_means

    people = pool_means(pool(spark, folder), ["family"], {"m": "passes_long_pct"})
    return tidy(stats.cap_hits(people.withColumn("res", C("passes_long_pct") - C("m")), "res", 5.0, "family"))


@query(
    "a15_spearman",
    "A15",
    with_base(
        "w AS (SELECT family, rank() OVER (PARTITION BY family ORDER BY duels_def) + (count(*) OVER (PARTITION BY family, duels_def) - 1) / 2e0 AS ra, "
        "rank() OVER (PARTITION BY family ORDER BY fouls) + (count(*) OVER (PARTITION BY family, fouls) - 1) / 2e0 AS rb FROM pool)",
        select="SELECT family, " + r("corr(ra, rb)", "rho") + " FROM w GROUP BY family",
    ),
)
def _(spark, folder):
    return tidy(stats.spearman(pool(spark, folder), ["family"], "player_id", "duels_def", "fouls"))


PROFILE_SQL = "CASE WHEN c_acctbal > 6000 THEN 'Construtor' WHEN c_acctbal > 2500 THEN 'Ofensivo' WHEN c_acctbal >= 0 THEN 'Defensivo' ELSE 'Híbrido' END"
NATION_SQL = "CASE WHEN c_nationkey < 8 THEN 'Construtor' WHEN c_nationkey < 14 THEN 'Ofensivo' WHEN c_nationkey < 20 THEN 'Defensivo' ELSE 'Híbrido' END"
SEGMENT_SQL = "CASE c_mktsegment WHEN 'BUILDING' THEN 'Construtor' WHEN 'MACHINERY' THEN 'Ofensivo' WHEN 'FURNITURE' THEN 'Defensivo' ELSE 'Híbrido' END"
LABEL_ORDER = ("Construtor", "Ofensivo", "Defensivo", "Híbrido")
LABEL_SQL = f"lab AS (SELECT c_custkey, {PROFILE_SQL} AS a, {NATION_SQL} AS b, {SEGMENT_SQL} AS c FROM customer)"


def labelled(spark, folder):
    return table(spark, folder, "customer").selectExpr(
        "c_custkey", f"{PROFILE_SQL} AS a", f"{NATION_SQL} AS b", f"{SEGMENT_SQL} AS c"
    )


@query(
    "a16_confusion",
    "A16",
    f"WITH {LABEL_SQL} SELECT a, " + ", ".join(f"count(*) FILTER (b = '{x}') AS \"{x}\"" for x in LABEL_ORDER) + " FROM lab GROUP BY a",
)
def _(spark, folder):
    return stats.confusion(labelled(spark, folder), "a", "b", LABEL_ORDER)


@query(
    "a17_agreement",
    "A17",
    f"WITH {LABEL_SQL} SELECT count(*) AS rows, count(*) FILTER (b = c) AS all_agree, count(*) FILTER (b <> c) AS unstable, count(*) FILTER (a <> b OR a <> c) AS moved FROM lab",
)
def _(spark, folder):
    return stats.agreement(labelled(spark, folder), "a", "b", "c")


@query(
    "c17_consensus",
    "C17",
    f"WITH {LABEL_SQL} SELECT c_custkey, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE 'Instável' END AS consensus FROM lab",
)
def _(spark, folder):
    return labelled(spark, folder).select("c_custkey", labels.consensus(C("a"), C("b"), C("c")).alias("consensus"))


@query(
    "c11_grades_badges_tiers",
    "C11 C12 C13 X11",
    with_base(
        pct_ctes("pool", "g", {"v": "passes_prog", "e": "passes_prog_pct"}),
        select="""SELECT player_id,
         CASE WHEN v >= 85 THEN 'A' WHEN v >= 75 THEN 'B+' WHEN v >= 65 THEN 'B' WHEN v >= 55 THEN 'B-' WHEN v >= 45 THEN 'C+' WHEN v >= 35 THEN 'C' WHEN v >= 25 THEN 'C-' ELSE 'D' END AS grade,
         CASE WHEN v > 90 THEN 'gold' WHEN v > 75 THEN 'silver' WHEN v > 50 THEN 'bronze' END AS volume_badge,
         CASE WHEN least(v, e) > 90 THEN 'gold' WHEN least(v, e) > 75 THEN 'silver' WHEN least(v, e) > 50 THEN 'bronze' END AS dual_badge,
         CASE WHEN v >= 85 THEN 5 WHEN v >= 68 THEN 4 WHEN v >= 48 THEN 3 WHEN v >= 28 THEN 2 ELSE 1 END AS tier,
         CASE WHEN v >= 85 THEN 92 WHEN v >= 75 THEN 80 WHEN v >= 65 THEN 70 WHEN v >= 55 THEN 60 WHEN v >= 45 THEN 50 WHEN v >= 35 THEN 40 WHEN v >= 25 THEN 30 ELSE 15 END AS grade_points,
         CASE WHEN v / 10e0 / 10e0 * 100e0 >= 85 THEN 5 WHEN v / 10e0 / 10e0 * 100e0 >= 68 THEN 4 WHEN v / 10e0 / 10e0 * 100e0 >= 48 THEN 3 WHEN v / 10e0 / 10e0 * 100e0 >= 28 THEN 2 ELSE 1 END AS rating_tier FROM g""",
    ),
)
def _(spark, folder):
    ranked = rank_columns(
        pool(spark, folder), ["family"], "player_id",
        {"v": ("passes_prog", "dense"), "e": ("passes_prog_pct", "dense")},
    )
    out = ranked.withColumn("grade", labels.letter_grade(C("v")))
    return out.select(
        "player_id",
        "grade",
        labels.volume_badge(C("v")).alias("volume_badge"),
        labels.dual_badge(C("v"), C("e")).alias("dual_badge"),
        labels.tier(C("v")).alias("tier"),
        labels.grade_score(C("grade")).alias("grade_points"),
        labels.rating_tier(C("v") / 10).alias("rating_tier"),
    )


@query(
    "c15_quadrants",
    "A9 C15",
    with_base(
        select="""SELECT player_id, CASE WHEN shots >= avg(shots) OVER w AND xa >= avg(xa) OVER w THEN 'Alto em ambos' WHEN xa >= avg(xa) OVER w THEN 'Alto em Y'
         WHEN shots >= avg(shots) OVER w THEN 'Alto em X' ELSE 'Abaixo da média' END AS quadrant FROM pool WINDOW w AS (PARTITION BY family)""",
    ),
)
def _(spark, folder):
    from ..operators.pools import pool_means

    people = pool_means(pool(spark, folder), ["family"], {"mx": "shots", "my": "xa"})
    return people.select("player_id", labels.quadrant(C("shots"), C("xa"), C("mx"), C("my")).alias("quadrant"))


@query(
    "x1_text_rules",
    "X1 X2 X8 X10",
    """WITH t AS (SELECT c_custkey, 'Éd. ' || c_name || ' ' || c_mktsegment || ' U-' || (20 + c_nationkey) AS s FROM customer),
     n AS (SELECT *, trim(regexp_replace(lower(strip_accents(s)), '[^a-z0-9]+', ' ', 'g')) AS norm FROM t),
     w AS (SELECT *, list_filter(string_split(norm, ' '), lambda x: length(x) > 1) AS words FROM n)
     SELECT c_custkey, norm, trim(regexp_replace(lower(strip_accents(s)), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
      regexp_matches(norm, '\\bu ?\\d{2}\\b') AS spaced_youth, regexp_matches(lower(s), '\\bu-?\\d{2}\\b') AS youth,
      norm || '|' || CASE WHEN array_to_string(words, ' ') <> norm THEN array_to_string(words, ' ') || '|' ELSE '' END
        || array_to_string(words[-2:], ' ') || '|' || words[-1] AS variants FROM w""",
)
def _(spark, folder):
    source = table(spark, folder, "customer").selectExpr(
        "c_custkey", "concat('Éd. ', c_name, ' ', c_mktsegment, ' U-', cast(20 + c_nationkey AS string)) AS s"
    )
    return source.select(
        "c_custkey",
        text.normalise(C("s")).alias("norm"),
        text.slug(C("s")).alias("slug"),
        text.normalise(C("s")).rlike(r"\bu ?\d{2}\b").alias("spaced_youth"),
        text.is_youth_team(F.lower("s")).alias("youth"),
        F.array_join(text.name_variants(C("s")), "|").alias("variants"),
    )


@query(
    "x5_money_dates_heights",
    "X5 X7 X9",
    """WITH t AS (SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS d, date '1998-06-15' AS today FROM orders),
     m AS (SELECT *, (year(d) - 1998) * 12 + month(d) - 6 - (day(d) < 15)::INT AS span FROM t)
     SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN CAST(floor(o_totalprice / 100) AS BIGINT) * 1000000 // 100 WHEN o_totalprice > 100000 THEN CAST(floor(o_totalprice / 1000) AS BIGINT) * 1000
        ELSE CAST(floor(o_totalprice) AS BIGINT) END AS euros, d AS until,
      CASE WHEN d <= today THEN 'Contrato vencido' WHEN span = 0 THEN greatest(date_diff('day', today, d), 1) || ' dia(s)' ELSE
        concat_ws(' e ', CASE WHEN span // 12 > 1 THEN (span // 12) || ' anos' WHEN span // 12 = 1 THEN '1 ano' END,
          CASE WHEN span % 12 > 1 THEN (span % 12) || ' meses' WHEN span % 12 = 1 THEN '1 mes' END) END AS remaining,
      150 + o_orderkey % 50 AS height, CAST(year(d) AS INTEGER) AS born FROM m""",
)
def _(spark, folder):
    shown = "'dd/MM/yyyy'", "'dd.MM.yyyy'", "'yyyy-MM-dd'"
    source = table(spark, folder, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_totalprice > 300000 THEN concat('€ ', cast(floor(floor(o_totalprice / 100) / 100) AS string), ',', lpad(cast(cast(floor(o_totalprice / 100) AS bigint) % 100 AS string), 2, '0'), ' mi')"
        " WHEN o_totalprice > 100000 THEN concat('€ ', cast(floor(o_totalprice / 1000) AS string), ' mil') ELSE concat('€ ', cast(cast(floor(o_totalprice) AS bigint) AS string)) END AS money",
        f"CASE o_orderstatus WHEN 'F' THEN date_format(o_orderdate, {shown[0]}) WHEN 'O' THEN date_format(o_orderdate, {shown[1]}) ELSE date_format(o_orderdate, {shown[2]}) END AS day",
        "concat(cast((150 + o_orderkey % 50) div 100 AS string), ',', lpad(cast((150 + o_orderkey % 50) % 100 AS string), 2, '0'), ' m') AS tall",
        "concat('nascido em ', date_format(o_orderdate, 'dd/MM/yyyy')) AS blob",
    )
    until = text.contract_date(C("day"))
    return source.select(
        "o_orderkey",
        text.money_amount(C("money")).alias("euros"),
        until.alias("until"),
        text.contract_remaining(until, F.lit("1998-06-15").cast("date")).alias("remaining"),
        text.height_cm(C("tall")).cast("bigint").alias("height"),
        text.birth_year(C("blob")).alias("born"),
    )
