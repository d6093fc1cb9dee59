"""Fuzzy joins between the parts and abbreviated references to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions.text import normalise, tokens
from ..operators import matching as m
from ..sources.tables import table
from . import query
from .base import r, tidy

C = F.col

# References: "blue anvil" of Brand#12 is written "b anvil" of "b12". Clubs such as "b1" and "b12"
# contain each other, so the club scores are not all or nothing.
REF_SQL = """part0 AS (SELECT p_partkey, lower(p_name) AS nm, 'b' || replace(p_brand, 'Brand#', '') AS club, p_size FROM part),
toks AS (SELECT *, string_split(nm, ' ') AS tk FROM part0),
refs AS (SELECT DISTINCT tk[1][1] || ' ' || tk[-1] AS qn, club AS qc FROM toks),
cands AS (SELECT nm AS cn, club AS cc, min(p_partkey) AS c, tk FROM toks GROUP BY nm, club, tk)"""
PAIR_SQL = """words AS (SELECT qn, qc, cn, cc, c, string_split(qn, ' ') AS q, tk FROM refs, cands),
hits AS (SELECT *, (list_contains(tk, q[2]))::INT AS hit_word,
   (len(list_filter(CASE WHEN list_contains(tk, q[2]) THEN list_filter(tk, lambda x: x <> q[2]) ELSE tk END, lambda x: x[1] = q[1])) > 0)::INT AS hit_initial FROM words),
cover AS (SELECT *, (hit_word + hit_initial) AS matched, (hit_word + hit_initial) / 2e0 AS cov_q, (hit_word + hit_initial) / CAST(len(tk) AS DOUBLE) AS cov_c FROM hits)"""


def people(spark, folder):
    return table(spark, folder, "part").selectExpr(
        "p_partkey", "lower(p_name) AS name", "concat('b', replace(p_brand, 'Brand#', '')) AS club", "p_size",
    )


def references(spark, folder):
    words = tokens(normalise(C("name")))
    short = F.concat(F.substring(F.get(words, 0), 1, 1), F.lit(" "), F.element_at(words, -1))
    return people(spark, folder).withColumn("name", short)


@query(
    "j8_club_scores",
    "J8 U3",
    """WITH l AS (SELECT DISTINCT lower(n_name) || ' clube ' || (n_regionkey * 3) AS raw FROM nation UNION SELECT 'vasco' UNION SELECT 'vasco da gama' UNION SELECT 'spfc'),
     a AS (SELECT DISTINCT trim(regexp_replace(raw, '[^a-z0-9]+', ' ', 'g')) AS qc FROM l),
     rr AS (SELECT DISTINCT lower(r_name) || ' clube' AS raw FROM region UNION SELECT 'nation 1' UNION SELECT 'nation 12 clube' UNION SELECT 'cr vasco' UNION SELECT 'sao paulo'),
     b AS (SELECT DISTINCT trim(regexp_replace(raw, '[^a-z0-9]+', ' ', 'g')) AS cc FROM rr),
     s AS (SELECT qc, cc, CASE WHEN contains(cc, qc) OR contains(qc, cc) THEN 100
       WHEN len(list_intersect(string_split(qc, ' '), string_split(cc, ' '))) > 0 THEN 40 + 10 * len(list_intersect(string_split(qc, ' '), string_split(cc, ' ')))
       WHEN (contains(qc, 'vasco') AND contains(cc, 'vasco')) OR ((contains(qc, 'spfc') OR contains(qc, 'sao paulo')) AND (contains(cc, 'spfc') OR contains(cc, 'sao paulo'))) THEN 80 ELSE 0 END AS cs FROM a, b)
     SELECT qc, cc, CAST(cs AS INTEGER) AS cs FROM s WHERE cs > 0""",
)
def _(spark, folder):
    nations = table(spark, folder, "nation").selectExpr("concat(lower(n_name), ' clube ', n_regionkey * 3) AS raw")
    known = spark.createDataFrame([("vasco",), ("vasco da gama",), ("spfc",)], "raw string")
    regions = table(spark, folder, "region").selectExpr("concat(lower(r_name), ' clube') AS raw")
    other = spark.createDataFrame([("nation 1",), ("nation 12 clube",), ("cr vasco",), ("sao paulo",)], "raw string")
    left = nations.unionByName(known).select(normalise(C("raw")).alias("qc"))
    right = regions.unionByName(other).select(normalise(C("raw")).alias("cc"))
    return m.club_pairs(left, right, config.ROSTER_CLUB_ALIASES, 10, 80)


@query(
    "j9_name_scores",
    "J9 U3",
    f"""WITH {REF_SQL}, {PAIR_SQL}
     SELECT qn, cn, {r("any_value(CASE WHEN cov_q >= 1 THEN 90 + 6 * cov_c ELSE 55 + 25 * greatest(cov_q, cov_c) END)", "ns")}
     FROM cover WHERE hit_word = 1 GROUP BY qn, cn""",
)
def _(spark, folder):
    q = references(spark, folder).select(normalise(C("name")).alias("qn")).distinct()
    c = people(spark, folder).select(normalise(C("name")).alias("cn")).distinct()
    last = F.element_at(tokens(C("qn")), -1)
    pairs = m.block_join(
        q.withColumn("_w", last), c.select("cn", F.explode(tokens(C("cn"))).alias("_w")), ["_w"], "cn", "qn"
    ).drop("_w")
    return tidy(m.feed_name_score(pairs), "qn", "cn", "ns")


@query(
    "j7_feed_match",
    "J7 J8 J9 U4 X1",
    f"""WITH {REF_SQL}, {PAIR_SQL},
     ns AS (SELECT *, CASE WHEN qn = cn THEN 100 WHEN cov_q >= 1 THEN 90 + 6 * cov_c WHEN cov_c >= 1 THEN 82 + 6 * cov_q WHEN matched > 0 THEN 55 + 25 * greatest(cov_q, cov_c) ELSE 0 END AS ns,
       CASE WHEN contains(cc, qc) OR contains(qc, cc) THEN 100 ELSE 0 END AS cs FROM cover),
     ok AS (SELECT *, round(CASE WHEN cs < 50 THEN ns ELSE ns * 0.58e0 + cs * 0.42e0 END, 9) AS score FROM ns WHERE cs >= 50 OR ns >= 90)
     SELECT qn, qc, c AS feed_id, {r("score", "score")} FROM ok WHERE score >= 62 QUALIFY row_number() OVER (PARTITION BY qn, qc ORDER BY score DESC, c) = 1""",
)
def _(spark, folder):
    feed = people(spark, folder).select(
        C("p_partkey").alias("player_id"), C("name").alias("player_name"), C("club").alias("primary_team")
    )
    return tidy(m.match_feed(references(spark, folder), feed))


@query(
    "j7_attach_feed",
    "J7 A1 P5",
    f"""WITH {REF_SQL}, {PAIR_SQL},
     ns AS (SELECT *, CASE WHEN qn = cn THEN 100 WHEN cov_q >= 1 THEN 90 + 6 * cov_c WHEN cov_c >= 1 THEN 82 + 6 * cov_q WHEN matched > 0 THEN 55 + 25 * greatest(cov_q, cov_c) ELSE 0 END AS ns,
       CASE WHEN contains(cc, qc) OR contains(qc, cc) THEN 100 ELSE 0 END AS cs FROM cover),
     ok AS (SELECT *, round(CASE WHEN cs < 50 THEN ns ELSE ns * 0.58e0 + cs * 0.42e0 END, 9) AS score FROM ns WHERE cs >= 50 OR ns >= 90),
     best AS (SELECT qn, qc, c FROM ok WHERE score >= 62 QUALIFY row_number() OVER (PARTITION BY qn, qc ORDER BY score DESC, c) = 1)
     SELECT t.p_partkey, {r("coalesce(d.p_size / 2e0, 0e0)", "interception_won_p90")} FROM toks t LEFT JOIN best ON tk[1][1] || ' ' || tk[-1] = qn AND t.club = qc LEFT JOIN part d ON d.p_partkey = c""",
)
def _(spark, folder):
    feed = people(spark, folder).select(
        C("p_partkey").alias("player_id"),
        C("name").alias("player_name"),
        C("club").alias("primary_team"),
        *[(C("p_size") / 2.0).alias(f"{c}_p90") for c in config.FEED_COUNTERS],
    )
    sheet = references(spark, folder)
    out = m.attach_feed(sheet, feed, m.match_feed(sheet, feed))
    return tidy(out, "p_partkey", "interception_won_p90")


ROSTER_SQL = """rost AS (SELECT nm AS cn, club, min(p_partkey) AS c, 1980 + p_size % 20 AS born, CASE WHEN p_size < 5 THEN 0 ELSE 160 + p_size END AS tall, tk FROM toks GROUP BY nm, club, tk, 1980 + p_size % 20, CASE WHEN p_size < 5 THEN 0 ELSE 160 + p_size END),
 plr AS (SELECT p_partkey AS q, tk[1][1] || ' ' || tk[-1] AS qn, club, 1980 + p_size % 20 AS born, CASE WHEN p_size < 5 THEN 0 ELSE 160 + p_size END AS tall FROM toks),
 w AS (SELECT plr.q, plr.qn, rost.c, rost.cn, rost.tk, string_split(plr.qn, ' ') AS t, abs(plr.born - rost.born) AS db, abs(plr.tall - rost.tall) AS dt, plr.tall <> 0 AND rost.tall <> 0 AS tall_known FROM plr JOIN rost USING (club)),
 h AS (SELECT *, list_contains(tk, t[2])::INT AS hw, (len(list_filter(CASE WHEN list_contains(tk, t[2]) THEN list_filter(tk, lambda x: x <> t[2]) ELSE tk END, lambda x: x[1] = t[1])) > 0)::INT AS hi FROM w),
 n AS (SELECT *, least(100e0, CASE WHEN hw + hi = 2 THEN 90 + 6 * (2e0 / len(tk)) WHEN hw + hi = 1 THEN 67.5e0 ELSE 0 END + CASE WHEN hw = 1 AND tk[-1] = t[2] AND length(t[2]) > 3 THEN 4 ELSE 0 END) AS ns FROM h),
 s AS (SELECT *, ns + CASE WHEN db = 0 THEN 7 WHEN db = 1 THEN 2 ELSE -28 END + CASE WHEN NOT tall_known THEN 0 WHEN dt <= 2 THEN 4 WHEN dt > 6 THEN -12 ELSE 0 END AS score FROM n WHERE ns > 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS turn, coalesce(lead(score) OVER (PARTITION BY q ORDER BY score DESC, c), 0) AS nxt FROM s)"""


@query(
    "j10_roster_match",
    "J10 J9 W11",
    f"WITH {REF_SQL}, {ROSTER_SQL} SELECT q, c AS match_id, round_even(score, 1) AS match_score FROM k WHERE turn = 1 AND score >= 76 AND round(score - nxt, 9) >= 4",
)
def _(spark, folder):
    base = people(spark, folder).selectExpr(
        "p_partkey", "name", "club", "1980 + p_size % 20 AS birth_year",
        "CASE WHEN p_size < 5 THEN 0 ELSE 160 + p_size END AS height",
    )
    roster = base.groupBy("name", "club", "birth_year", "height").agg(F.min("p_partkey").alias("c"))
    words = tokens(normalise(C("name")))
    short = F.concat(F.substring(F.get(words, 0), 1, 1), F.lit(" "), F.element_at(words, -1))
    players = base.withColumn("name", short).withColumnRenamed("p_partkey", "q")
    return tidy(m.match_roster(players, roster))


@query("j12_match_without_club", "J12 X8 W11")
def _(spark, folder):
    base = people(spark, folder).selectExpr("p_partkey", "name", "1980 + p_size % 20 AS birth_year")
    persons = base.groupBy("name").agg(F.min("p_partkey").alias("c"), F.min(F.lit(2026) - C("birth_year")).alias("age"))
    players = base.withColumnRenamed("p_partkey", "q")
    return tidy(m.match_without_club(players, persons, 2026))


@query(
    "j13_pick_result",
    "J13 J8",
    f"""WITH {REF_SQL},
     res AS (SELECT q.p_partkey AS q, q.nm AS qn, q.club AS qc, x.c, x.cn, x.cc FROM toks q JOIN cands x ON q.nm = x.cn),
     sc AS (SELECT *, CASE WHEN contains(qc, cc) OR contains(cc, qc) THEN 100 ELSE 0 END + 25 AS score, count(*) OVER (PARTITION BY q) AS hits FROM res)
     SELECT q, c AS match_id, CAST(score AS INTEGER) AS score FROM sc WHERE TRUE QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, c) = 1 AND (hits = 1 OR score >= 40)""",
)
def _(spark, folder):
    base = people(spark, folder)
    listed = base.groupBy("name", "club").agg(F.min("p_partkey").alias("c"))
    results = listed.select("name", "club").join(
        listed.select("name", "c", C("club").alias("result_club")), "name"
    ).withColumn("result_name", C("name"))
    return m.pick_result(base.select(C("p_partkey").alias("q"), "name", "club"), results)


@query("j11_directory_match", "J11 X10 J8 J9")
def _(spark, folder):
    clubs = table(spark, folder, "supplier").join(
        F.broadcast(table(spark, folder, "nation")), C("s_nationkey") == C("n_nationkey")
    ).selectExpr(
        "s_suppkey AS q",
        "CASE WHEN s_acctbal > 9000 THEN 'Juventus' WHEN s_acctbal > 8000 THEN 'Remo' WHEN s_acctbal > 7000 THEN concat(n_name, ' U20') ELSE concat('Clube ', n_name) END AS name",
    )
    directory = table(spark, folder, "nation").selectExpr("n_nationkey AS c", "concat(n_name, ' FC') AS name").unionByName(
        table(spark, folder, "region").selectExpr("100 + r_regionkey AS c", "CASE r_regionkey WHEN 0 THEN 'Clube do Remo' ELSE concat(r_name, ' EC') END AS name")
    )
    return tidy(m.match_directory(clubs, directory))


_BLOCKS = (
    "list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) - i + 2), lambda n: "
    "{'n': CASE WHEN instr(b, substr(a, i, n)) > 0 THEN n ELSE 0 END, 'i': -i, 'j': -instr(b, substr(a, i, n))}))))"
)


@query(
    "j9_sequence_ratio",
    "J9",
    f"""WITH RECURSIVE texts AS (SELECT p_partkey AS q, lower(p_name) AS a, lower(coalesce(lead(p_name) OVER (ORDER BY p_partkey), '')) AS b FROM part),
     parts AS (SELECT q, a, b, {_BLOCKS} AS x FROM texts
       UNION ALL SELECT q, a, b, {_BLOCKS} AS x FROM (
         SELECT q, unnest([substr(a, 1, -x.i - 1), substr(a, -x.i + x.n)]) AS a, unnest([substr(b, 1, -x.j - 1), substr(b, -x.j + x.n)]) AS b FROM parts WHERE x.n > 0)
       WHERE a <> '' AND b <> ''),
     met AS (SELECT q, sum(x.n) AS n FROM parts GROUP BY q)
     SELECT q, a, b, {r("2e0 * coalesce(n, 0) / (length(a) + length(b))", "ratio")} FROM texts JOIN met USING (q)""",
)
def _(spark, folder):
    """Likeness of each name and the next one by longest matching blocks."""
    own = table(spark, folder, "part").select(C("p_partkey").alias("q"), F.lower("p_name").alias("a"))
    after = own.select((C("q") - 1).alias("q"), C("a").alias("b"))
    pairs = own.join(after, "q", "left").na.fill("", ["b"])
    return tidy(m.with_sequence_ratio(pairs, "a", "b"))
