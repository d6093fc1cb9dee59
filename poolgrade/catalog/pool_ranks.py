"""Ranks, pool statistics, z-scores and residuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..functions.scalar import steady
from ..operators import pools
from ..operators.ranks import ordinal, rank_columns, rank_settled
from . import query
from .base import dense_pct, lin100, pool, r, resid, rounded, tidy, with_base, z_mean, z_med

C = F.col
FAMILY = ["family"]


@query(
    "entry_rating_board",
    "N7 W1 W4 C1 F1 T2",
    with_base(
        """v AS (SELECT *, duels_off_net + dribbles + touches_box + shots AS off_v,
          passes_prog * prog_rate + passes_final * final_rate AS con_v,
          duels_def * duels_def_rate + interceptions AS def_v, carry_prog AS prog_v FROM pool)""",
        "d AS (SELECT *, " + ", ".join(
            f"dense_rank() OVER (PARTITION BY family ORDER BY {x}_v) AS dr_{x}" for x in ("off", "con", "def", "prog")
        ) + " FROM v)",
        "p AS (SELECT *, " + ", ".join(f"{dense_pct(x)} AS {x}_pct" for x in ("off", "con", "def", "prog")) + " FROM d)",
        """g AS (SELECT *, round((5e0 + (off_pct * 0.2e0 + con_pct * 0.3e0 + def_pct * 0.3e0 + prog_pct * 0.2e0) * 0.045e0)
          * (1e0 + minutes_share * 0.15e0) * 0.83e0, 9) AS rating FROM p)""",
        "k AS (SELECT *, rank() OVER (PARTITION BY family ORDER BY rating DESC) AS place FROM g)",
        select="SELECT family, player_id, label, CAST(place AS BIGINT) AS place, " + rounded("rating off_pct con_pct def_pct prog_pct")
        + " FROM k WHERE place <= 10",
    ),
)
def _(spark, folder):
    from ..plans.families import overall_rating

    rated = overall_rating(pool(spark, folder), FAMILY)
    board = rank_columns(rated, FAMILY, "player_id", {"place": ("rating_geral", "rank")})
    top = board.where(C("place") <= 10).withColumnRenamed("rating_geral", "rating")
    return tidy(top, "family", "player_id", "label", "place", "rating", "off_pct", "con_pct", "def_pct", "prog_pct")


@query(
    "w1_dense_percentile",
    "W1",
    with_base(
        "d AS (SELECT *, dense_rank() OVER (PARTITION BY family ORDER BY passes_prog) AS dr_a, "
        "dense_rank() OVER (PARTITION BY family ORDER BY goals) AS dr_b FROM pool)",
        select=f"SELECT player_id, {r(dense_pct('a'), 'prog_pct')}, {r(dense_pct('b'), 'goal_pct')} FROM d",
    ),
)
def _(spark, folder):
    wanted = {"prog_pct": ("passes_prog", "dense"), "goal_pct": ("goals", "dense")}
    return tidy(rank_columns(pool(spark, folder), FAMILY, "player_id", wanted), "player_id", *wanted)


@query(
    "w2_reversed_percentile",
    "W2",
    with_base(
        "d AS (SELECT *, rank() OVER (PARTITION BY family ORDER BY fouls DESC) AS rk FROM pool)",
        select="SELECT player_id, round(CASE WHEN max(rk) OVER (PARTITION BY family) <= 1 THEN 100e0 ELSE (rk - 1) / "
        "CAST(max(rk) OVER (PARTITION BY family) - 1 AS DOUBLE) * 100e0 END + 1e-10, 6) AS foul_pct FROM d",
    ),
)
def _(spark, folder):
    out = rank_columns(pool(spark, folder), FAMILY, "player_id", {"foul_pct": ("fouls", "reversed")})
    return tidy(out, "player_id", "foul_pct")


@query(
    "w3_competition_rank",
    "W3 W4",
    with_base(
        "d AS (SELECT *, rank() OVER (PARTITION BY family ORDER BY assists DESC) AS place, count(*) OVER (PARTITION BY family) AS n FROM pool)",
        select="SELECT player_id, CAST(place AS BIGINT) AS place, round(CASE WHEN n <= 1 THEN 100e0 ELSE "
        "100e0 * (n - place) / (n - 1) END + 1e-10, 6) AS norm FROM d",
    ),
)
def _(spark, folder):
    wanted = {"place": ("assists", "rank"), "norm": ("assists", "normalised")}
    out = rank_columns(pool(spark, folder), FAMILY, "player_id", wanted).withColumn("place", C("place").cast("bigint"))
    return tidy(out, "player_id", "place", "norm")


@query(
    "w5_mean_percentile_of_score",
    "W5 W6",
    with_base(
        """d AS (SELECT *, rank() OVER (PARTITION BY family ORDER BY xa) - 1 AS below,
          count(*) OVER (PARTITION BY family ORDER BY xa RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
          count(*) OVER (PARTITION BY family) AS n FROM pool)""",
        select="SELECT player_id, round(50e0 * (below + upto) / n + 1e-10, 6) AS pos_pct, "
        "round(5e0 + ((below + 1 + upto) / 2e0 / n) * 4.5e0 + 1e-10, 6) AS band, round(upto / CAST(n AS DOUBLE) + 1e-10, 6) AS ecdf FROM d",
    ),
)
def _(spark, folder):
    wanted = {"pos_pct": ("xa", "mean"), "avg": ("xa", "average"), "ecdf": ("xa", "ecdf")}
    out = rank_columns(pool(spark, folder), FAMILY, "player_id", wanted)
    return tidy(out.withColumn("band", F.lit(5.0) + C("avg") * 4.5), "player_id", "pos_pct", "band", "ecdf")


@query(
    "w7_exposure_percentile",
    "W7 N18",
    with_base(
        "d AS (SELECT *, dense_rank() OVER (PARTITION BY family ORDER BY minutes) AS dr_m FROM pool)",
        f"e AS (SELECT *, {dense_pct('m')} AS mp FROM d)",
        select="SELECT player_id, " + r("mp", "minutes_pct") + ", " + r(
            "CASE WHEN mp > 75 THEN 1e0 ELSE 0.7e0 + 0.3e0 * pow(mp / 75e0, 0.25e0) END", "confidence") + " FROM e",
    ),
)
def _(spark, folder):
    from ..plans.common import minutes_confidence

    out = rank_columns(pool(spark, folder), FAMILY, "player_id", {"minutes_pct": ("minutes", "dense")})
    return tidy(out.withColumn("confidence", minutes_confidence(C("minutes_pct"))), "player_id", "minutes_pct", "confidence")


@query(
    "w8_sequential_rank",
    "W8",
    with_base(select="SELECT player_id, row_number() OVER (PARTITION BY family ORDER BY goals DESC, player_id) AS rank FROM pool"),
)
def _(spark, folder):
    return ordinal(pool(spark, folder), FAMILY, [-C("goals"), C("player_id")], "player_id").select("player_id", "rank")


@query(
    "w9_medals",
    "W9 W10",
    with_base(
        "d AS (SELECT *, rank() OVER (PARTITION BY family ORDER BY shots DESC) AS place, count(*) OVER (PARTITION BY family) AS n FROM pool)",
        select="""SELECT player_id, CASE WHEN place / CAST(n AS DOUBLE) <= 0.1e0 THEN 'gold' WHEN place / CAST(n AS DOUBLE) <= 0.25e0 THEN 'silver'
          WHEN place / CAST(n AS DOUBLE) <= 0.4e0 THEN 'bronze' END AS medal,
          CAST(greatest(1, 100 - floor((n - place) / CAST(n AS DOUBLE) * 100e0 + 0.5e0)) AS BIGINT) AS top_percent,
          round(greatest(0e0, least(100e0, (n - place) / CAST(n AS DOUBLE) * 100e0)) + 1e-10, 6) AS rank_pct FROM d""",
    ),
)
def _(spark, folder):
    people = pool(spark, folder)
    ranked = rank_columns(people, FAMILY, "player_id", {"place": ("shots", "rank")})
    sizes = people.groupBy("family").agg(F.count(F.lit(1)).alias("pool_size"))
    out = ranked.join(F.broadcast(sizes), "family")
    return tidy(
        out.select(
            "player_id",
            labels.medal(C("place"), C("pool_size")).alias("medal"),
            labels.top_percent(C("place"), C("pool_size")).alias("top_percent"),
            labels.rank_percentile(C("place"), C("pool_size")).alias("rank_pct"),
        )
    )


@query(
    "a4_pool_statistics",
    "A4",
    with_base(
        select="SELECT family, count(*) AS pool_size, " + ", ".join(
            f"{r(f'avg({c})', f'mean_{c}')}, {r(f'stddev_samp({c})', f'sd_{c}')}, {r(f'min({c})', f'min_{c}')}, "
            f"{r(f'max({c})', f'max_{c}')}, {r(f'median({c})', f'med_{c}')}, {r(f'quantile_cont({c}, 0.95)', f'p95_{c}')}"
            for c in ("passes", "duels_def")
        ) + " FROM pool GROUP BY family",
    ),
)
def _(spark, folder):
    people = pool(spark, folder)
    values = {"passes": "passes", "duels_def": "duels_def"}
    stats = pools.moments(people, FAMILY, values, "mean", "sd", "min", "max")
    q = pools.exact_quantiles(people, FAMILY, values, {"med": 0.5, "p95": 0.95})
    wide = q.groupBy("family").agg(
        *[F.max(F.when(C("metric") == m, C(k))).alias(f"{k}_{m}") for m in values for k in ("med", "p95")]
    )
    return tidy(stats.join(wide, "family"))


@query(
    "n1_clipped_z",
    "N1 N2",
    with_base(
        f"z AS (SELECT player_id, {z_med('prog_done')} AS z_prog, {z_med('goals')} AS z_goals FROM pool)",
        select="SELECT player_id, " + rounded("z_prog z_goals") + ", "
        + r("0.6e0 * z_prog + 0.4e0 * z_goals", "composite") + " FROM z",
    ),
)
def _(spark, folder):
    out = pools.clipped_z(pool(spark, folder), FAMILY, {"prog": "prog_done", "goals": "goals"})
    return tidy(
        out.withColumn("composite", C("z_prog") * 0.6 + C("z_goals") * 0.4), "player_id", "z_prog", "z_goals", "composite"
    )


@query(
    "n3_skill_index",
    "N3",
    with_base(
        f"z AS (SELECT player_id, family, round(0.5e0 * {z_med('carry_prog')} + 0.5e0 * {z_med('duels_off_done')}, 9) AS c FROM pool)",
        "d AS (SELECT *, dense_rank() OVER (PARTITION BY family ORDER BY c) AS dr_c FROM z)",
        select=f"SELECT player_id, {r(dense_pct('c'), 'skill')} FROM d",
    ),
)
def _(spark, folder):
    z = pools.clipped_z(pool(spark, folder), FAMILY, {"carry": "carry_prog", "off": "duels_off_done"})
    z = z.withColumn("c", steady(C("z_carry") * 0.5 + C("z_off") * 0.5))
    return tidy(rank_columns(z, FAMILY, "player_id", {"skill": ("c", "dense")}), "player_id", "skill")


@query(
    "n10_linear_scale",
    "N10 M2",
    with_base(
        f"z AS (SELECT player_id, {lin100('passes')} AS linear, (touches_box - min(touches_box) OVER w) / "
        "nullif(max(touches_box) OVER w - min(touches_box) OVER w, 0) AS unit FROM pool WINDOW w AS (PARTITION BY family))",
        select="SELECT player_id, " + rounded("linear unit") + " FROM z",
    ),
)
def _(spark, folder):
    people = pools.linear_100(pool(spark, folder), FAMILY, {"linear": "passes"})
    return tidy(pools.min_max(people, FAMILY, {"unit": "touches_box"}), "player_id", "linear", "unit")


@query(
    "c2_axis_z",
    "C2 M1",
    with_base(
        f"z AS (SELECT player_id, ({z_mean('duels_def')} + {z_mean('duels_air')}) / 2e0 AS axis, "
        "round((passes - avg(passes) OVER w) / stddev_pop(passes) OVER w, 9) AS scaled FROM pool WINDOW w AS (PARTITION BY family))",
        select="SELECT player_id, " + rounded("axis scaled") + " FROM z",
    ),
)
def _(spark, folder):
    people = pools.mean_z(pool(spark, folder), FAMILY, {"a": "duels_def", "b": "duels_air"})
    people = people.withColumn("axis", (C("mz_a") + C("mz_b")) / 2.0)
    return tidy(pools.population_z(people, FAMILY, {"scaled": "passes"}), "player_id", "axis", "scaled")


@query(
    "r1_pool_residual",
    "R1",
    with_base(
        f"z AS (SELECT player_id, family, {resid('final_done', 'prog_done')} AS res FROM pool)",
        "d AS (SELECT *, dense_rank() OVER (PARTITION BY family ORDER BY res) AS dr_res FROM z)",
        select="SELECT player_id, " + rounded("res") + f", {r(dense_pct('res'), 'res_pct')} FROM d",
    ),
)
def _(spark, folder):
    people = pools.residuals(pool(spark, folder), FAMILY, {"res": ("final_done", "prog_done")})
    return tidy(rank_columns(people, FAMILY, "player_id", {"res_pct": ("res", "dense")}), "player_id", "res", "res_pct")


@query(
    "n11_efficiency_volume_blend",
    "N11",
    with_base(
        "d AS (SELECT *, dense_rank() OVER (PARTITION BY family ORDER BY prog_rate) AS dr_e, "
        "dense_rank() OVER (PARTITION BY family ORDER BY passes_prog) AS dr_v FROM pool)",
        f"e AS (SELECT player_id, 0.6e0 * {dense_pct('e')} + 0.4e0 * {dense_pct('v')} AS blend FROM d)",
        select="SELECT player_id, " + rounded("blend") + " FROM e",
    ),
)
def _(spark, folder):
    wanted = {"e": ("prog_rate", "dense"), "v": ("passes_prog", "dense")}
    out = rank_columns(pool(spark, folder), FAMILY, "player_id", wanted)
    return tidy(out.withColumn("blend", C("e") * 0.6 + C("v") * 0.4), "player_id", "blend")


@query(
    "n17_shrinkage",
    "N17 N19 N25",
    with_base(
        """s AS (SELECT *, least(1e0, pow(minutes_share, 0.65e0)) AS w FROM pool)""",
        "d AS (SELECT *, dense_rank() OVER (PARTITION BY family ORDER BY minutes) AS dr_m FROM s)",
        f"e AS (SELECT *, {dense_pct('m')} AS mp, interception_won_p90 + total_clearance_p90 + duels_def * duels_def_rate + outfielder_block_p90 AS acts FROM d)",
        """f AS (SELECT *, w * passes_pct + (1e0 - w) * 50e0 AS shrunk,
           pow(greatest(0e0, least(1e0, (acts - 6.5e0) / 3.5e0)), 0.75e0) * (CASE WHEN mp <= 75 THEN pow(mp / 75e0, 0.38e0) ELSE 1e0 END) AS trust,
           50e0 + w * (passes_pct - 50e0) AS final FROM e)""",
        """g AS (SELECT *, round(final, 9) AS fr FROM f)""",
        select="SELECT player_id, " + rounded("shrunk trust") + ", " + r(
            "6.5e0 + 1.85e0 * tanh((fr - avg(fr) OVER (PARTITION BY family)) / (stddev_samp(fr) OVER (PARTITION BY family) * 2.5e0))", "note")
        + " FROM g",
    ),
)
def _(spark, folder):
    from ..operators.measures import successful_actions
    from ..plans.common import sample_trust, shrink, tanh_note

    out = rank_settled(pool(spark, folder), FAMILY, "player_id", {"mp": ("minutes", "dense")})
    out = out.withColumns(
        {
            "shrunk": shrink(C("passes_pct"), C("minutes_share"), 50.0),
            "trust": sample_trust(successful_actions(), C("mp")),
            "fr": steady(shrink(C("passes_pct"), C("minutes_share"), 50.0)),
        }
    )
    return tidy(tanh_note(out, FAMILY, {"note": "fr"}), "player_id", "shrunk", "trust", "note")
