"""Centre-backs and full-backs: scores, archetypes, notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import macro_profile
from ..functions.scalar import steady
from ..operators.pools import eligible, medians
from ..operators.ranks import rank_columns
from ..plans import centrebacks as cb
from ..plans import families
from ..plans import fullbacks as fb
from ..plans import studies
from ..session import settle
from ..sources.tables import season_counts, season_minutes, season_sheet
from . import query
from .base import (
    BASE_SQL,
    SHEET_CELLS,
    TALLY_CELLS,
    MEASURES_SQL,
    PEOPLE_SQL,
    lin100,
    pct_ctes,
    pool,
    r,
    resid,
    rounded,
    tidy,
    with_base,
    z_mean,
    z_med,
)

C = F.col
FAMILY = ["family"]

# The scores are taken inside every family's pool, so the whole table is rated.

# --------------------------------------------------------------------------- skill indices

SKILL_CTES = [
    """mix AS (SELECT *, prog_done * 0.6e0 + passes_prog * 0.4e0 AS mix_prog, final_done * 0.6e0 + passes_final * 0.4e0 AS mix_final,
       long_done * 0.6e0 + passes_long * 0.4e0 AS mix_long FROM pool)""",
    f"mixr AS (SELECT *, {resid('mix_final', 'mix_prog')} AS mix_f, {resid('mix_long', 'mix_prog')} AS mix_l FROM mix)",
    "skz AS (SELECT *, "
    + ", ".join(
        f"{z_med(v)} AS {n}"
        for n, v in {
            "z1": "interception_won_p90",
            "z2": "duels_def_done",
            "z3": "duels_air_done",
            "z4": "mix_prog",
            "z5": "mix_f",
            "z6": "mix_l",
            "z7": "carry_prog",
            "z8": "duels_off_done",
        }.items()
    )
    + " FROM mixr)",
    """skc AS (SELECT *, round(51.5625e0 / 75e0 * z4 + 14.0625e0 / 75e0 * z5 + 9.375e0 / 75e0 * z6, 9) AS build,
       round(z7 * 0.5e0 + z8 * 0.5e0, 9) AS attack FROM skz)""",
    pct_ctes(
        "skc",
        "skill",
        {"n_contencao": "z1", "n_duelos_def": "z2", "n_duelo_ar": "z3", "n_construcao": "build", "n_conducao": "attack"},
    ),
]


@query(
    "n16_skill_indices",
    "N3 N16 R1",
    with_base(*SKILL_CTES, select="SELECT player_id, " + rounded("n_contencao n_duelos_def n_duelo_ar n_construcao n_conducao") + " FROM skill"),
)
def _(spark, folder):
    out = cb.with_skill_indices(settle(pool(spark, folder)))
    return tidy(out, "player_id", "n_contencao", "n_duelos_def", "n_duelo_ar", "n_construcao", "n_conducao")


# ------------------------------------------------------------------------- axis ratings

COMPONENT_SQL = {
    "e_prog": "prog_rate", "v_prog": "passes_prog", "e_final": "final_rate", "v_final": "passes_final",
    "e_long": "long_rate", "v_long": "passes_long", "p_carry": "carry_prog", "e_off": "duels_off_pct",
    "v_off": "duels_off_net", "e_def": "duels_def_pct", "v_def": "duels_def", "e_air": "duels_air_pct",
    "v_air": "duels_air", "p_inter": "interception_won_p90", "p_clear": "total_clearance_p90", "p_block": "shots_blocked",
}


def component_ctes(source: str) -> list[str]:
    return [
        pct_ctes(source, "cmp", COMPONENT_SQL),
        "bl AS (SELECT *, " + ", ".join(f"e_{x} * 0.6e0 + v_{x} * 0.4e0 AS bl_{x}" for x in ("prog", "final", "long", "off", "def", "air")) + " FROM cmp)",
        f"""rs AS (SELECT *, {resid('bl_final', 'bl_prog')} AS r1, {resid('bl_long', 'bl_prog')} AS r2,
            {resid('p_clear', 'p_inter')} AS r3, {resid('p_block', 'p_inter')} AS r4 FROM bl)""",
        pct_ctes("rs", "rp", {"q1": "r1", "q2": "r2", "q3": "r3", "q4": "r4"}),
        """raw AS (SELECT *, 0.515625e0 * bl_prog + 0.140625e0 * q1 + 0.09375e0 * q2 + 0.15e0 * p_carry + 0.1e0 * bl_off AS con_raw,
            0.35e0 * bl_def + 0.2e0 * p_inter + 0.05e0 * q3 + 0.05e0 * q4 + 0.35e0 * bl_air AS def_raw FROM rp)""",
        f"lin AS (SELECT *, {lin100('con_raw')} AS score_construcao, {lin100('def_raw')} AS score_defesa FROM raw)",
    ]


@query(
    "n12_axis_scores",
    "N11 N12 N13 N10 R1",
    with_base(
        *component_ctes("pool"),
        select="SELECT player_id, " + rounded("con_raw def_raw score_construcao score_defesa") + " FROM lin",
    ),
)
def _(spark, folder):
    out = cb.with_axis_components(settle(pool(spark, folder)))
    out = cb.linear_100(
        settle(out), FAMILY, {"score_construcao": "score_construcao_bruto", "score_defesa": "score_defesa_bruto"}
    )
    out = out.withColumnsRenamed({"score_construcao_bruto": "con_raw", "score_defesa_bruto": "def_raw"})
    return tidy(out, "player_id", "con_raw", "def_raw", "score_construcao", "score_defesa")


MEDIAN_BONUS = "list_sort([n_conducao, n_construcao, n_duelo_ar, n_duelos_def, n_contencao])[3] / 100e0 * 0.5e0"
RATING_CTES = [
    *SKILL_CTES,
    *component_ctes("skill"),
    f"""axr AS (SELECT *,
      round_even(round(((5e0 + score_construcao / 100e0 * 4.5e0) * (1e0 + minutes_share * 0.15e0) + {MEDIAN_BONUS}) * 0.88e0, 9), 1) AS rating_construcao,
      round_even(round(((5e0 + score_defesa / 100e0 * 4.5e0) * (1e0 + minutes_share * 0.15e0) + {MEDIAN_BONUS}) * 0.88e0, 9), 1) AS rating_defesa FROM lin)""",
]


@query(
    "n14_axis_ratings",
    "N14 N16 W4",
    with_base(
        *RATING_CTES,
        select="SELECT player_id, " + rounded("rating_construcao rating_defesa")
        + ", CAST(rank() OVER (PARTITION BY family ORDER BY rating_construcao DESC) AS BIGINT) AS rank_construcao"
        ", CAST(rank() OVER (PARTITION BY family ORDER BY rating_defesa DESC) AS BIGINT) AS rank_defesa FROM axr",
    ),
)
def _(spark, folder):
    skilled = settle(cb.with_skill_indices(settle(pool(spark, folder).select(*cb.NEEDED))))
    rated = settle(cb.with_axis_ratings(cb.with_axis_components(skilled)))
    out = rank_columns(
        rated, FAMILY, "player_id", {f"rank_{k}": (f"rating_{k}", "rank") for k in ("construcao", "defesa")}
    )
    return tidy(out, "player_id", "rating_construcao", "rating_defesa", "rank_construcao", "rank_defesa")


def _step(x: str) -> str:
    return f"(CASE WHEN {x} > 90 THEN {x} * 1.1e0 WHEN {x} > 80 THEN {x} * 1.05e0 ELSE {x} END)"


LEGACY_SQL = {
    "y_off": "duels_off_net", "y_offr": "duels_off_rate", "y_carry": "carry_prog", "y_prog": "passes_prog",
    "y_progs": "prog_share", "y_final": "passes_final", "y_finals": "final_share", "y_long": "passes_long",
    "y_longs": "long_share", "y_def": "duels_def", "y_defr": "duels_def_rate", "y_air": "duels_air",
    "y_airr": "duels_air_rate", "y_inter": "interceptions", "y_read": "reading_index",
}
LEGACY_CTES = [
    *SKILL_CTES,
    pct_ctes("skill", "lp", LEGACY_SQL),
    """lb AS (SELECT *, y_offr * 0.6e0 + y_off * 0.4e0 AS m0, y_carry AS m1, y_progs * 0.6e0 + y_prog * 0.4e0 AS m2,
       y_finals * 0.6e0 + y_final * 0.4e0 AS m3, y_longs * 0.6e0 + y_long * 0.4e0 AS m4, y_defr * 0.6e0 + y_def * 0.4e0 AS m5,
       y_airr * 0.6e0 + y_air * 0.4e0 AS m6, y_inter * 0.65e0 + y_read * 0.35e0 AS m7 FROM lp)""",
    "ls AS (SELECT *, " + ", ".join(f"{_step(f'm{i}')} AS t{i}" for i in range(8)) + " FROM lb)",
    "lt AS (SELECT *, " + ", ".join(f"5e0 + {_step(f't{i}')} * 0.045e0 AS u{i}" for i in range(8)) + " FROM ls)",
    """lj AS (SELECT *, u2 * 0.4e0 + u3 * 0.4e0 + u4 * 0.2e0 AS bu, u1 * 0.7e0 + u0 * 0.3e0 AS ca FROM lt)""",
    f"""lr AS (SELECT *,
      round(((bu * 1.25e0 + ca + u5 * 0.5e0 + u6 * 0.5e0 + u7 * 0.5e0) / 5e0 * (1e0 + minutes_share * 0.15e0) + {MEDIAN_BONUS}) * 0.88e0, 9) AS lc,
      round(((bu * 1.25e0 + ca + u5 * 2.5e0 + u6 * 3e0 + u7 * 3e0) / 10e0 * (1e0 + minutes_share * 0.15e0) + {MEDIAN_BONUS}) * 0.88e0, 9) AS ld FROM lj)""",
    """lk AS (SELECT *, rank() OVER (PARTITION BY family ORDER BY lc) AS lo, count(*) OVER (PARTITION BY family, lc) AS ties,
       count(*) OVER (PARTITION BY family) AS n FROM lr)""",
]


@query(
    "n15_legacy_rating",
    "N15 W6",
    with_base(
        *LEGACY_CTES,
        select="SELECT player_id, " + rounded("lc ld") + ", " + r("5e0 + (lo + (ties - 1) / 2e0) / n * 4.5e0", "band") + ", "
        + r("round_even(ld, 1)", "rating_defesa_legacy") + " FROM lk",
    ),
)
def _(spark, folder):
    out = cb.with_legacy_ratings(settle(cb.with_skill_indices(settle(pool(spark, folder)))))
    out = out.withColumnsRenamed(
        {"legacy_construcao_raw": "lc", "legacy_defesa_raw": "ld", "rating_construcao_legacy": "band"}
    )
    return tidy(out, "player_id", "lc", "ld", "band", "rating_defesa_legacy")


# --------------------------------------------------------------------------- archetypes

AXIS_CTES = [
    """af AS (SELECT *, CASE WHEN total_clearance_p90 + duels_air <> 0 THEN (duels_def + interception_won_p90) / (total_clearance_p90 + duels_air)
       ELSE 0e0 END AS style FROM pool)""",
    f"""ax AS (SELECT *, round(({z_mean('total_clearance_p90')} + {z_mean('duels_air')} + {z_mean('outfielder_block_p90')}) / 3e0, 9) AS za,
        round(({z_mean('passes_final')} + {z_mean('prog_share')} + {z_mean('carry_prog')}) / 3e0, 9) AS zc,
        round(({z_mean('duels_def')} + {z_mean('interception_won_p90')} + {z_mean('style')}) / 3e0, 9) AS zk,
        {z_mean('duels_def')} AS zd, round(avg(long_share) OVER (PARTITION BY family), 9) AS avg_long FROM af)""",
    """ay AS (SELECT *, greatest(za, zc, zk) AS pk, (za >= 0.3e0)::INT + (zc >= 0.3e0)::INT + (zk >= 0.3e0)::INT AS strong,
       greatest(CASE WHEN za >= 0.3e0 THEN za ELSE -1e9 END, CASE WHEN zc >= 0.3e0 THEN zc ELSE -1e9 END, CASE WHEN zk >= 0.3e0 THEN zk ELSE -1e9 END) AS sk FROM ax)""",
    """az AS (SELECT *,
       CASE WHEN pk < 0 THEN 'Defensor de Área' WHEN za = pk THEN 'Defensor de Área' WHEN zc = pk THEN 'Construtor' ELSE 'Combativo' END AS plain,
       CASE WHEN pk < 0 OR za = pk THEN 'Defensor de Área' WHEN zc = pk THEN
         CASE WHEN zc < 0.25e0 OR zk >= zc THEN CASE WHEN zk >= za THEN 'Combativo' ELSE 'Defensor de Área' END ELSE 'Construtor' END
         ELSE 'Combativo' END AS guarded,
       CASE WHEN za >= 0.3e0 AND za = sk THEN 'Defensor de Área' WHEN zc >= 0.3e0 AND zc = sk THEN 'Construtor' ELSE 'Combativo' END AS best_strong FROM ay)""",
    """arch AS (SELECT *, CASE WHEN strong >= 2 THEN best_strong ELSE guarded END AS strong_first,
       CASE WHEN strong >= 2 AND zk >= 0.3e0 AND zc >= 0.3e0 AND zd >= 1.5e0 THEN 'Combativo' WHEN strong >= 2 THEN best_strong ELSE guarded END AS archetype FROM az)""",
    """ex AS (SELECT *, exp(za + (archetype = 'Defensor de Área')::INT) AS ea, exp(zc + (archetype = 'Construtor')::INT) AS ec,
       exp(zk + (archetype = 'Combativo')::INT) AS ek FROM arch)""",
]


@query(
    "c3_archetype_variants",
    "C2 C3 C4 C8 C21 A17",
    with_base(
        *AXIS_CTES,
        select="""SELECT player_id, plain, guarded, strong_first, archetype, CAST(strong AS INTEGER) AS n_strong, archetype <> guarded AS changed_guarded,
          archetype <> strong_first AS changed_strong, """ + rounded("za zc zk zd") + " FROM arch",
    ),
)
def _(spark, folder):
    out = cb.with_archetype_axes(pool(spark, folder)).withColumns(
        {
            "plain": cb.plain_argmax(),
            "guarded": cb.guarded_argmax(),
            "strong_first": cb.strong_first(),
            "archetype": cb.final_archetype(),
            "n_strong": cb.strong_count(),
        }
    )
    out = out.withColumns(
        {"changed_guarded": C("archetype") != C("guarded"), "changed_strong": C("archetype") != C("strong_first")}
    ).withColumnsRenamed({"z_area": "za", "z_con": "zc", "z_com": "zk", "z_duel": "zd"})
    return tidy(
        out, "player_id", "plain", "guarded", "strong_first", "archetype", "n_strong",
        "changed_guarded", "changed_strong", "za", "zc", "zk", "zd",
    )


@query(
    "c6_archetype_badge_and_mix",
    "C6 C7 C10 X13",
    with_base(
        *AXIS_CTES,
        select="""SELECT player_id, archetype, CASE WHEN archetype = 'Construtor' THEN CASE WHEN long_share > avg_long THEN 'Construtor Âncora' ELSE 'Construtor Nato' END END AS badge,
          CASE WHEN archetype = 'Construtor' THEN 'Construtor' ELSE 'Defensivo' END AS macro, """
        + ", ".join(r(f"round_even(round(e{x} / (ea + ec + ek) * 100e0, 9), 1)", f"mix_{x}") for x in "ack") + " FROM ex",
    ),
)
def _(spark, folder):
    out = cb.with_archetypes(settle(cb.with_archetype_axes(pool(spark, folder))))
    return tidy(
        out.select(
            "player_id",
            C("cluster_archetype").alias("archetype"),
            C("cluster_construtor_badge").alias("badge"),
            macro_profile(C("cluster_archetype")).alias("macro"),
            C("cluster_share_defensor_area").alias("mix_a"),
            C("cluster_share_construtor").alias("mix_c"),
            C("cluster_share_combativo").alias("mix_k"),
        )
    )


def _mean_of(columns: list[str]) -> str:
    return "round((" + " + ".join(z_mean(c) for c in columns) + f") / {len(columns)}e0, 9)"


FB_CTES = [
    f"""fx AS (SELECT *, {_mean_of(['duels_def', 'total_clearance_p90', 'interception_won_p90', 'duels_air'])} AS zd,
      {_mean_of(['passes_prog', 'passes_final', 'recv', 'passes_long'])} AS zc,
      {_mean_of(['touches_box', 'crosses', 'accels', 'runs_prog', 'dribbles', 'duels_off', 'att_actions'])} AS zo FROM pool WHERE family = 'laterais')""",
    """fy AS (SELECT *, greatest(zd, zc, zo) AS pk, (zd >= 0.3e0)::INT + (zc >= 0.3e0)::INT + (zo >= 0.3e0)::INT AS strong FROM fx)""",
    """fz AS (SELECT *, CASE WHEN strong >= 2 THEN 'Híbrido' WHEN pk < 0 OR zd = pk THEN 'Defensivo'
       WHEN zc = pk THEN CASE WHEN zc < 0.25e0 OR zo >= zc THEN CASE WHEN zo >= zd THEN 'Ofensivo' ELSE 'Defensivo' END ELSE 'Construtor' END
       ELSE 'Ofensivo' END AS archetype,
       CASE WHEN strong >= 3 THEN 'Lateral Completo' WHEN strong < 2 THEN NULL WHEN zo < 0.3e0 THEN 'Lateral Base'
       WHEN zc < 0.3e0 THEN 'Lateral Moderno' ELSE 'Lateral Projetivo' END AS badge FROM fy)""",
    """fe AS (SELECT *, exp(zd + (archetype = 'Defensivo')::INT) AS ed, exp(zc + (archetype = 'Construtor')::INT) AS ec, exp(zo + (archetype = 'Ofensivo')::INT) AS eo FROM fz)""",
]


@query(
    "c5_fullback_archetypes",
    "C2 C3 C5 C7",
    with_base(
        *FB_CTES,
        select="SELECT player_id, archetype, badge, " + ", ".join(
            r(f"round_even(round(e{x} / (ed + ec + eo) * 100e0, 9), 1)", f"mix_{x}") for x in "dco"
        ) + ", " + rounded("zd zc zo") + " FROM fe",
    ),
)
def _(spark, folder):
    people = pool(spark, folder).where(C("family") == "laterais")
    out = fb.with_archetypes(fb.with_axes(people))
    return tidy(
        out.select(
            "player_id",
            C("cluster_archetype").alias("archetype"),
            C("cluster_hybrid_badge").alias("badge"),
            C("cluster_share_defensivo").alias("mix_d"),
            C("cluster_share_construtor").alias("mix_c"),
            C("cluster_share_ofensivo").alias("mix_o"),
            C("lat_z_def").alias("zd"),
            C("lat_z_con").alias("zc"),
            C("lat_z_off").alias("zo"),
        )
    )


CONF = "(CASE WHEN mp > 75 THEN 1e0 ELSE 0.7e0 + 0.3e0 * pow(mp / 75e0, 0.25e0) END)"


def _fb_rating(p: str) -> str:
    return f"round_even(round(7.25e0 + (5e0 + {p} * 0.045e0 * 0.88e0 * (1e0 + minutes_share * 0.15e0) - 7.25e0) * {CONF}, 9), 1)"


@query(
    "n20_fullback_ratings",
    "N17 N18 N20 W4 W7",
    with_base(
        *FB_CTES,
        pct_ctes("fz", "fp", {"pd": "zd", "pc": "zc", "po": "zo", "mp": "minutes", "n_leitura_def": "reading_index", "n_duelo_ar": "duels_air_done"}),
        f"""fr AS (SELECT *, {_fb_rating('pd')} AS rating_defensivo, {_fb_rating('pc')} AS rating_construtor, {_fb_rating('po')} AS rating_ofensivo,
          least(1e0, pow(minutes_share, 0.65e0)) AS w, 5e0 + (pd * 0.3e0 + pc * 0.35e0 + po * 0.35e0) / 100e0 * 4.5e0 AS core FROM fp)""",
        f"""fs AS (SELECT *, round_even(round(7.25e0 + (7.25e0 + w * (core - 7.25e0) - 7.25e0) * {CONF}, 9), 1) AS rating_geral FROM fr)""",
        select="SELECT player_id, " + rounded("rating_geral rating_defensivo rating_construtor rating_ofensivo n_leitura_def n_duelo_ar") + ", "
        + ", ".join(f"CAST(rank() OVER (PARTITION BY family ORDER BY rating_{k} DESC) AS BIGINT) AS rank_{k}" for k in ("geral", "defensivo", "construtor", "ofensivo"))
        + " FROM fs",
    ),
)
def _(spark, folder):
    out = fb.rate_fullbacks(pool(spark, folder))
    keys = ("geral", "defensivo", "construtor", "ofensivo")
    return tidy(
        out, "player_id", *[f"rating_{k}" for k in keys], "n_leitura_def", "n_duelo_ar", *[f"rank_{k}" for k in keys]
    )


# ------------------------------------------------------------------ studies of past seasons

HISTORY_LAST = 1999
"""Seasons up to this year are the history; later ones are the target."""
STUDY_MINUTES = 60

SEASON_CTES = [
    f"stally AS (SELECT l_partkey, year(l_shipdate) AS season, {TALLY_CELLS} FROM lineitem GROUP BY l_partkey, year(l_shipdate))",
    f"speople AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN 'B' ELSE 'A' END AS league, {PEOPLE_SQL} FROM part)",
    f"ssheet AS (SELECT p_partkey, season, league, name, club, position, family, player_id || '-' || season AS player_id, CAST(minutes AS INTEGER) AS minutes, {SHEET_CELLS} "
    "FROM stally JOIN speople ON l_partkey = p_partkey)",
    f"sshare AS (SELECT *, CASE WHEN max(minutes) OVER (PARTITION BY season, league) <> 0 THEN minutes / CAST(max(minutes) OVER (PARTITION BY season, league) AS DOUBLE) ELSE 0e0 END AS minutes_share, {MEASURES_SQL} FROM ssheet)",
    """sact AS (SELECT *, interception_won_p90 + total_clearance_p90 + duels_def * duels_def_rate + outfielder_block_p90 AS acoes_def,
        duels_def * (1e0 - duels_def_rate) AS lost FROM sshare)""",
    f"""study AS (SELECT *, CASE WHEN acoes_def <> 0 THEN (lost + greatest(0e0, fouls - 0.45e0 * lost)) / acoes_def ELSE lost + greatest(0e0, fouls - 0.45e0 * lost) END AS custo_def,
        interception_won_p90 + total_clearance_p90 AS inter_clear_p90, duels_def * duels_def_pct / 100e0 AS duels_def_impact,
        duels_air * duels_air_pct / 100e0 AS duels_air_impact, prog_done AS passes_prog_impact, long_done AS passes_long_impact
        FROM sact WHERE family IS NOT NULL AND position <> 'Goleiro' AND minutes >= {STUDY_MINUTES} AND minutes_share > 0.2e0)""",
    f"hist AS (SELECT * FROM study WHERE season <= {HISTORY_LAST})",
    f"target AS (SELECT * FROM study WHERE season > {HISTORY_LAST})",
]


def fit_ctes(name: str, fits: dict[str, tuple[str, str]], source: str = "hist") -> list[str]:
    """Coefficients by regressing the parts of v*v and y that a line in v does not explain."""
    w = "OVER (PARTITION BY family)"
    sq = ", ".join(
        f"{v} * {v} - (regr_intercept({v} * {v}, {v}) {w} + regr_slope({v} * {v}, {v}) {w} * {v}) AS rv_{m}, "
        f"{y} - (regr_intercept({y}, {v}) {w} + regr_slope({y}, {v}) {w} * {v}) AS ry_{m}"
        for m, (v, y) in fits.items()
    )
    cells = ", ".join(
        f"covar_pop(ry_{m}, rv_{m}) / var_pop(rv_{m}) AS b2_{m}, regr_slope({y}, {v}) AS s_{m}, regr_slope({v} * {v}, {v}) AS t_{m}, "
        f"avg({y}) AS ay_{m}, avg({v}) AS av_{m}, avg({v} * {v}) AS aw_{m}"
        for m, (v, y) in fits.items()
    )
    out = ", ".join(
        f"b2_{m}, s_{m} - b2_{m} * t_{m} AS b1_{m}, ay_{m} - (s_{m} - b2_{m} * t_{m}) * av_{m} - b2_{m} * aw_{m} AS b0_{m}" for m in fits
    )
    return [
        f"{name}_w AS (SELECT *, {sq} FROM {source})",
        f"{name}_c AS (SELECT family, count(*) AS fit_rows, {cells} FROM {name}_w GROUP BY family)",
        f"{name} AS (SELECT family, fit_rows, {out} FROM {name}_c)",
    ]


EFFICIENCY = {
    "duelos_def": ("duels_def", "duels_def_pct"),
    "duelos_ar": ("duels_air", "duels_air_pct"),
    "passes_prog": ("passes_prog", "passes_prog_pct"),
    "passes_long": ("passes_long", "passes_long_pct"),
    "eficiencia_def": ("acoes_def", "(-custo_def)"),
}
IMPACT = {
    "duelos_def": ("duels_def", "duels_def_impact"),
    "duelos_ar": ("duels_air", "duels_air_impact"),
    "passes_prog": ("passes_prog", "passes_prog_impact"),
    "passes_long": ("passes_long", "passes_long_impact"),
}
CONF_REF = {"duelos_def": 80, "duelos_ar": 50, "passes_prog": 120, "passes_long": 100, "eficiencia_def": 60}
CAPS = {"duelos_def": "5e0", "duelos_ar": "5e0", "passes_prog": "5e0", "passes_long": "5e0", "eficiencia_def": "0.1e0"}


def season_frames(spark, folder, families=None):
    """Study rows of all families or the named ones, history and target. Shares of minutes count every row of a season."""
    counts = settle(season_counts(spark, folder, families), "seasons")
    whole = None if families is None else season_minutes(spark, folder)
    rows = studies.season_shares(season_sheet(counts), "season", "league", whole=whole)
    rows = studies.study_columns(rows).where(C("family").isNotNull() & (C("position") != "Goleiro"))
    rows = rows.where((C("minutes") >= STUDY_MINUTES) & (C("minutes_share") > 0.2))
    rows = rows.withColumn("player_id", F.concat_ws("-", "player_id", C("season").cast("string")))
    rows = settle(rows, "study")
    return rows.where(C("season") <= HISTORY_LAST), rows.where(C("season") > HISTORY_LAST)


@query(
    "r2_quadratic_fit",
    "R2 R3 S2",
    with_base(
        *SEASON_CTES,
        *fit_ctes("fit", EFFICIENCY),
        select="SELECT family, fit_rows, " + ", ".join(
            f"{r(f'any_value(b0_{m})', f'b0_{m}')}, {r(f'any_value(b1_{m})', f'b1_{m}')}, {r(f'any_value(b2_{m})', f'b2_{m}')}, "
            + r(f"1 - var_pop({y} - (b0_{m} + b1_{m} * {v} + b2_{m} * {v} * {v})) / var_pop({y})", f"r2_{m}")
            for m, (v, y) in EFFICIENCY.items()
        ) + " FROM hist JOIN fit USING (family) GROUP BY family, fit_rows",
    ),
)
def _(spark, folder):
    history, _target = season_frames(spark, folder)
    fits = studies.efficiency_fits()
    coefficients = settle(studies.quadratic_fits(history, FAMILY, fits), "fits")
    out = coefficients.join(F.broadcast(studies.fit_quality(history, coefficients, FAMILY, fits)), "family")
    return tidy(out)


def _posp(expr: str) -> str:
    """Mean percentile of score inside the family."""
    return (
        f"50e0 * ((rank() OVER (PARTITION BY family ORDER BY {expr}) - 1) + count(*) OVER (PARTITION BY family ORDER BY {expr} "
        f"RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / count(*) OVER (PARTITION BY family)"
    )


@query(
    "r6_efficiency_impact_score",
    "R4 R5 R6 R10",
    with_base(
        *SEASON_CTES,
        *fit_ctes("fit", EFFICIENCY),
        "sc0 AS (SELECT target.*, " + ", ".join(
            f"greatest(-{CAPS[m]}, least({CAPS[m]}, round({y} - (b0_{m} + b1_{m} * {v} + b2_{m} * {v} * {v}), 9))) AS res_{m}, "
            f"greatest(0e0, least(1e0, {v} * (minutes / 90e0) / {CONF_REF[m]}e0)) AS cf_{m}"
            for m, (v, y) in EFFICIENCY.items()
        ) + " FROM target JOIN fit USING (family))",
        "sc1 AS (SELECT *, " + ", ".join(
            f"{_posp(f'res_{m}')} AS pa_{m}, {_posp(IMPACT[m][1] if m in IMPACT else 'inter_clear_p90')} AS pb_{m}" for m in EFFICIENCY
        ) + " FROM sc0)",
        select="SELECT player_id, " + ", ".join(
            r(f"0.7e0 * (50e0 + cf_{m} * (pa_{m} - 50e0)) + 0.3e0 * pb_{m}", f"score_{m}") for m in EFFICIENCY
        ) + " FROM sc1",
    ),
)
def _(spark, folder):
    history, target = season_frames(spark, folder)
    out = studies.efficiency_scores(target, history)
    return tidy(out, "player_id", *[f"score_{m}" for m in EFFICIENCY])


AXIS_SCORE_CTES = [
    *SEASON_CTES,
    *fit_ctes("fit", IMPACT),
    "ia0 AS (SELECT target.*, " + ", ".join(
        f"round({y} - (b0_{m} + b1_{m} * {v} + b2_{m} * {v} * {v}), 9) AS res_{m}, greatest(0e0, least(1e0, {v} * (minutes / 90e0) / {CONF_REF[m]}e0)) AS cf_{m}"
        for m, (v, y) in IMPACT.items()
    ) + " FROM target JOIN fit USING (family))",
    "ia1 AS (SELECT *, " + ", ".join(f"{_posp(f'res_{m}')} AS pr_{m}, {_posp(y)} AS pi_{m}" for m, (_, y) in IMPACT.items())
    + f", {_posp('custo_def')} AS pcost, {_posp('acoes_def')} AS pact FROM ia0)",
    "axs AS (SELECT *, " + ", ".join(
        f"0.5e0 * (50e0 + cf_{m} * (pr_{m} - 50e0)) + 0.5e0 * pi_{m} AS ax_{m}" for m in IMPACT
    ) + ", 0.6e0 * (100e0 - pcost) + 0.4e0 * pact AS ax_eficiencia_def FROM ia1)",
]
AXES5 = ["ax_duelos_def", "ax_duelos_ar", "ax_passes_prog", "ax_passes_long", "ax_eficiencia_def"]


@query(
    "r7_axis_scores",
    "R7 R8 R9 R10 N27 W8",
    with_base(
        *AXIS_SCORE_CTES,
        "mean5 AS (SELECT *, (" + " + ".join(AXES5) + ") / 5e0 AS rating_mean FROM axs)",
        "fin AS (SELECT *, round(50e0 + least(1e0, pow(minutes_share, 0.65e0)) * (rating_mean - 50e0), 9) AS rating_final FROM mean5)",
        select="SELECT player_id, " + rounded(AXES5 + ["rating_mean", "rating_final"])
        + ", row_number() OVER (PARTITION BY family ORDER BY rating_final DESC, player_id) AS rank FROM fin",
    ),
)
def _(spark, folder):
    from ..operators.ranks import ordinal

    history, target = season_frames(spark, folder)
    target = studies.refill_empty(target, FAMILY, "passes_prog_impact", C("passes_prog") * C("passes_prog_pct") / 100.0)
    target = studies.refill_empty(target, FAMILY, "passes_long_impact", C("passes_long") * C("passes_long_pct") / 100.0)
    scores = studies.axis_scores(target, history)
    out = settle(studies.composite(scores, [f"axis_{n[3:]}" for n in AXES5]), "composite")
    out = ordinal(out, FAMILY, [-C("rating_final"), C("player_id")], "player_id")
    return tidy(out.withColumnsRenamed({f"axis_{n[3:]}": n for n in AXES5}), "player_id", *AXES5, "rating_mean", "rating_final", "rank")


@query(
    "n22_blended_note",
    "N22 N23 N24 N25 N26 N17 J1 C10",
    with_base(
        *AXIS_SCORE_CTES,
        # archetypes on the target rows of the seasons
        *[c.replace("FROM pool", "FROM axs") for c in AXIS_CTES],
        "nt0 AS (SELECT *, " + ", ".join(f"round({a}, 9) AS {a.replace('ax_', 'g_')}" for a in AXES5) + " FROM arch)",
        "nt AS (SELECT *, (g_passes_prog + g_passes_long) / 2e0 AS con, (g_duelos_def + g_duelos_ar + g_eficiencia_def) / 3e0 AS dfn FROM nt0)",
        """nu AS (SELECT *, median(con) OVER w AS mc, median(dfn) OVER w AS md, (con - avg(con) OVER w) / stddev_samp(con) OVER w AS zcon,
           (dfn - avg(dfn) OVER w) / stddev_samp(dfn) OVER w AS zdfn,
           list_stddev_pop([g_duelos_def, g_duelos_ar, g_passes_prog, g_passes_long, g_eficiencia_def]) AS sd5 FROM nt WINDOW w AS (PARTITION BY family))""",
        """nv AS (SELECT *, CASE WHEN archetype = 'Construtor' THEN con * 0.85e0 + greatest(dfn, least(con - 10e0, md)) * 0.15e0
             ELSE greatest(con, least(dfn - 10e0, mc)) * 0.15e0 + dfn * 0.85e0 END AS core,
           CASE WHEN sd5 < 12 THEN 3e0 * (1e0 - sd5 / 12e0) ELSE 0e0 END AS bonus, least(1e0, pow(minutes_share, 0.65e0)) AS w FROM nu)""",
        """nw AS (SELECT *, (core + bonus) * 0.5e0 + (50e0 + 15e0 * (zcon + zdfn) / 2e0) * 0.5e0 AS pre,
           0.35e0 * g_passes_prog + 0.35e0 * g_passes_long + 0.1e0 * g_duelos_def + 0.1e0 * g_duelos_ar + 0.1e0 * g_eficiencia_def AS raw_con,
           0.1e0 * g_passes_prog + 0.1e0 * g_passes_long + 0.5e0 * g_duelos_def + 0.1e0 * g_duelos_ar + 0.2e0 * g_eficiencia_def AS raw_com,
           0.1e0 * g_passes_prog + 0.1e0 * g_passes_long + 0.2e0 * g_duelos_def + 0.3e0 * g_duelos_ar + 0.3e0 * g_eficiencia_def AS raw_area FROM nv)""",
        """nx AS (SELECT *, round(50e0 + w * (pre - 50e0), 9) AS f0, round(50e0 + w * (raw_con - 50e0), 9) AS f1, round(50e0 + w * (raw_com - 50e0), 9) AS f2,
           round(50e0 + w * (raw_area - 50e0), 9) AS f3 FROM nw)""",
        "ny AS (SELECT *, " + ", ".join(
            f"round_even(round(6.5e0 + 1.85e0 * tanh((f{i} - avg(f{i}) OVER w) / (stddev_samp(f{i}) OVER w * 2.5e0)), 9), 2) AS nt{i}" for i in range(4)
        ) + " FROM nx WINDOW w AS (PARTITION BY family))",
        select="SELECT player_id, archetype, " + rounded("bonus pre f0 nt0 nt1 nt2 nt3") + ", " + r("round_even(nt0, 1)", "rating_geral")
        + ", CAST(rank() OVER (PARTITION BY family ORDER BY round_even(nt0, 1) DESC) AS BIGINT) AS rank_geral FROM ny",
    ),
)
def _(spark, folder):
    history, target = season_frames(spark, folder)
    axes = studies.axis_scores(target, history)
    labelled = settle(cb.with_archetypes(settle(cb.with_archetype_axes(target))), "labelled")
    noted = settle(cb.with_blended_notes(labelled, settle(axes.select("player_id", *[f"axis_{n[3:]}" for n in AXES5]))), "noted")
    out = rank_columns(noted, FAMILY, "player_id", {"rank_geral": ("rating_geral", "rank")})
    return tidy(
        out.select(
            "player_id",
            C("cluster_archetype").alias("archetype"),
            C("m8_bonus").alias("bonus"),
            C("m8_pre_shrink").alias("pre"),
            C("m8_final").alias("f0"),
            C("nota_global").alias("nt0"),
            C("nota_construtor").alias("nt1"),
            C("nota_combativo").alias("nt2"),
            C("nota_defensor_area").alias("nt3"),
            "rating_geral",
            "rank_geral",
        )
    )


@query(
    "n29_profile_blends",
    "N29",
    with_base(
        *RATING_CTES,
        "pb AS (SELECT *, CASE WHEN foot = 'Destro' THEN 'Construtor' WHEN foot = 'Canhoto' THEN 'Defensivo' ELSE 'Híbrido' END AS perfil,"
        " CASE WHEN score_construcao >= score_defesa THEN '+ Construtor' ELSE '+ Defensivo' END AS lean,"
        " median(rating_construcao) OVER (PARTITION BY family) AS mc, median(rating_defesa) OVER (PARTITION BY family) AS md FROM axr)",
        select="SELECT player_id, " + r(
            """CASE WHEN perfil = 'Construtor' THEN rating_construcao * 0.85e0 + rating_defesa * 0.15e0 WHEN perfil = 'Defensivo' THEN rating_construcao * 0.15e0 + rating_defesa * 0.85e0
            WHEN lean = '+ Construtor' THEN rating_construcao * 0.55e0 + rating_defesa * 0.45e0 ELSE rating_construcao * 0.45e0 + rating_defesa * 0.55e0 END""", "plain") + ", " + r(
            """CASE WHEN perfil = 'Híbrido' THEN greatest(CASE WHEN lean = '+ Construtor' THEN rating_construcao * 0.55e0 + rating_defesa * 0.45e0 ELSE rating_construcao * 0.45e0 + rating_defesa * 0.55e0 END,
              rating_construcao * 0.5e0 + rating_defesa * 0.5e0)
            WHEN perfil = 'Construtor' THEN rating_construcao * 0.85e0 + greatest(rating_defesa, least(rating_construcao - 1e0, md)) * 0.15e0
            ELSE greatest(rating_construcao, least(rating_defesa - 1e0, mc)) * 0.15e0 + rating_defesa * 0.85e0 END""", "floored") + " FROM pb",
    ),
)
def _(spark, folder):
    skilled = settle(cb.with_skill_indices(settle(pool(spark, folder))))
    rated = settle(cb.with_axis_ratings(cb.with_axis_components(skilled)))
    med = medians(rated, FAMILY, {"con": "rating_construcao", "def": "rating_defesa"})
    shaped = rated.withColumns(
        {
            "perfil": F.when(C("foot") == "Destro", "Construtor").when(C("foot") == "Canhoto", "Defensivo").otherwise("Híbrido"),
            "hybrid_lean": F.when(C("score_construcao") >= C("score_defesa"), "+ Construtor").otherwise("+ Defensivo"),
        }
    )
    out = shaped.join(F.broadcast(med), "family").withColumns(
        {"plain": cb.plain_profile_blend(), "floored": cb.floored_profile_blend(C("med_con"), C("med_def"))}
    )
    return tidy(out, "player_id", "plain", "floored")
