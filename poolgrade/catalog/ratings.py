"""Composites, indices, profiles and ratings of the families with a shared scheme."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import steady
from ..operators.pools import exact_quantiles, long_form
from ..operators.ranks import rank_columns, rank_settled
from ..plans import families
from ..plans.aspects import with_aspects
from ..plans.centrebacks import core_absolute_percentile
from ..plans.common import confident
from ..session import settle
from . import query
from .base import pct_ctes, pool, r, rounded, tidy, with_base, z_med

C = F.col
FAMILY = ["family"]
ALL = ("laterais", *config.GENERIC_FAMILIES)

# The block formulas written out a second time, as the SQL side reads them.
BLOCKS = {
    "laterais": {
        "construcao": "0.5 prog_done + 0.5 final_done",
        "duelos_def": "0.65 duel_efficiency + 0.35 duels_def",
        "leitura": "1.0 reading_index",
        "presenca": "0.5 touches_box + 0.5 att_touches",
        "cruz": "1.0 crosses_done",
        "progressao": "0.6 accels + 0.4 carry_prog",
        "conducao": "0.5 dribbles + 0.5 duels_off_done",
    },
    "meio-campistas": {
        "construcao": "0.35 prog_done + 0.25 long_done + 0.3 final_done + 0.1 box_done",
        "distribuicao": "0.7 passes_done + 0.3 recv",
        "duelos_def": "0.6 duel_efficiency + 0.4 duels_def",
        "leitura": "0.3 reading_index + 0.7 interceptions",
        "duelo_ar": "0.45 duels_air + 0.55 duels_air_rate",
        "finalizacao": "0.55 shots_done + 0.45 npxg",
        "presenca": "0.5 touches_box + 0.5 att_touches",
        "criacao": "0.4 xa + 0.35 passes_danger + 0.25 passes_creative",
    },
    "extremos": {
        "conducao": "0.7 dribbles_done + 0.3 duels_off_done",
        "cruz": "1.0 crosses_done",
        "construcao": "0.35 prog_done + 0.25 long_done + 0.4 final_done",
        "distribuicao": "0.7 passes_done + 0.3 recv",
        "progressao": "0.6 accels + 0.4 carry_prog",
        "desmarque": "0.7 long_recv + 0.3 touches_box",
    },
    "meias-ofensivos": {
        "construcao": "0.35 prog_done + 0.25 long_done + 0.4 final_done",
        "criacao": "0.4 xa + 0.35 passes_danger + 0.25 passes_creative",
        "cruz": "1.0 crosses_done",
        "distribuicao": "0.7 passes_done + 0.3 recv",
        "finalizacao": "0.5 shots + 0.5 goals_over_xg",
        "conducao": "0.6 dribbles_done + 0.4 carry_prog",
        "progressao": "0.6 carry_prog + 0.4 accels",
    },
    "atacantes": {
        "finalizacao": "0.7 shots_done + 0.3 npxg",
        "efetividade": "0.5 goals_per_touch + 0.5 goals_over_xg",
        "duelo_ar": "0.7 duels_air + 0.3 duels_air_rate",
        "criacao": "0.4 xa + 0.35 passes_danger + 0.25 passes_creative",
        "conducao": "0.5 dribbles + 0.5 carry_prog",
        "progressao": "0.6 carry_prog + 0.4 att_touches",
    },
}
INDICES = {
    "laterais": (
        "(b_construcao + 2e0) * 0.95e0",
        "b_duelos_def * 0.65e0 + b_leitura * 0.35e0 + 2e0",
        "b_progressao * 0.75e0 + b_conducao * 0.125e0 + b_presenca * 0.125e0 + 2e0",
        "b_presenca * 0.75e0 + b_cruz * 0.25e0 + 2e0",
    ),
    "meio-campistas": (
        "b_construcao * 0.85e0 + b_distribuicao * 0.15e0 + 2e0",
        "b_duelos_def * 0.5e0 + b_leitura * 0.3e0 + b_duelo_ar * 0.2e0 + 2e0",
        "b_finalizacao * 0.3e0 + b_duelos_def * 0.4e0 + b_presenca * 0.5e0 + 2e0",
        "b_finalizacao * 0.25e0 + b_criacao * 0.5e0 + b_presenca * 0.25e0 + 2e0",
    ),
    "extremos": (
        "(b_conducao + 2e0) * 1.025e0",
        "b_construcao * 0.35e0 + b_distribuicao * 0.35e0 + b_cruz * 0.3e0 + 2e0",
        "b_progressao * 0.7e0 + b_desmarque * 0.3e0 + 2e0",
    ),
    "meias-ofensivos": (
        "(b_construcao * 0.15e0 + b_criacao * 0.4e0 + b_cruz * 0.3e0 + b_distribuicao * 0.15e0 + 2e0) * 1.075e0",
        "b_finalizacao * 0.5e0 + b_conducao * 0.25e0 + b_progressao * 0.25e0 + 2e0",
    ),
    "atacantes": (
        "(b_finalizacao * 0.7e0 + b_efetividade * 0.3e0) * 1.1e0 - b_duelo_ar * 0.35e0 + 2e0",
        "b_duelo_ar * 0.7e0 + b_efetividade * 0.3e0 + 2e0",
        "b_criacao * 0.5e0 + b_conducao * 0.3e0 + b_progressao * 0.2e0 + 2e0",
    ),
}
LABELS = {
    "laterais": ("Construtor", "Defensivo", "Vertical", "Ofensivo"),
    "meio-campistas": ("Construtor", "Contenção", "Box-to-box", "Ofensivo"),
    "extremos": ("Criador", "Meia Ponta", "Vertical"),
    "meias-ofensivos": ("Armador", "Finalizador"),
    "atacantes": ("Finalizador", "Alvo", "Móvel"),
}


def _terms(text: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in text.split(" + ")]


def blocks_ctes(keys) -> list[str]:
    sources = sorted({m for f in keys for b in BLOCKS[f].values() for _, m in _terms(b)})
    names = list(dict.fromkeys(b for f in keys for b in BLOCKS[f]))
    zs = ", ".join(f"{z_med(m)} AS z_{m}" for m in sources)
    family_list = ", ".join(f"'{f}'" for f in keys)
    blocks = ", ".join(
        "round(CASE "
        + " ".join(
            f"WHEN family = '{f}' THEN " + " + ".join(f"{w}e0 * z_{m}" for w, m in _terms(BLOCKS[f][b]))
            for f in keys
            if b in BLOCKS[f]
        )
        + f" END, 9) AS b_{b}"
        for b in names
    )
    indices = ", ".join(
        "round(CASE "
        + " ".join(f"WHEN family = '{f}' THEN {INDICES[f][i]}" for f in keys if i < len(INDICES[f]))
        + f" END, 9) AS i{i + 1}"
        for i in range(max(len(INDICES[f]) for f in keys))
    )
    return [
        f"zs AS (SELECT *, {zs} FROM pool WHERE family IN ({family_list}))",
        f"blk AS (SELECT *, {blocks} FROM zs)",
        f"idx AS (SELECT *, {indices} FROM blk)",
    ]


def profile_ctes(keys) -> list[str]:
    slots = max(len(INDICES[f]) for f in keys)
    row_sum = " + ".join(f"coalesce(i{s + 1}, 0e0)" for s in range(slots))
    shares = ", ".join(f"i{s + 1} / w AS s{s + 1}" for s in range(slots))
    labels = "CASE " + " ".join(
        f"WHEN family = '{f}' AND slot = {i + 1} THEN '{label}'" for f in keys for i, label in enumerate(LABELS[f])
    ) + " END"
    cells = " UNION ALL ".join(f"SELECT player_id, family, {s + 1} AS slot, s{s + 1} AS share FROM shr WHERE s{s + 1} IS NOT NULL" for s in range(slots))
    return [
        f"tot AS (SELECT *, CASE WHEN {row_sum} = 0 THEN 1e0 ELSE {row_sum} END AS w FROM idx)",
        f"shr AS (SELECT *, {shares} FROM tot)",
        f"slots AS ({cells})",
        "ordered AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY share DESC, slot) AS turn FROM slots)",
        f"""prof AS (SELECT player_id, CASE WHEN max(share) FILTER (turn = 1) - max(share) FILTER (turn = 2)
          >= CASE WHEN any_value(family) = 'meias-ofensivos' THEN 0.05e0 ELSE 0.03e0 END
          THEN max({labels}) FILTER (turn = 1) ELSE 'Híbrido' END AS perfil FROM ordered GROUP BY player_id)""",
    ]


@query(
    "n4_block_composites",
    "N2 N4 N5",
    with_base(
        *blocks_ctes(ALL),
        select="SELECT player_id, family, " + rounded(
            "b_construcao b_duelos_def b_leitura b_presenca b_cruz b_progressao b_conducao b_distribuicao b_duelo_ar "
            "b_finalizacao b_criacao b_desmarque b_efetividade i1 i2 i3 i4"
        ) + " FROM idx",
    ),
)
def _(spark, folder):
    people = pool(spark, folder).where(C("family").isin(*ALL))
    out = families.with_blocks(people, ALL)
    names = [c for c in out.columns if c.startswith(("blk_", "idx_"))]
    return tidy(out.select("player_id", "family", *[C(n).alias(n.replace("blk_", "b_").replace("idx_", "i")) for n in names]))


@query(
    "c1_profile_by_margin",
    "N6 C1",
    with_base(
        *blocks_ctes(ALL),
        *profile_ctes(ALL),
        select="SELECT player_id, family, perfil, " + rounded("s1 s2 s3 s4") + " FROM shr JOIN prof USING (player_id)",
    ),
)
def _(spark, folder):
    people = pool(spark, folder).where(C("family").isin(*ALL))
    out = families.with_shares(families.with_blocks(people, ALL), 4)
    out = out.withColumn("perfil", families.profile_by_margin(ALL, 4))
    return tidy(
        out.select("player_id", "family", "perfil", *[C(f"share_{i}").alias(f"s{i}") for i in range(1, 5)])
    )


GENERIC = config.GENERIC_FAMILIES
OVERALL_SQL = {
    "off_pct": "duels_off_net + dribbles + touches_box + shots",
    "con_pct": "passes_prog * prog_rate + passes_final * final_rate",
    "def_pct": "duels_def * duels_def_rate + interceptions",
    "prog_pct": "carry_prog",
}
TENDENCY_SQL = {
    "n_construcao": "coalesce(b_construcao, prog_done)",
    "n_conducao": "coalesce(b_conducao, carry_prog)",
    "n_duelos_def": "coalesce(b_duelos_def, duel_efficiency)",
    "n_leitura_def": "coalesce(b_leitura, reading_index)",
    "n_duelo_ar": "duels_air * duels_air_rate",
}
RATING_SQL = (
    "round((5e0 + (off_pct * 0.2e0 + con_pct * 0.3e0 + def_pct * 0.3e0 + prog_pct * 0.2e0) * 0.045e0)"
    " * (1e0 + minutes_share * 0.15e0) * 0.83e0, 9)"
)


@query(
    "n7_family_ratings",
    "N4 N5 N6 N7 N8 N9 C1 W4 O3",
    with_base(
        *blocks_ctes(GENERIC),
        *profile_ctes(GENERIC),
        pct_ctes("idx", "pc", OVERALL_SQL | TENDENCY_SQL | {f"ip{i}": f"i{i}" for i in range(1, 5)}),
        "rat AS (SELECT *, " + RATING_SQL + " AS rating_geral, " + ", ".join(
            f"CASE WHEN i{i} IS NULL THEN NULL ELSE round(5e0 + ip{i} * 0.045e0 * 0.88e0 * (1e0 + minutes_share * 0.15e0), 9) END AS rating_{i}"
            for i in range(1, 5)
        ) + " FROM pc)",
        select="SELECT player_id, family, perfil, " + rounded(
            "rating_geral rating_1 rating_2 rating_3 rating_4 n_construcao n_conducao n_duelos_def n_leitura_def n_duelo_ar"
        ) + ", CAST(rank() OVER (PARTITION BY family ORDER BY rating_geral DESC) AS BIGINT) AS rank_geral, " + ", ".join(
            f"CASE WHEN rating_{i} IS NULL THEN NULL ELSE CAST(rank() OVER (PARTITION BY family ORDER BY rating_{i} DESC NULLS LAST) AS BIGINT) END AS rank_{i}"
            for i in range(1, 5)
        ) + " FROM rat JOIN prof USING (player_id)",
    ),
)
def _(spark, folder):
    out = families.rate_families(pool(spark, folder))
    names = ["rating_geral", *[f"rating_{i}" for i in range(1, 5)], *families.TENDENCY_SOURCES, "n_duelo_ar"]
    ranks = ["rank_geral", *[f"rank_{i}" for i in range(1, 5)]]
    return tidy(out, "player_id", "family", "perfil", *names, *ranks)


@query(
    "n30_confident_rating",
    "N18 N30",
    with_base(
        pct_ctes("pool", "pc", OVERALL_SQL | {"mp": "minutes"}),
        "c AS (SELECT *, 5e0 + (off_pct * 0.2e0 + con_pct * 0.3e0 + def_pct * 0.3e0 + prog_pct * 0.2e0) * 0.045e0 * (1e0 + minutes_share * 0.15e0) * 0.83e0 AS raw,"
        " CASE WHEN mp > 75 THEN 1e0 ELSE 0.7e0 + 0.3e0 * pow(mp / 75e0, 0.25e0) END AS conf FROM pc)",
        "d AS (SELECT *, round(7.25e0 + (raw - 7.25e0) * conf, 9) AS rating_geral FROM c)",
        select="SELECT player_id, " + rounded("rating_geral") + ", " + r("rating_geral * 0.98e0", "rating_combativo") + ", "
        + r("rating_geral * 1.02e0", "rating_construtor") + ", " + r("rating_geral * 0.99e0", "rating_posicional")
        + ", CAST(rank() OVER (PARTITION BY family ORDER BY rating_geral DESC) AS BIGINT) AS rank_geral FROM d",
    ),
)
def _(spark, folder):
    return tidy(
        families.rate_plainly(pool(spark, folder)),
        "player_id", "rating_geral", "rating_combativo", "rating_construtor", "rating_posicional", "rank_geral",
    )


# Aspect percentiles: output -> SQL value.
ASPECTS = {
    "duelos_def_vol": "duels_def",
    "duelos_def_eff": "duels_def_pct",
    "duelos_def_won_vol": "duels_def_done",
    "duelos_ar_vol": "duels_air",
    "duelos_ar_eff": "duels_air_pct",
    "duelos_ar_won_vol": "duels_air_done",
    "inter_vol": "interception_won_p90",
    "cortes_vol": "total_clearance_p90",
    "duelos_of_vol": "duels_off",
    "duelos_of_eff": "duels_off_pct",
    "duelos_of_won_vol": "duels_off_done",
    "prog_vol": "runs_prog",
    "passes_prog_eff": "passes_prog_pct",
    "passes_prog_vol": "passes_prog",
    "passes_long_vol": "passes_long",
    "ptf_vol": "passes_final",
    "passes_prog_certos90": "prog_done",
    "ptf_eff": "passes_final_pct",
    "ptf_certos90": "final_done",
    "passes_long_eff": "passes_long_pct",
    "passes_long_certos90": "long_done",
    "passes_long_res": "long_left",
    "rem_int_vol": "shots_blocked",
    "ad_vol": "actions",
    "tend_long": "long_share",
    "tend_prog": "prog_share",
    "tend_lat": "lat_ratio",
    "passes_total_vol": "passes",
    "rec_passes_vol": "passes_recv",
    "acel_vol": "accels",
    "dribles_vol": "dribbles",
    "dribles_eff": "dribbles_pct",
    "cruz_vol": "crosses",
    "cruz_eff": "crosses_pct",
    "passes_chave_vol": "passes_key",
    "passe_area_certos90": "box_done",
    "acoes_at_vol": "att_actions",
    "toques_area_vol": "touches_box",
    "cond_prog_vol": "carry_prog",
    "def_style": "style",
    "faltas_vol": "fouls",
    "cost_raw": "-cost",
    "minutes_rank": "minutes",
}
ASPECT_CTES = [
    """act AS (SELECT *, interception_won_p90 + total_clearance_p90 + duels_def * duels_def_rate + outfielder_block_p90 AS actions,
      duels_def * (1e0 - duels_def_rate) AS lost, total_clearance_p90 + duels_air AS line,
      CASE WHEN passes_recv <> 0 THEN passes_lat / passes_recv ELSE 0e0 END AS lat_ratio FROM pool)""",
    """act2 AS (SELECT *, lost + greatest(0e0, fouls - 0.45e0 * lost) AS cost0,
      CASE WHEN line <> 0 THEN (duels_def + interception_won_p90) / line ELSE 0e0 END AS style FROM act)""",
    """act3 AS (SELECT *, CASE WHEN actions <> 0 THEN cost0 / actions ELSE cost0 END AS cost,
      round(long_done - (regr_intercept(long_done, prog_done) OVER (PARTITION BY family) + regr_slope(long_done, prog_done) OVER (PARTITION BY family) * prog_done), 9) AS long_left
      FROM act2)""",
    "asp0 AS (SELECT player_id, family, minutes_share, long_share, prog_share, style, fouls, cost, actions, "
    + ", ".join(f"dense_rank() OVER (PARTITION BY family ORDER BY {v}) AS dr_{k}" for k, v in ASPECTS.items())
    + " FROM act3)",
    "asp1 AS (SELECT *, " + ", ".join(
        f"CASE WHEN max(dr_{k}) OVER (PARTITION BY family) <= 1 THEN 100e0 ELSE (dr_{k} - 1) / CAST(max(dr_{k}) OVER (PARTITION BY family) - 1 AS DOUBLE) * 100e0 END AS asp_{k}"
        for k in ASPECTS
    ) + " FROM asp0)",
    """asp2 AS (SELECT *, pow(greatest(0e0, least(1e0, (actions - 6.5e0) / 3.5e0)), 0.75e0)
      * (CASE WHEN asp_minutes_rank <= 75 THEN pow(asp_minutes_rank / 75e0, 0.38e0) ELSE 1e0 END) AS trust FROM asp1)""",
    """asp AS (SELECT *, trust * asp_cost_raw + (1e0 - trust) * 50e0 AS asp_custo_def_eff,
      avg(long_share * 100e0) OVER w AS avg_long, avg(prog_share * 100e0) OVER w AS avg_prog, avg(style) OVER w AS avg_m4, avg(fouls) OVER w AS avg_faltas,
      greatest(30e0, quantile_cont(long_share * 100e0, 0.95) OVER w * 1.15e0, avg(long_share * 100e0) OVER w * 2e0) AS scale_long,
      greatest(30e0, quantile_cont(prog_share * 100e0, 0.95) OVER w * 1.15e0, avg(prog_share * 100e0) OVER w * 2e0) AS scale_prog
      FROM asp2 WINDOW w AS (PARTITION BY family))""",
]
ASPECT_NAMES = [f"asp_{k}" for k in ASPECTS if k not in ("cost_raw", "minutes_rank")] + ["asp_custo_def_eff"]
ASPECT_STATS = ["avg_long", "avg_prog", "avg_m4", "avg_faltas", "scale_long", "scale_prog"]


@query(
    "n21_aspect_percentiles",
    "N21 N19 P6 P7 P8",
    with_base(*ASPECT_CTES, select="SELECT player_id, " + rounded(ASPECT_NAMES + ASPECT_STATS) + " FROM asp"),
)
def _(spark, folder):
    out = with_aspects(pool(spark, folder))
    renamed = out.select(
        "player_id",
        *ASPECT_NAMES,
        C("pool_avg_share_long").alias("avg_long"),
        C("pool_avg_share_prog").alias("avg_prog"),
        C("pool_avg_def_m4").alias("avg_m4"),
        C("pool_avg_faltas").alias("avg_faltas"),
        C("scale_share_long").alias("scale_long"),
        C("scale_share_prog").alias("scale_prog"),
    )
    return tidy(renamed)


def _bonus(pct: str, eff: str) -> str:
    return (
        f"least(100e0, {pct} * CASE WHEN {eff} > 90 THEN 1.2e0 WHEN {eff} > 75 THEN 1.15e0 WHEN {eff} > 50 THEN 1.1e0 ELSE 1e0 END)"
    )


@query(
    "n28_core_absolute",
    "N28",
    with_base(
        *ASPECT_CTES,
        "v AS (SELECT player_id, (" + " + ".join(
            [
                _bonus("asp_duelos_def_won_vol", "asp_duelos_def_eff"),
                _bonus("asp_duelos_ar_won_vol", "asp_duelos_ar_eff"),
                "asp_custo_def_eff",
                _bonus("asp_passes_prog_certos90", "asp_passes_prog_eff"),
                _bonus("asp_passes_long_res", "asp_passes_long_eff"),
            ]
        ) + ") / 5e0 AS core, (asp_inter_vol + asp_cortes_vol + asp_rem_int_vol + asp_prog_vol + asp_duelos_of_won_vol) / 5e0 AS absolute FROM asp)",
        select="SELECT player_id, " + r("(core + 0.5e0 * absolute) / 1.5e0", "blend") + " FROM v",
    ),
)
def _(spark, folder):
    return tidy(with_aspects(pool(spark, folder)).withColumn("blend", core_absolute_percentile()), "player_id", "blend")
