"""Centre-backs: skill indices, axis scores, archetypes and the blended note."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.labels import macro_profile, volume_badge
from ..functions.scalar import best_label, guarded, row_mean, row_median, row_sd, softmax_shares, steady, weighted
from ..operators.measures import style_ratio
from ..operators.pools import clipped_z, linear_100, mean_z, medians, moments, pool_means, residuals
from ..operators.ranks import rank_columns
from ..session import settle
from .common import exposure_gain, shrink, tanh_note

C = F.col
FAMILY = ["family"]

# ------------------------------------------------------------------------------ skill indices


def with_skill_indices(df: DataFrame) -> DataFrame:
    """Five 0..100 indices: z inside the pool, then dense percentile."""
    df = df.withColumns(
        {
            "mix_prog": C("prog_done") * 0.6 + C("passes_prog") * 0.4,
            "mix_final": C("final_done") * 0.6 + C("passes_final") * 0.4,
            "mix_long": C("long_done") * 0.6 + C("passes_long") * 0.4,
        }
    )
    df = settle(
        residuals(df, FAMILY, {"mix_final_res": ("mix_final", "mix_prog"), "mix_long_res": ("mix_long", "mix_prog")}),
        "skill-residuals",
    )
    z = clipped_z(
        df,
        FAMILY,
        {
            "inter": "interception_won_p90",
            "def_won": "duels_def_done",
            "air_won": "duels_air_done",
            "mix_prog": "mix_prog",
            "mix_final_res": "mix_final_res",
            "mix_long_res": "mix_long_res",
            "carry": "carry_prog",
            "off_won": "duels_off_done",
        },
    )
    w = config.BUILD_WEIGHTS
    whole = w["prog"] + w["final"] + w["long"]
    build = steady(
        weighted(
            [
                (w["prog"] / whole, C("z_mix_prog")),
                (w["final"] / whole, C("z_mix_final_res")),
                (w["long"] / whole, C("z_mix_long_res")),
            ]
        )
    )
    z = z.withColumns({"raw_build": build, "raw_attack": steady(C("z_carry") * 0.5 + C("z_off_won") * 0.5)})
    ranked = rank_columns(
        settle(z, "skill-z"),
        FAMILY,
        "player_id",
        {
            "n_contencao": ("z_inter", "dense"),
            "n_duelos_def": ("z_def_won", "dense"),
            "n_duelo_ar": ("z_air_won", "dense"),
            "n_construcao": ("raw_build", "dense"),
            "n_conducao": ("raw_attack", "dense"),
        },
    )
    helpers = [c for c in z.columns if c.startswith(("z_", "mix_", "raw_")) and c not in df.columns]
    helpers += ["mix_prog", "mix_final", "mix_long", "mix_final_res", "mix_long_res"]
    return ranked.drop(*helpers).withColumn("n_leitura_def", C("n_contencao"))


INDEX_COLUMNS = ("n_conducao", "n_construcao", "n_duelo_ar", "n_duelos_def", "n_leitura_def")


def index_bonus() -> Column:
    """Half a point for a full middle index."""
    return row_median([C(c) for c in INDEX_COLUMNS]) / F.lit(100.0) * F.lit(0.5)


def axis_note(score: str) -> Column:
    note = (F.lit(5.0) + C(score) / F.lit(100.0) * F.lit(4.5)) * exposure_gain(C("minutes_share"))
    return (note + index_bonus()) * F.lit(0.88)


# ------------------------------------------------------------------ construction and defence


def _blend(efficiency: str, volume: str) -> Column:
    return C(efficiency) * 0.6 + C(volume) * 0.4


def with_axis_components(df: DataFrame) -> DataFrame:
    """``score_construcao_bruto`` and ``score_defesa_bruto``."""
    sources = {
        "e_prog": "prog_rate",
        "v_prog": "passes_prog",
        "e_final": "final_rate",
        "v_final": "passes_final",
        "e_long": "long_rate",
        "v_long": "passes_long",
        "p_carry": "carry_prog",
        "e_off": "duels_off_pct",
        "v_off": "duels_off_net",
        "e_def": "duels_def_pct",
        "v_def": "duels_def",
        "e_air": "duels_air_pct",
        "v_air": "duels_air",
        "p_inter": "interception_won_p90",
        "p_clear": "total_clearance_p90",
        "p_block": "shots_blocked",
    }
    ranked = rank_columns(df, FAMILY, "player_id", {k: (v, "dense") for k, v in sources.items()})
    ranked = settle(
        ranked.withColumns(
            {
                "blend_prog": _blend("e_prog", "v_prog"),
                "blend_final": _blend("e_final", "v_final"),
                "blend_long": _blend("e_long", "v_long"),
                "blend_off": _blend("e_off", "v_off"),
                "blend_def": _blend("e_def", "v_def"),
                "blend_air": _blend("e_air", "v_air"),
            }
        ),
        "axis-blends",
    )
    fits = {
        "final_res": ("blend_final", "blend_prog"),
        "long_res": ("blend_long", "blend_prog"),
        "clear_res": ("p_clear", "p_inter"),
        "block_res": ("p_block", "p_inter"),
    }
    left = settle(residuals(ranked, FAMILY, fits), "axis-residuals")
    out = rank_columns(left, FAMILY, "player_id", {f"pct_{k}": (k, "dense") for k in fits})
    b, d = config.BUILD_WEIGHTS, config.DEFENCE_WEIGHTS
    scored = out.withColumns(
        {
            "score_construcao_bruto": weighted(
                [
                    (b["prog"] / 100, C("blend_prog")),
                    (b["final"] / 100, C("pct_final_res")),
                    (b["long"] / 100, C("pct_long_res")),
                    (b["carry"] / 100, C("p_carry")),
                    (b["duel"] / 100, C("blend_off")),
                ]
            ),
            "score_defesa_bruto": weighted(
                [
                    (d["duel_def"] / 100, C("blend_def")),
                    (d["inter"] / 100, C("p_inter")),
                    (d["clear"] / 100, C("pct_clear_res")),
                    (d["block"] / 100, C("pct_block_res")),
                    (d["duel_air"] / 100, C("blend_air")),
                ]
            ),
        }
    )
    helpers = [*sources, *fits, *[f"pct_{k}" for k in fits], *[c for c in scored.columns if c.startswith("blend_")]]
    return scored.drop(*helpers)


def with_axis_ratings(df: DataFrame) -> DataFrame:
    """Linear 0..100 axis scores and the two rounded axis ratings; needs the skill indices."""
    scored = linear_100(
        settle(df, "axis-raw"),
        FAMILY,
        {"score_construcao": "score_construcao_bruto", "score_defesa": "score_defesa_bruto"},
    )
    return scored.withColumns(
        {
            "rating_construcao": F.bround(steady(axis_note("score_construcao")), 1),
            "rating_defesa": F.bround(steady(axis_note("score_defesa")), 1),
        }
    )


# -------------------------------------------------------------------------- legacy rating

LEGACY_SOURCES = {
    "zp_off": "duels_off_net",
    "zp_off_r": "duels_off_rate",
    "zp_carry": "carry_prog",
    "zp_prog": "passes_prog",
    "zp_prog_s": "prog_share",
    "zp_final": "passes_final",
    "zp_final_s": "final_share",
    "zp_long": "passes_long",
    "zp_long_s": "long_share",
    "zp_def": "duels_def",
    "zp_def_r": "duels_def_rate",
    "zp_air": "duels_air",
    "zp_air_r": "duels_air_rate",
    "zp_inter": "interceptions",
    "zp_read": "reading_index",
}


def stepped_bonus(value: Column) -> Column:
    return F.when(value > 90, value * 1.10).when(value > 80, value * 1.05).otherwise(value)


def legacy_component(value: Column) -> Column:
    """The bonus step is taken twice."""
    return F.lit(5.0) + stepped_bonus(stepped_bonus(value)) * F.lit(0.045)


def legacy_note(duel_weight: float, air_weight: float, reading_weight: float, divisor: float) -> Column:
    bases = {
        "off": C("zp_off_r") * 0.6 + C("zp_off") * 0.4,
        "carry": C("zp_carry"),
        "prog": C("zp_prog_s") * 0.6 + C("zp_prog") * 0.4,
        "final": C("zp_final_s") * 0.6 + C("zp_final") * 0.4,
        "long": C("zp_long_s") * 0.6 + C("zp_long") * 0.4,
        "def": C("zp_def_r") * 0.6 + C("zp_def") * 0.4,
        "air": C("zp_air_r") * 0.6 + C("zp_air") * 0.4,
        "read": C("zp_inter") * 0.65 + C("zp_read") * 0.35,
    }
    part = {k: legacy_component(v) for k, v in bases.items()}
    build = part["prog"] * 0.4 + part["final"] * 0.4 + part["long"] * 0.2
    carry = part["carry"] * 0.7 + part["off"] * 0.3
    joint = (
        build * 1.25 + carry + part["def"] * duel_weight + part["air"] * air_weight + part["read"] * reading_weight
    ) / divisor
    return (joint * exposure_gain(C("minutes_share")) + index_bonus()) * F.lit(0.88)


def with_legacy_ratings(df: DataFrame) -> DataFrame:
    """The earlier construction and defence ratings; needs the skill indices."""
    ranked = rank_columns(df, FAMILY, "player_id", {k: (v, "dense") for k, v in LEGACY_SOURCES.items()})
    rated = settle(
        ranked.withColumns(
            {
                "legacy_construcao_raw": steady(legacy_note(0.5, 0.5, 0.5, 5)),
                "legacy_defesa_raw": steady(legacy_note(2.5, 3.0, 3.0, 10)),
            }
        ).drop(*LEGACY_SOURCES),
        "legacy",
    )
    banded = rank_columns(rated, FAMILY, "player_id", {"_band": ("legacy_construcao_raw", "average")})
    return banded.withColumns(
        {
            "rating_construcao_legacy": F.lit(5.0) + C("_band") * F.lit(4.5),
            "rating_defesa_legacy": F.bround(C("legacy_defesa_raw"), 1),
        }
    ).drop("_band")


# ---------------------------------------------------------------------------- archetypes

AXIS_COLUMNS = {"z_area": config.AREA, "z_con": config.BUILDER, "z_com": config.COMBAT}


def with_archetype_axes(df: DataFrame, builder: Sequence[str] = config.CB_AXES[config.BUILDER]) -> DataFrame:
    """Area, construction and combat axes plus the duel z used as tie-break."""
    df = df.withColumns(
        {
            "share_long": guarded(C("passes_long"), C("passes")),
            "share_prog": guarded(C("passes_prog"), C("passes")),
            "style_ratio": style_ratio(),
        }
    )
    axes = {"z_area": config.CB_AXES[config.AREA], "z_con": tuple(builder), "z_com": config.CB_AXES[config.COMBAT]}
    sources = sorted({c for cols in axes.values() for c in cols} | {"duels_def"})
    z = mean_z(df, FAMILY, {c: c for c in sources})
    made = {axis: steady(row_mean([C(f"mz_{c}") for c in cols])) for axis, cols in axes.items()}
    return z.withColumns({**made, "z_duel": C("mz_duels_def")}).drop(*[f"mz_{c}" for c in sources])


def best_axis() -> Column:
    return best_label([(label, C(axis)) for axis, label in AXIS_COLUMNS.items()])


def plain_argmax() -> Column:
    peak = F.greatest(*[C(a) for a in AXIS_COLUMNS])
    return F.when(peak < 0, config.AREA).otherwise(best_axis())


def guarded_argmax() -> Column:
    """Best axis; a builder needs z >= 0.25 and to beat the combat axis."""
    peak = F.greatest(*[C(a) for a in AXIS_COLUMNS])
    rival = F.when(C("z_com") >= C("z_area"), config.COMBAT).otherwise(config.AREA)
    weak = (best_axis() == config.BUILDER) & ((C("z_con") < config.BUILDER_MIN_Z) | (C("z_com") >= C("z_con")))
    return F.when(peak < 0, config.AREA).when(weak, rival).otherwise(best_axis())


def strong_count() -> Column:
    marks = [(C(a) >= config.STRONG_Z).cast("int") for a in AXIS_COLUMNS]
    return marks[0] + marks[1] + marks[2]


def best_strong() -> Column:
    low = F.lit(-1e9)
    strong = [(label, F.when(C(a) >= config.STRONG_Z, C(a)).otherwise(low)) for a, label in AXIS_COLUMNS.items()]
    return best_label(strong)


def strong_first() -> Column:
    return F.when(strong_count() >= 2, best_strong()).otherwise(guarded_argmax())


def final_archetype() -> Column:
    """Strong axes first; a clear duel z decides between building and combat."""
    tie = (
        (C("z_com") >= config.STRONG_Z) & (C("z_con") >= config.STRONG_Z) & (C("z_duel") >= config.DUEL_TIE_BREAK_Z)
    )
    return (
        F.when((strong_count() >= 2) & tie, config.COMBAT)
        .when(strong_count() >= 2, best_strong())
        .otherwise(guarded_argmax())
    )


def with_archetypes(df: DataFrame) -> DataFrame:
    """Archetype, builder badge and mix shares."""
    df = pool_means(df, FAMILY, {"avg_share_long": "share_long"}).withColumn("cluster_archetype", final_archetype())
    builder = C("cluster_archetype") == config.BUILDER
    long_passer = C("share_long") > steady(C("avg_share_long"))
    boosted = [
        C(axis) + F.when(C("cluster_archetype") == label, 1.0).otherwise(0.0) for axis, label in AXIS_COLUMNS.items()
    ]
    area, con, com = (F.bround(steady(s), 1) for s in softmax_shares(boosted))
    badge, short = zip(config.ANCHOR_BADGE, config.NATIVE_BADGE)
    return df.withColumns(
        {
            "cluster_construtor_badge": F.when(builder, F.when(long_passer, badge[0]).otherwise(badge[1])),
            "cluster_construtor_badge_short": F.when(builder, F.when(long_passer, short[0]).otherwise(short[1])),
            "cluster_share_defensor_area": area,
            "cluster_share_construtor": con,
            "cluster_share_combativo": com,
        }
    )


# ------------------------------------------------------------------------------ blended note


def weak_axis_blend(con: Column, dfn: Column, profile: Column, lean_con: Column, med_con: Column, med_def: Column, gap: float) -> Column:
    """Specialists are not punished below the pool median on their weak axis; hybrids keep balance."""
    hybrid = F.when(lean_con, con * 0.55 + dfn * 0.45).otherwise(con * 0.45 + dfn * 0.55)
    def_eff = F.greatest(dfn, F.least(con - F.lit(gap), med_def))
    con_eff = F.greatest(con, F.least(dfn - F.lit(gap), med_con))
    return (
        F.when(profile == config.HYBRID, F.greatest(hybrid, con * 0.5 + dfn * 0.5))
        .when(profile == "Construtor", con * 0.85 + def_eff * 0.15)
        .otherwise(con_eff * 0.15 + dfn * 0.85)
    )


def balance_bonus(scores: Sequence[Column]) -> Column:
    sd = row_sd(scores)
    return F.when(
        sd < config.BALANCE_SD, F.lit(config.BALANCE_BONUS) * (F.lit(1.0) - sd / F.lit(config.BALANCE_SD))
    ).otherwise(0.0)


def with_blended_notes(df: DataFrame, axes: DataFrame) -> DataFrame:
    """Overall and archetype notes from the five axis scores joined on the player id.

    Players without scores count as 50 on every axis.
    """
    names = list(config.SCORE_AXES)
    found = axes.select("player_id", *[C(f"axis_{n}").alias(f"_{n}") for n in names])
    joined = df.join(found, "player_id", "left")
    joined = joined.withColumns({f"axis_{n}": steady(F.coalesce(C(f"_{n}"), F.lit(50.0))) for n in names}).drop(
        *[f"_{n}" for n in names]
    )
    joined = joined.withColumns(
        {
            "con": (C("axis_passes_prog") + C("axis_passes_long")) / 2.0,
            "dfn": (C("axis_duelos_def") + C("axis_duelos_ar") + C("axis_eficiencia_def")) / 3.0,
            "perfil_m": macro_profile(C("cluster_archetype")),
        }
    )
    joined = settle(joined, "axes")
    stats = moments(joined, FAMILY, {"con": "con", "dfn": "dfn"}, "mean", "sd").join(
        F.broadcast(medians(joined, FAMILY, {"con": "con", "dfn": "dfn"})), "family"
    )
    stats = stats.drop("pool_size")
    z = [
        F.when(F.coalesce(C(f"sd_{n}"), F.lit(0.0)) == 0, 0.0).otherwise((C(n) - C(f"mean_{n}")) / C(f"sd_{n}"))
        for n in ("con", "dfn")
    ]
    core = weak_axis_blend(
        C("con"), C("dfn"), C("perfil_m"), C("con") >= C("dfn"), C("med_con"), C("med_dfn"), config.WEAK_AXIS_GAP
    )
    bonus = balance_bonus([C(f"axis_{n}") for n in names])
    symmetry = F.lit(50.0) + F.lit(config.SYMMETRY_SPREAD) * (z[0] + z[1]) / 2.0
    blended = joined.join(F.broadcast(stats), "family").withColumns(
        {
            "m8_bonus": bonus,
            "m8_pre_shrink": (core + bonus) * config.CORE_SHARE + symmetry * (1.0 - config.CORE_SHARE),
        }
    )
    finals = {"m8_final": C("m8_pre_shrink")}
    for key, weights in config.ARCHETYPE_WEIGHTS.items():
        finals[f"m8_final_{key}"] = weighted([(w, C(f"axis_{n}")) for n, w in weights.items()])
    blended = blended.withColumns(
        {k: steady(shrink(v, C("minutes_share"), config.AXIS_MU)) for k, v in finals.items()}
    ).drop("mean_con", "sd_con", "mean_dfn", "sd_dfn", "med_con", "med_dfn")
    notes = {"nota_global": "m8_final"} | {f"nota_{k}": f"m8_final_{k}" for k in config.ARCHETYPE_WEIGHTS}
    noted = tanh_note(settle(blended, "finals"), FAMILY, notes)
    noted = noted.withColumns({n: F.bround(steady(C(n)), 2) for n in notes})
    return noted.withColumns(
        {"rating_geral": F.bround(C("nota_global"), 1), "rating_perfil": F.bround(C("nota_global"), 1)}
    )


# ------------------------------------------------------------------- further rating variants


def plain_profile_blend() -> Column:
    """Profile-weighted mean of the two axis ratings without a floor."""
    con, dfn = C("rating_construcao"), C("rating_defesa")
    return (
        F.when(C("perfil") == "Construtor", con * 0.85 + dfn * 0.15)
        .when(C("perfil") == "Defensivo", con * 0.15 + dfn * 0.85)
        .when(C("hybrid_lean") == "+ Construtor", con * 0.55 + dfn * 0.45)
        .otherwise(con * 0.45 + dfn * 0.55)
    )


def floored_profile_blend(med_con: Column, med_def: Column) -> Column:
    return weak_axis_blend(
        C("rating_construcao"),
        C("rating_defesa"),
        C("perfil"),
        F.coalesce(C("hybrid_lean") == "+ Construtor", F.lit(False)),
        med_con,
        med_def,
        config.PROFILE_GAP,
    )


def badge_bonus(percentile: Column, efficiency: Column) -> Column:
    badge = volume_badge(efficiency)
    gain = F.lit(1.0)
    for name, bonus in config.BADGE_BONUS.items():
        gain = F.when(badge == name, F.lit(1.0 + bonus)).otherwise(gain)
    return F.when(badge.isNull(), percentile).otherwise(F.least(F.lit(100.0), percentile * gain))


def core_absolute_percentile() -> Column:
    """Core metrics with their badge bonus, absolute metrics at half weight."""
    core = [
        badge_bonus(C("asp_duelos_def_won_vol"), C("asp_duelos_def_eff")),
        badge_bonus(C("asp_duelos_ar_won_vol"), C("asp_duelos_ar_eff")),
        C("asp_custo_def_eff"),
        badge_bonus(C("asp_passes_prog_certos90"), C("asp_passes_prog_eff")),
        badge_bonus(C("asp_passes_long_res"), C("asp_passes_long_eff")),
    ]
    absolute = [
        C("asp_inter_vol"),
        C("asp_cortes_vol"),
        C("asp_rem_int_vol"),
        C("asp_prog_vol"),
        C("asp_duelos_of_won_vol"),
    ]
    return (row_mean(core) + F.lit(0.5) * row_mean(absolute)) / F.lit(1.5)


# ------------------------------------------------------------------------------- whole plan


NEEDED = (
    "player_id family minutes minutes_share passes passes_prog passes_final passes_long prog_done final_done long_done "
    "prog_rate final_rate long_rate prog_share final_share long_share carry_prog runs_prog duels_off_net duels_off_rate "
    "duels_off_pct duels_off_done duels_def duels_def_pct duels_def_rate duels_def_done duels_air duels_air_pct "
    "duels_air_rate duels_air_done duel_efficiency reading_index interceptions interception_won_p90 total_clearance_p90 "
    "outfielder_block_p90 shots_blocked fouls passes_prog_pct passes_long_pct"
).split()


def rate_centrebacks(df: DataFrame, history: DataFrame) -> DataFrame:
    """All centre-back columns; ``history`` holds study columns of past seasons."""
    from .families import with_blocks, with_shares
    from .studies import axis_scores, study_columns

    people = settle(df.where(C("family") == "zagueiros").select(*NEEDED), "centrebacks")
    shaped = with_shares(with_blocks(people, ["zagueiros"]), 3, guard=False)
    skilled = with_skill_indices(settle(shaped, "cb-blocks"))
    scored = with_axis_ratings(with_axis_components(settle(skilled, "cb-skills")))
    rated = with_legacy_ratings(settle(scored, "cb-axes"))
    labelled = settle(with_archetypes(settle(with_archetype_axes(settle(rated, "cb-legacy")), "cb-archetype-axes")), "cb-archetypes")
    axes = axis_scores(study_columns(people), history, FAMILY)
    noted = settle(with_blended_notes(labelled.withColumn("perfil", C("cluster_archetype")), axes), "cb-notes")
    places = {f"rank_{k}": (f"rating_{k}", "rank") for k in ("geral", "perfil", "construcao", "defesa")}
    return rank_columns(noted, FAMILY, "player_id", places)
