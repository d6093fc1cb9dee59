"""Pool percentiles of every aspect, with the pool averages and bar scales next to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import guarded
from ..operators.measures import adjusted_cost, share_pct, style_ratio, successful_actions
from ..operators.pools import exact_quantiles, moments, residuals
from ..operators.ranks import rank_columns
from ..session import settle
from .common import sample_trust

C = F.col
FAMILY = ["family"]

# aspect -> column ranked inside the pool
SOURCES = {
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
    "ad_vol": "acoes_def_comp",
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
    "def_style": "def_m4_ratio",
    "faltas_vol": "fouls",
}


def with_aspects(df: DataFrame) -> DataFrame:
    """``asp_*`` percentiles and the pool figures of the style bars."""
    df = df.withColumns(
        {
            "acoes_def_comp": successful_actions(),
            "def_m4_ratio": style_ratio(),
            "lat_ratio": guarded(C("passes_lat"), C("passes_recv")),
            "share_long_pct": share_pct(C("passes_long"), C("passes")),
            "share_prog_pct": share_pct(C("passes_prog"), C("passes")),
        }
    ).withColumn("custo_def_raw", adjusted_cost(C("acoes_def_comp")))
    df = settle(residuals(df, FAMILY, {"long_left": ("long_done", "prog_done")}), "aspect-values")
    bars = {"share_long": "share_long_pct", "share_prog": "share_prog_pct"}
    means = moments(df, FAMILY, bars | {"def_m4": "def_m4_ratio", "faltas": "fouls"}, "mean")
    high = exact_quantiles(df, FAMILY, bars, {"p95": 0.95}).groupBy("family").agg(
        *[F.max(F.when(C("metric") == b, C("p95"))).alias(f"p95_{b}") for b in bars]
    )
    stats = means.join(F.broadcast(high), "family").select(
        "family",
        *[C(f"mean_{n}").alias(f"pool_avg_{n}") for n in (*bars, "def_m4", "faltas")],
        *[
            F.greatest(F.lit(30.0), C(f"p95_{b}") * F.lit(1.15), C(f"mean_{b}") * F.lit(2.0)).alias(f"scale_{b}")
            for b in bars
        ],
    )
    wanted = {f"asp_{k}": (v, "dense") for k, v in SOURCES.items()}
    wanted |= {"asp_cost": (-C("custo_def_raw"), "dense"), "asp_minutes": ("minutes", "dense")}
    ranked = rank_columns(df, FAMILY, "player_id", wanted)
    trust = sample_trust(C("acoes_def_comp"), C("asp_minutes"))
    adjusted = trust * C("asp_cost") + (F.lit(1.0) - trust) * F.lit(50.0)
    return ranked.withColumn("asp_custo_def_eff", adjusted).drop("asp_cost", "asp_minutes").join(
        F.broadcast(stats), "family"
    )
