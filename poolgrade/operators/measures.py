"""Per-row measures of a stat sheet, as one projection, and the totals they depend on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import guarded, total

C = F.col


def lost_duel_load(volume: Column, won_pct: Column) -> Column:
    """Duels times the lost percentage, negative by construction."""
    return volume * (F.lit(100.0) - won_pct) * F.lit(-1.0)


LOAD = "(duels_def * (100D - duels_def_pct) * -1D)"

# The derived measures of one row; raw statistics keep their own columns.
MEASURES = {
    "carry_prog": "runs_prog - accels",
    "duels_def_rate": "duels_def_pct / 100D",
    "duels_air_rate": "duels_air_pct / 100D",
    "duels_off_net": "duels_off - dribbles",
    "duels_off_rate": "if(duels_off <> 0, (duels_off * (duels_off_pct / 100D) - dribbles) / duels_off, 0D)",
    "prog_rate": "passes_prog_pct / 100D",
    "long_rate": "passes_long_pct / 100D",
    "final_rate": "passes_final_pct / 100D",
    "interceptions": "interceptions_raw",
    "clearances": "clearances_raw",
    "duel_efficiency": f"if({LOAD} <> 0, (duels_def * (duels_def_pct / 100D) + clearances_raw) / {LOAD}, 0D)",
    "reading_index": f"if({LOAD} <> 0, def_actions / {LOAD}, 0D)",
    "prog_done": "passes_prog * (passes_prog_pct / 100D)",
    "long_done": "passes_long * (passes_long_pct / 100D)",
    "final_done": "passes_final * (passes_final_pct / 100D)",
    "prog_share": "if(passes <> 0, passes_prog / passes, 0D)",
    "long_share": "if(passes <> 0, passes_long / passes, 0D)",
    "final_share": "if(passes <> 0, passes_final / passes, 0D)",
    "cross_rate": "crosses_pct / 100D",
    "deep_rate": "passes_deep_pct / 100D",
    "deep_recv": "passes_deep_recv",
    "box_done": "passes_box * (passes_box_pct / 100D)",
    "passes_creative": "passes_smart",
    "passes_danger": "passes_key",
    "pass_rate": "passes_pct / 100D",
    "dribble_rate": "dribbles_pct / 100D",
    "att_touches": "touches_box",
    "recv": "passes_recv",
    "long_recv": "passes_long_recv",
    "npxg": "xg90",
    "goals_over_xg": "goals90 - xg90",
    "goals_per_touch": "goals90 / greatest(touches_box, 0.1D)",
    "finish_rate": "shots_pct / 100D",
    "passes_done": "passes * (passes_pct / 100D)",
}


def with_minutes_share(df: DataFrame) -> DataFrame:
    """Minutes over the largest minutes of the whole table (all positions)."""
    most = df.agg(F.coalesce(F.max("minutes"), F.lit(1)).alias("most")).scalar()
    return df.withColumn("minutes_share", F.when(most > 0, C("minutes") / most).otherwise(0.0))


def with_measures(df: DataFrame) -> DataFrame:
    return df.selectExpr("*", *[f"{text} AS {name}" for name, text in MEASURES.items()])


def with_products(df: DataFrame) -> DataFrame:
    """Volume times success for the pairs used by the composites."""
    return df.selectExpr("*", *[f"{a} * {b} AS {name}" for name, (a, b) in config.PRODUCTS.items()])


def with_feed_values(df: DataFrame) -> DataFrame:
    """Let the event feed replace interceptions and clearances, and refresh the duel efficiency.

    The reading index keeps its sheet value.
    """
    pct = F.when(C("duels_def_pct") != 0, C("duels_def_pct")).otherwise(C("duels_def_rate") * 100)
    load = lost_duel_load(C("duels_def"), pct)
    return df.withColumns(
        {
            "interceptions": C("interception_won_p90"),
            "clearances": C("total_clearance_p90"),
            "duel_efficiency": guarded(C("duels_def") * C("duels_def_rate") + C("total_clearance_p90"), load),
        }
    )


def successful_actions(inter: str = "interception_won_p90", clear: str = "total_clearance_p90") -> Column:
    """Interceptions, clearances, defensive duels won and blocks."""
    return total([C(inter), C(clear), C("duels_def") * C("duels_def_rate"), C("outfielder_block_p90")])


def adjusted_cost(actions: Column) -> Column:
    """Duels lost and the fouls beyond them, per successful action; lower is better."""
    lost = C("duels_def") * (F.lit(1.0) - C("duels_def_rate"))
    cost = lost + F.greatest(F.lit(0.0), C("fouls") - F.lit(config.COST_OVERLAP) * lost)
    return guarded(cost, actions, cost)


def style_ratio(inter: str = "interception_won_p90", clear: str = "total_clearance_p90") -> Column:
    """Contact defending over line defending."""
    return guarded(C("duels_def") + C(inter), C(clear) + C("duels_air"))


def share_pct(part: Column, whole: Column) -> Column:
    return guarded(part, whole) * F.lit(100.0)
