"""Rating pieces shared by the families: exposure, confidence and note scales."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import clamp
from ..operators.pools import moments


def shrink(value: Column, share: Column, mu: float) -> Column:
    """Pull a value to ``mu`` the more, the smaller the minutes share."""
    weight = F.least(F.lit(1.0), F.pow(share, F.lit(config.SHRINK_EXPONENT)))
    return F.lit(mu) + weight * (value - F.lit(mu))


def minutes_confidence(minutes_pct: Column) -> Column:
    """1 above the 75th percentile of minutes in the pool, down to 0.7 at the bottom."""
    at = clamp(F.coalesce(minutes_pct, F.lit(0.0)), 0, 100)
    span = 1.0 - config.CONFIDENCE_FLOOR
    ramp = F.lit(config.CONFIDENCE_FLOOR) + F.lit(span) * F.pow(
        at / F.lit(config.CONFIDENCE_CUTOFF), F.lit(config.CONFIDENCE_EXPONENT)
    )
    return F.when(at > config.CONFIDENCE_CUTOFF, 1.0).otherwise(ramp)


def confident(rating: Column, minutes_pct: Column) -> Column:
    return F.lit(config.RATING_MU) + (rating - F.lit(config.RATING_MU)) * minutes_confidence(minutes_pct)


def sample_trust(actions: Column, minutes_pct: Column) -> Column:
    """Trust in a defensive efficiency: enough actions and enough minutes."""
    span = config.SAMPLE_HIGH - config.SAMPLE_LOW
    enough = F.pow(clamp((actions - F.lit(config.SAMPLE_LOW)) / F.lit(span), 0, 1), F.lit(config.SAMPLE_EXPONENT))
    at = clamp(F.coalesce(minutes_pct, F.lit(0.0)), 0, 100)
    played = F.when(
        at <= config.CONFIDENCE_CUTOFF,
        F.pow(at / F.lit(config.CONFIDENCE_CUTOFF), F.lit(config.SAMPLE_MINUTES_EXPONENT)),
    ).otherwise(1.0)
    return enough * played


def exposure_gain(share: Column) -> Column:
    return F.lit(1.0) + share * F.lit(0.15)


def tanh_note(df: DataFrame, pool: Sequence[str], notes: Mapping[str, str]) -> DataFrame:
    """Notes around 6.5 that flatten towards the ends of the pool; output name -> score column."""
    stats = moments(df, pool, {n: v for n, v in notes.items()}, "mean", "sd")
    made = {}
    for name, score in notes.items():
        z = (F.col(score) - F.col(f"mean_{name}")) / (F.col(f"sd_{name}") * F.lit(config.NOTE_TAU))
        made[name] = F.when(F.coalesce(F.col(f"sd_{name}"), F.lit(0.0)) == 0, config.NOTE_MU).otherwise(
            F.lit(config.NOTE_MU) + F.lit(config.NOTE_SCALE) * F.tanh(z)
        )
    return df.join(F.broadcast(stats), list(pool)).select(*df.columns, *[e.alias(n) for n, e in made.items()])
