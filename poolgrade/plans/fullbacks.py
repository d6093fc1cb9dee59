"""Full-backs: three axes, archetypes with badges, confidence-weighted ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import best_label, row_mean, softmax_shares, steady
from ..operators.pools import mean_z
from ..operators.ranks import rank_columns
from ..session import settle
from .common import confident, exposure_gain, shrink

C = F.col
FAMILY = ["family"]
AXES = {"lat_z_def": "Defensivo", "lat_z_con": "Construtor", "lat_z_off": "Ofensivo"}


def with_axes(df: DataFrame) -> DataFrame:
    """The three axis scores: the mean z of the columns of each axis."""
    sources = sorted({c for cols in config.FB_AXES.values() for c in cols})
    z = mean_z(df, FAMILY, {c: c for c in sources})
    return z.withColumns(
        {axis: steady(row_mean([C(f"mz_{c}") for c in config.FB_AXES[label]])) for axis, label in AXES.items()}
    ).drop(*[f"mz_{c}" for c in sources])


def strong_labels() -> Column:
    """Sorted labels of the axes at or above the strong limit."""
    marks = [F.when(C(axis) >= config.STRONG_Z, F.lit(label)) for axis, label in AXES.items()]
    return F.sort_array(F.filter(F.array(*marks), lambda m: m.isNotNull()))


def primary_label() -> Column:
    """Best axis; a builder needs a clear score that beats the attacking one."""
    z_def, z_con, z_off = (C(a) for a in AXES)
    best = best_label([(label, C(axis)) for axis, label in AXES.items()])
    fallback = F.when(z_off >= z_def, "Ofensivo").otherwise("Defensivo")
    weak_builder = (best == "Construtor") & ((z_con < config.BUILDER_MIN_Z) | (z_off >= z_con))
    return F.when(F.greatest(z_def, z_con, z_off) < 0, "Defensivo").when(weak_builder, fallback).otherwise(best)


def _badge(part: int) -> Column:
    strong = C("strong")
    out = F.when(F.size(strong) >= 3, config.FB_TRIPLE_BADGE[part])
    for pair, names in config.FB_PAIR_BADGES.items():
        out = out.when(strong == F.array(*[F.lit(p) for p in pair]), names[part])
    return out


def with_archetypes(df: DataFrame) -> DataFrame:
    """Archetype, hybrid badge and mix shares of each row."""
    labelled = df.withColumn("strong", strong_labels()).withColumn(
        "cluster_archetype", F.when(F.size("strong") >= 2, config.HYBRID).otherwise(primary_label())
    )
    boosted = [
        C(axis) + F.when(C("cluster_archetype") == label, 1.0).otherwise(0.0) for axis, label in AXES.items()
    ]
    shares = softmax_shares(boosted)
    return labelled.withColumns(
        {
            "cluster_hybrid_badge": _badge(0),
            "cluster_hybrid_badge_short": _badge(1),
            **{
                f"cluster_share_{label.lower()}": F.bround(steady(share), 1)
                for label, share in zip(AXES.values(), shares)
            },
        }
    )


def axis_rating(percentile: Column, minutes_pct: Column, share: Column) -> Column:
    return confident(
        F.lit(5.0) + percentile * F.lit(0.045) * F.lit(0.88) * exposure_gain(share), minutes_pct
    )


def needed_columns() -> list[str]:
    names = ["player_id", "family", "minutes", "minutes_share", "reading_index", "duels_air_done"]
    return list(dict.fromkeys([*names, *[c for cols in config.FB_AXES.values() for c in cols]]))


def rate_fullbacks(df: DataFrame) -> DataFrame:
    people = df.where(C("family") == "laterais").select(*needed_columns())
    people = settle(with_archetypes(with_axes(people)), "fullbacks")
    ranked = rank_columns(
        people,
        FAMILY,
        "player_id",
        {
            "minutes_pool_pct": ("minutes", "dense"),
            "n_duelos_def": ("lat_z_def", "dense"),
            "n_construcao": ("lat_z_con", "dense"),
            "n_conducao": ("lat_z_off", "dense"),
            "n_leitura_def": ("reading_index", "dense"),
            "n_duelo_ar": ("duels_air_done", "dense"),
        },
    )
    pct = {"defensivo": C("n_duelos_def"), "construtor": C("n_construcao"), "ofensivo": C("n_conducao")}
    share, played = C("minutes_share"), C("minutes_pool_pct")
    core = pct["defensivo"] * 0.30 + pct["construtor"] * 0.35 + pct["ofensivo"] * 0.35
    overall = confident(
        shrink(F.lit(5.0) + core / F.lit(100.0) * F.lit(4.5), share, config.RATING_MU), played
    )
    rated = ranked.withColumns(
        {
            **{f"rating_{k}": F.bround(steady(axis_rating(p, played, share)), 1) for k, p in pct.items()},
            "rating_geral": F.bround(steady(overall), 1),
            "perfil": C("cluster_archetype"),
        }
    )
    rated = settle(rated, "fullbacks-rated")
    keys = ("geral", "defensivo", "construtor", "ofensivo")
    return rank_columns(rated, FAMILY, "player_id", {f"rank_{k}": (f"rating_{k}", "rank") for k in keys})
