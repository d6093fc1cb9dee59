"""Grades, badges, tiers and other labels read off a score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import clamp

# Lower bounds and labels, best first.
GRADES = ((85, "A"), (75, "B+"), (65, "B"), (55, "B-"), (45, "C+"), (35, "C"), (25, "C-"))
LOWEST_GRADE = "D"
BADGES = ((90, "gold"), (75, "silver"), (50, "bronze"))
MEDALS = ((0.1, "gold"), (0.25, "silver"), (0.4, "bronze"))
TIERS = ((85, 5), (68, 4), (48, 3), (28, 2))
GRADE_SCORES = {
    "A+": 97,
    "A": 92,
    "A-": 87,
    "B+": 80,
    "B": 70,
    "B-": 60,
    "C+": 50,
    "C": 40,
    "C-": 30,
    "D+": 22,
    "D": 15,
    "D-": 10,
    "E": 6,
    "F": 2,
}
UNKNOWN_GRADE_SCORE = 40


def _ladder(value: Column, steps, otherwise, above) -> Column:
    out = None
    for bound, label in steps:
        test = above(value, bound)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out if otherwise is None else out.otherwise(F.lit(otherwise))


def letter_grade(percentile: Column) -> Column:
    return _ladder(F.coalesce(percentile, F.lit(0.0)), GRADES, LOWEST_GRADE, lambda v, b: v >= b)


def volume_badge(percentile: Column) -> Column:
    return _ladder(percentile, BADGES, None, lambda v, b: v > b)


def dual_badge(volume: Column, efficiency: Column) -> Column:
    """Badge of the weaker of the two percentiles; none without an efficiency."""
    return F.when(efficiency.isNotNull(), volume_badge(F.least(volume, efficiency)))


# What the efficiency among an aspect's parts is called, and the aspect that volume alone decides.
EFFICIENCY_PARTS = ("Eficiência", "Eficiência Defensiva")
VOLUME_ASPECT = "Conduções Progressivas"


def aspect_badge(item: Column) -> Column:
    """Badge of an aspect: of its pair, of a part and its efficiency, of two parts, of its own efficiency, or of volume."""
    pair, parts = item["pair_badge"], item["sub_metrics"]
    paired = dual_badge(F.get(pair, 0), F.get(pair, 1))
    at = F.array_position(F.transform(parts, lambda x: x["label"].isin(*EFFICIENCY_PARTS)), True)
    others = F.filter(F.transform(parts, lambda x, i: F.when(i + 1 != at, x["percentile"])), lambda v: v.isNotNull())
    part = dual_badge(F.get(others, 0), F.get(parts, (at - 1).cast("int"))["percentile"])
    two = dual_badge(F.get(parts, 0)["percentile"], F.get(parts, 1)["percentile"])
    group = F.when(pair.isNotNull(), paired).when((at > 0) & (F.size(others) > 0), part).when(F.size(parts) == 2, two)
    alone = F.when(
        item["efficiency_pct"].isNotNull() & item["percentile"].isNotNull(), dual_badge(item["percentile"], item["efficiency_pct"])
    ).when(item["label"] == VOLUME_ASPECT, volume_badge(item["percentile"]))
    defence = (item["kind"] == "def_efficiency_group") & pair.isNotNull()
    return F.when(defence, paired).otherwise(F.coalesce(F.when(item["kind"] == "metric_group", group), alone))


def medal(rank: Column, pool_size: Column) -> Column:
    return F.when(pool_size > 0, _ladder(rank / pool_size, MEDALS, None, lambda v, b: v <= b))


def tier(score: Column) -> Column:
    return _ladder(score, TIERS, 1, lambda v, b: v >= b)


def rating_tier(rating: Column, top: float = 10.0) -> Column:
    return tier(rating / F.lit(top) * F.lit(100.0))


def grade_score(grade: Column) -> Column:
    text = F.translate(F.upper(F.trim(grade)), "−–", "--")
    pairs = [x for k, v in GRADE_SCORES.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), text), F.lit(UNKNOWN_GRADE_SCORE))


def rank_percentile(rank: Column, pool_size: Column) -> Column:
    return F.when(pool_size == 0, 0.0).otherwise(clamp((pool_size - rank) / pool_size * F.lit(100.0), 0, 100))


def top_percent(rank: Column, pool_size: Column) -> Column:
    """The "Top p %" figure shown next to a rating."""
    ahead = F.floor((pool_size - rank) / pool_size * F.lit(100.0) + F.lit(0.5))
    return F.when(pool_size > 0, F.greatest(F.lit(1), F.lit(100) - ahead)).otherwise(0).cast("bigint")


def quadrant(x: Column, y: Column, mean_x: Column, mean_y: Column) -> Column:
    return (
        F.when((x >= mean_x) & (y >= mean_y), "Alto em ambos")
        .when(y >= mean_y, "Alto em Y")
        .when(x >= mean_x, "Alto em X")
        .otherwise("Abaixo da média")
    )


def consensus(a: Column, b: Column, c: Column) -> Column:
    """The label two of three models share, else "Instável"."""
    return F.when((a == b) | (a == c), a).when(b == c, b).otherwise(F.lit("Instável"))


def macro_profile(profile: Column) -> Column:
    return (
        F.when(profile == "Construtor", "Construtor")
        .when(profile.isin("Posicional", "Combativo", "Defensivo", "Defensor de Área"), "Defensivo")
        .otherwise("Híbrido")
    )
