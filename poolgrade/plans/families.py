"""Ratings, profiles and tendencies of the families that share one scheme.

All families run in one job: every z-score is taken inside its family, and the formula of a row
is picked by its family key.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import steady, total, weighted
from ..operators.pools import clipped_z
from ..operators.ranks import rank_columns
from ..session import settle
from .common import exposure_gain

C = F.col
FAMILY = ["family"]

OVERALL = {
    "off_pct": "duels_off_net + dribbles + touches_box + shots",
    "con_pct": "passes_prog * prog_rate + passes_final * final_rate",
    "def_pct": "duels_def * duels_def_rate + interceptions",
    "prog_pct": "carry_prog",
}
# tendency -> (block if the family has it, fallback column)
TENDENCY_SOURCES = {
    "n_construcao": ("blk_construcao", "prog_done"),
    "n_conducao": ("blk_conducao", "carry_prog"),
    "n_duelos_def": ("blk_duelos_def", "duel_efficiency"),
    "n_leitura_def": ("blk_leitura", "reading_index"),
}


def overall_mix() -> Column:
    return weighted([(0.2, C("off_pct")), (0.3, C("con_pct")), (0.3, C("def_pct")), (0.2, C("prog_pct"))])


def overall_formula() -> Column:
    return steady((F.lit(5.0) + overall_mix() * F.lit(0.045)) * exposure_gain(C("minutes_share")) * F.lit(0.83))


def overall_rating(df: DataFrame, pool: Sequence[str]) -> DataFrame:
    """Four pool percentiles mixed into the general rating."""
    ranked = rank_columns(df, pool, "player_id", {n: (F.expr(e), "dense") for n, e in OVERALL.items()})
    return settle(ranked.withColumn("rating_geral", overall_formula()), "overall")


def by_family(choices: Mapping[str, Column]) -> Column:
    """The expression of the row's own family; null for families without one."""
    out = None
    for key, expr in choices.items():
        test = C("family") == key
        out = F.when(test, expr) if out is None else out.when(test, expr)
    return out


def z_sources(families: Sequence[str]) -> list[str]:
    return sorted({m for f in families for block in config.FAMILIES[f].blocks.values() for m in block})


def block_columns(families: Sequence[str]) -> dict[str, Column]:
    """One ``blk_`` column per block name over the given families."""
    names = list(dict.fromkeys(b for f in families for b in config.FAMILIES[f].blocks))
    out = {}
    for name in names:
        choices = {
            f: weighted([(w, C(f"z_{m}")) for m, w in config.FAMILIES[f].blocks[name].items()])
            for f in families
            if name in config.FAMILIES[f].blocks
        }
        out[f"blk_{name}"] = steady(by_family(choices))
    return out


def index_slots(families: Sequence[str]) -> dict[str, Column]:
    """Indices in their order of listing as ``idx_1``, ``idx_2`` ...; families have two to four."""
    most = max(len(config.FAMILIES[f].indices) for f in families)
    out = {}
    for slot in range(most):
        choices = {}
        for f in families:
            indices = list(config.FAMILIES[f].indices.values())
            if slot < len(indices):
                index = indices[slot]
                terms = weighted([(w, C(f"blk_{b}")) for b, w in index.terms.items()])
                choices[f] = F.lit(index.scale) * (terms + F.lit(2.0))
        out[f"idx_{slot + 1}"] = steady(by_family(choices))
    return out


def with_blocks(df: DataFrame, families: Sequence[str]) -> DataFrame:
    """z-scores, block composites and profile indices."""
    z = clipped_z(df, FAMILY, {m: m for m in z_sources(families)})
    return z.withColumns(block_columns(families)).withColumns(index_slots(families))


def with_shares(df: DataFrame, slots: int, guard: bool = True) -> DataFrame:
    """Index shares of a row; a zero row sum counts as 1 when guarded."""
    names = [f"idx_{i + 1}" for i in range(slots)]
    whole = total([F.coalesce(C(n), F.lit(0.0)) for n in names])
    if guard:
        whole = F.when(whole == 0, 1.0).otherwise(whole)
    return df.withColumns({f"share_{i + 1}": C(n) / whole for i, n in enumerate(names)})


def profile_by_margin(families: Sequence[str], slots: int) -> Column:
    """Label of the largest share when it leads by the family's threshold, else the hybrid label."""
    choices = {}
    for f in families:
        family = config.FAMILIES[f]
        ordered = F.sort_array(
            F.array(
                *[
                    F.struct(C(f"share_{i + 1}").alias("share"), F.lit(-i).alias("turn"), F.lit(ix.label).alias("label"))
                    for i, ix in enumerate(family.indices.values())
                ]
            ),
            asc=False,
        )
        lead = F.get(ordered, 0)["share"] - F.get(ordered, 1)["share"]
        choices[f] = F.when(lead >= family.threshold, F.get(ordered, 0)["label"]).otherwise(config.HYBRID)
    return by_family(choices)


def tendency_columns(blocks: Sequence[str]) -> dict[str, Column]:
    out = {
        name: F.coalesce(C(block), C(fallback)) if block in blocks else C(fallback)
        for name, (block, fallback) in TENDENCY_SOURCES.items()
    }
    out["n_duelo_ar"] = C("duels_air") * C("duels_air_rate")
    return out


def needed_columns(families: Sequence[str]) -> list[str]:
    """The columns the ratings read; nothing else is carried through the intermediate writes."""
    overall = [c for text in OVERALL.values() for c in re.findall(r"[a-z_]\w*", text)]
    fallback = [c for _, c in TENDENCY_SOURCES.values()]
    names = ["player_id", "family", "minutes_share", "duels_air", "duels_air_rate"]
    return list(dict.fromkeys([*names, *z_sources(families), *overall, *fallback]))


def rate_families(df: DataFrame, families: Sequence[str] = config.GENERIC_FAMILIES) -> DataFrame:
    """Blocks, indices, shares, profile, general and profile ratings with ranks, tendencies."""
    people = df.where(C("family").isin(*families)).select(*needed_columns(families))
    slots = max(len(config.FAMILIES[f].indices) for f in families)
    shaped = with_shares(with_blocks(people, families), slots)
    shaped = shaped.drop(*[f"z_{m}" for m in z_sources(families)])
    shaped = settle(shaped.withColumn("perfil", profile_by_margin(families, slots)), "blocks")

    wanted = {n: (F.expr(e), "dense") for n, e in OVERALL.items()}
    wanted |= {n: (e, "dense") for n, e in tendency_columns(shaped.columns).items()}
    wanted |= {f"idx_pct_{i + 1}": (f"idx_{i + 1}", "dense") for i in range(slots)}
    ranked = rank_columns(shaped, FAMILY, "player_id", wanted)
    profile = {
        f"rating_{i + 1}": steady(
            F.lit(5.0) + C(f"idx_pct_{i + 1}") * F.lit(0.045) * F.lit(0.88) * exposure_gain(C("minutes_share"))
        )
        for i in range(slots)
    }
    rated = ranked.withColumn("rating_geral", overall_formula()).withColumns(profile)
    # what was ranked and mixed is not read again
    spent = {*needed_columns(families), *OVERALL, *[f"idx_pct_{i + 1}" for i in range(slots)]}
    rated = settle(rated.drop(*(spent - {"player_id", "family", "minutes_share"})), "rated")

    places = {"rank_geral": ("rating_geral", "rank")}
    places |= {f"rank_{i + 1}": (f"rating_{i + 1}", "rank") for i in range(slots)}
    return rank_columns(rated, FAMILY, "player_id", places)


def rate_plainly(df: DataFrame) -> DataFrame:
    """General rating pulled by minutes confidence, with three side ratings derived from it."""
    from .common import confident

    wanted = {n: (F.expr(e), "dense") for n, e in OVERALL.items()} | {"minutes_pool_pct": ("minutes", "dense")}
    ranked = rank_columns(df, FAMILY, "player_id", wanted)
    base = F.lit(5.0) + overall_mix() * F.lit(0.045) * exposure_gain(C("minutes_share")) * F.lit(0.83)
    rated = settle(
        ranked.withColumn("rating_geral", steady(confident(base, C("minutes_pool_pct")))).withColumns(
            {
                "rating_combativo": C("rating_geral") * 0.98,
                "rating_construtor": C("rating_geral") * 1.02,
                "rating_posicional": C("rating_geral") * 0.99,
            }
        ),
        "plain",
    )
    keys = ("geral", "combativo", "construtor", "posicional")
    return rank_columns(rated, FAMILY, "player_id", {f"rank_{k}": (f"rating_{k}", "rank") for k in keys})
