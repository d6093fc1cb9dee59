"""Faceted search over the player index: predicates composed from the given filters only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import collation_key, contains_folded
from .identity import age_in

C = F.col
Range = tuple[float, float]


@dataclass(frozen=True)
class Filters:
    """A search request; an absent filter adds no predicate, "all" matches everything."""

    family: str | None = None
    club: str | None = None
    nationality: str | None = None
    foot: str | None = None
    profiles: Sequence[str] = ()
    height: Range | None = None
    minutes: Range | None = None
    birth_year: Range | None = None
    age: Range | None = None
    rating: Range | None = None
    search: str | None = None
    tendencies: Mapping[str, Range] = field(default_factory=dict)


def _every(tests: Sequence[Column]) -> Column:
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


def _inside(column: str, bounds: Range) -> Column:
    return C(column).between(*bounds)


def _facets(filters: Filters) -> list[Column]:
    tests = []
    if filters.family:
        tests.append(C("position_family") == filters.family)
    for name in ("club", "nationality", "foot"):
        wanted = getattr(filters, name)
        if wanted and wanted != "all":
            tests.append(C(name) == wanted)
    if filters.profiles:
        tests.append(C("profile").isin(*filters.profiles))
    for name in ("minutes", "rating"):
        bounds = getattr(filters, name)
        if bounds:
            tests.append(_inside(name, bounds))
    return tests


def tendency_test(tendencies: Mapping[str, Range]) -> Column:
    """Every wanted tendency inside its range; a missing dossier fails."""
    return F.coalesce(
        _every([C(f"tendencies.{key}").between(*bounds) for key, bounds in tendencies.items()]), F.lit(False)
    )


def search_index(df: DataFrame, filters: Filters) -> DataFrame:
    """The server search: unknown heights and birth years pass, text matches label or club."""
    tests = _facets(filters)
    for name in ("height", "birth_year"):
        bounds = getattr(filters, name)
        if bounds:
            tests.append(C(name).isNull() | _inside(name, bounds))
    if filters.search:
        needle = filters.search.lower()
        tests.append(F.lower("label").contains(needle) | F.lower("club").contains(needle))
    if filters.tendencies:
        tests.append(tendency_test(filters.tendencies))
    return df.where(_every(tests))


def search_rows(df: DataFrame, filters: Filters, year: int) -> DataFrame:
    """The page search: height 0 means not recorded, ages replace birth years, text matches name or club."""
    tests = _facets(filters)
    if filters.height:
        tests.append(C("height").isNull() | (C("height") == 0) | _inside("height", filters.height))
    if filters.age:
        tests.append(C("birth_year").isNull() | age_in(year).between(*filters.age))
    if filters.search and filters.search.strip():
        tests.append(contains_folded(C("name"), filters.search) | contains_folded(C("club"), filters.search))
    if filters.tendencies:
        tests.append(tendency_test(filters.tendencies))
    return df.where(_every(tests))


BUILDER_BADGES = (config.ANCHOR_BADGE[0], config.NATIVE_BADGE[0])
FULLBACK_BADGES = (*[b[0] for b in config.FB_PAIR_BADGES.values()], config.FB_TRIPLE_BADGE[0])
CB_ARCHETYPES = tuple(config.CB_AXES)
FB_ARCHETYPES = (*config.FB_AXES, config.HYBRID)


def cluster_test(wanted: Sequence[str], fullback: Column, archetype: Column, badge: Column) -> Column:
    """Badge selections override archetype selections; rows without a cluster never match."""
    if not wanted:
        return F.lit(True)

    def side(badges: Sequence[str], archetypes: Sequence[str]) -> Column:
        picked = [w for w in wanted if w in badges]
        if picked:
            return badge.isin(*picked)
        picked = [w for w in wanted if w in archetypes]
        return archetype.isin(*picked) if picked else F.lit(True)

    test = F.when(fullback, side(FULLBACK_BADGES, FB_ARCHETYPES)).otherwise(side(BUILDER_BADGES, CB_ARCHETYPES))
    return archetype.isNotNull() & F.coalesce(test, F.lit(False))


def sort_keys(sort: str) -> list[Column]:
    """Order of the result list; the id settles ties."""
    first = {
        "rating": C("rating").desc_nulls_last(),
        "minutes": C("minutes").desc_nulls_last(),
        "age": F.coalesce("birth_year", F.lit(0)).desc(),
        "name": collation_key(C("name")).asc_nulls_last(),
    }[sort]
    return [first, C("player_id").asc()]


def search_page(df: DataFrame, filters: Filters, sort: str = "rating", top: int | None = None) -> DataFrame:
    """Filtered rows in order; with ``top`` only the first rows are sorted out."""
    ordered = search_index(df, filters).orderBy(*sort_keys(sort))
    return ordered.limit(top) if top else ordered


def with_dossier_fields(index: DataFrame, dossiers: DataFrame) -> DataFrame:
    """Index rows with goals, assists and tendencies of the dossier, 0 without one.

    The enrichment of the index wins over the one of the dossier.
    """
    zeros = F.struct(*[F.lit(0.0).alias(t) for t in config.TENDENCIES])
    extra = dossiers.select(
        "player_id", "goals", "assists", "tendencies", C("transfermarkt").alias("_enrichment")
    )
    return index.join(extra, "player_id", "left").withColumns(
        {
            "transfermarkt": F.coalesce("transfermarkt", "_enrichment"),
            "goals": F.coalesce("goals", F.lit(0)),
            "assists": F.coalesce("assists", F.lit(0)),
            "tendencies": F.coalesce("tendencies", zeros),
        }
    ).drop("_enrichment")
