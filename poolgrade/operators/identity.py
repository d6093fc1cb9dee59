"""Identity columns: position and foot codes, labels, ids, birth years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import display_label, id_slug
from .ranks import ordinal


IDENTITY = ("label", "player_id", "position", "family", "foot", "birth_year")


def lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def position_of(raw: Column) -> Column:
    """Position of a possibly multi-valued code such as "RCB, RB"; null when unknown."""
    first = F.trim(F.get(F.split(raw, ","), F.lit(0)))
    known = list(dict.fromkeys(config.POSITION_OF_CODE.values()))
    return F.coalesce(
        F.try_element_at(lookup(config.POSITION_OF_CODE), first),
        F.when(F.lower(raw).contains("zagueiro"), F.lit("Zagueiro")),
        F.when(raw.isin(*known), raw),
    )


def foot_of(raw: Column) -> Column:
    """Foot label; unknown words are title-cased, missing and NaN cells are null."""
    text = F.lower(F.trim(raw))
    missing = raw.isNull() | text.isin("nan", "unknown", "")
    return F.when(~missing, F.coalesce(F.try_element_at(lookup(config.FOOT_OF_CODE), text), F.initcap(F.trim(raw))))


def with_identity(df: DataFrame, index: str) -> DataFrame:
    """Add label, id, position, family, foot and birth year; ``index`` holds the row index."""
    position = position_of(F.col("position_raw"))
    return df.withColumns(
        {
            "label": display_label(F.col("name"), F.col("club")),
            "player_id": id_slug(F.col("name"), F.coalesce("club", F.lit("")), F.col(index)),
            "position": position,
            "family": F.try_element_at(lookup(config.POSITION_FAMILY), position),
            "foot": foot_of(F.col("foot_raw")),
            "birth_year": F.lit(config.SEASON_YEAR) - F.col("age"),
        }
    )


def outfield(df: DataFrame) -> DataFrame:
    """Rows with a known position other than goalkeeper."""
    return df.where(F.col("position").isNotNull() & (F.col("position") != config.GOALKEEPER))


def with_row_index(df: DataFrame, order: list[Column], key: str, out: str = "row_index") -> DataFrame:
    """Deterministic 0-based row number under the stated order."""
    return ordinal(df, [], order, key, out).withColumn(out, F.col(out) - 1)


def age_in(year: int, born: Column | str = "birth_year") -> Column:
    return F.lit(year) - (F.col(born) if isinstance(born, str) else born)
