"""Enrichment joins: scores, gaps, cascades, upserts and name matches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import contained_texts

C = F.col


def with_scores(df: DataFrame, scores: DataFrame, key: str, columns: Sequence[str], default: float = 50.0) -> DataFrame:
    """Left join of score columns: the new value, else the own one, else the default."""
    found = scores.select(key, *[C(c).alias(f"_new_{c}") for c in columns])
    joined = df.join(found, key, "left")
    own = {c: C(c) if c in df.columns else F.lit(None).cast("double") for c in columns}
    return joined.withColumns(
        {c: F.coalesce(C(f"_new_{c}"), own[c], F.lit(default)) for c in columns}
    ).drop(*[f"_new_{c}" for c in columns])


def merge_metrics(frames: Mapping[str, DataFrame], ids: Sequence[str], score: str = "score") -> DataFrame:
    """Full outer merge of one-score frames on their ids, as one stacked pivot instead of a chain of joins."""
    stacked = None
    for name, frame in frames.items():
        part = frame.select(*ids, F.lit(name).alias("_metric"), C(score).alias("_score"))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy(*ids).pivot("_metric", list(frames)).agg(F.max("_score"))


def with_raw_columns(df: DataFrame, raw: DataFrame, key: str, suffix: str = "_raw") -> DataFrame:
    """Inner join with the raw rows; columns both sides have get a suffix on the raw side."""
    renamed = raw.select(key, *[C(c).alias(c + suffix if c in df.columns else c) for c in raw.columns if c != key])
    return df.join(renamed, key)


def only_in(df: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    return df.join(pool.select(key), key, "left_semi")


def missing_from(df: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    return df.join(resolved.select(key), key, "left_anti")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in a stated order, by aggregation rather than a sort of each group."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(first.alias("_r")).select(*keys, *[C(f"_r.{c}").alias(c) for c in rest])


def cascade(players: DataFrame, sources: Mapping[str, DataFrame], key: str, column: str) -> DataFrame:
    """The first source that knows the player, after the value already held, and its name.

    Every source has one row per key.
    """
    out = players
    for name, source in sources.items():
        out = out.join(source.select(key, C(column).alias(f"_{name}")), key, "left")
    value = F.coalesce(C(column), *[C(f"_{n}") for n in sources])
    origin = F.when(C(column).isNotNull(), "existing")
    for name in sources:
        origin = origin.when(C(f"_{name}").isNotNull(), name)
    return out.select(
        *[C(c) for c in players.columns if c != column], value.alias(column), origin.alias("origin")
    )


def recovered(df: DataFrame, origin: str) -> DataFrame:
    """How many rows one source contributed."""
    return df.agg(F.count_if(C("origin") == origin).alias("recovered"), F.count(F.lit(1)).alias("players"))


def upsert(df: DataFrame, resolved: DataFrame, key: str, column: str) -> DataFrame:
    """Resolved values replace the stored ones; other rows keep theirs."""
    return df.join(resolved.select(key, C(column).alias("_new")), key, "left").select(
        *[F.coalesce("_new", column).alias(column) if c == column else C(c) for c in df.columns]
    )


def unresolved(df: DataFrame, key: str, *passes: DataFrame) -> DataFrame:
    """Rows no matching pass resolved."""
    for done in passes:
        df = missing_from(df, done, key)
    return df


def match_named_rows(players: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """First row of the same name whose club contains the first word of the player's club, else the
    first row of the name.

    ``players``: player_id, name, club; ``rows``: name, club and the ``order`` column, which is
    unique. Adds ``row_key``. The club test runs on distinct club texts, so a name that many players
    share never meets all rows of that name.
    """
    word = F.lower(F.get(F.split(F.trim("club"), " "), F.lit(0)))
    asked = players.select("player_id", "name", word.alias("_word"))
    listed = rows.groupBy("name", F.lower("club").alias("_club")).agg(F.min(order).alias("_at"))
    clubs = contained_texts(
        asked.select("_word").distinct(), "_word", listed.select("_club").distinct(), "_club"
    )
    near = (
        asked.select("name", "_word")
        .distinct()
        .join(clubs, "_word")
        .join(listed, ["name", "_club"])
        .groupBy("name", "_word")
        .agg(F.min("_at").alias("_near"))
    )
    anyone = listed.groupBy("name").agg(F.min("_at").alias("_any"))
    return (
        asked.join(near, ["name", "_word"], "left")
        .join(anyone, "name")
        .select("player_id", F.coalesce("_near", "_any").alias("row_key"))
    )
