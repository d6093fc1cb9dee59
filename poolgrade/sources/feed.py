"""Match event feed: one row per athlete and match, rolled up per athlete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import per90


def played(feed: DataFrame) -> DataFrame:
    """Rows with minutes on the pitch and the side the athlete played for."""
    side = F.when(F.col("is_home"), F.col("home_team")).otherwise(F.col("away_team"))
    return feed.where(F.col("minutes_played") > 0).withColumn("team", side).drop("home_team", "away_team", "is_home")


def primary_team(rows: DataFrame) -> DataFrame:
    """The team with most minutes per athlete; the first name in order wins a tie."""
    per_team = rows.groupBy("player_id", "team").agg(F.sum("minutes_played").alias("m"))
    best = F.min_by("team", F.struct(-F.col("m"), F.col("team")))
    return per_team.groupBy("player_id").agg(best.alias("primary_team"))


def roll_up(feed: DataFrame) -> DataFrame:
    """Minutes, distinct matches, counters, per-90 rates and primary team per athlete."""
    rows = played(feed)
    totals = rows.groupBy("player_id", "player_name").agg(
        F.sum("minutes_played").alias("minutes_played"),
        F.countDistinct("event_id").alias("matches"),
        *[F.sum(c).alias(c) for c in config.FEED_COUNTERS],
    )
    rates = {f"{c}_p90": F.col(c) / F.col("minutes_played") * F.lit(90.0) for c in config.FEED_COUNTERS}
    return totals.join(primary_team(rows), "player_id").withColumns(rates)
