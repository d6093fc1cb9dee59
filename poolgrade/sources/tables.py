"""Stat sheets derived from order lines, so the rating jobs run on the given tables.

One part is one athlete: its lines are the match actions, the quantity of the lines with status
"F" are the minutes, counts of lines with a property are the action totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.identity import IDENTITY, with_identity
from ..session import settle_counted

C = F.col


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


KEPT, OPEN = "l_returnflag <> 'R'", "l_linestatus = 'O'"
ACCEPTED, DEEP_DISCOUNT = "l_returnflag = 'A'", "l_discount > 0.055D"
TALLIES = {
    "n": "count(*)",
    "minutes": f"cast(sum(if({OPEN}, 0D, l_quantity)) AS bigint)",
    "o": f"count_if({OPEN})",
    "ow": f"count_if({OPEN} AND {KEPT})",
    "r": f"count_if(NOT {KEPT})",
    "fr": f"count_if(NOT {OPEN} AND NOT {KEPT})",
    "a": f"count_if({ACCEPTED})",
    "af": f"count_if({ACCEPTED} AND NOT {OPEN})",
    "ad": f"count_if({ACCEPTED} AND {DEEP_DISCOUNT})",
    "d": f"count_if({DEEP_DISCOUNT})",
    "t": "count_if(l_tax > 0.045D)",
    "z": "count_if(l_tax < 0.005D)",
    "q": "count_if(l_quantity >= 26)",
}
for _i in range(1, 8):
    TALLIES[f"k{_i}"] = f"count_if(l_linenumber = {_i})"
    TALLIES[f"w{_i}"] = f"count_if(l_linenumber = {_i} AND {KEPT})"

# Sheet values. A per-90 rate is 90 * count / minutes, a percentage 100 * part / whole.
PER90 = {
    "passes": "n",
    "passes_prog": "k1 + k2",
    "passes_long": "k3",
    "passes_final": "k2 + k4",
    "passes_key": "k5",
    "passes_deep": "k6",
    "passes_fwd": "k1 + k3 + k5",
    "passes_smart": "k7",
    "passes_box": "k4 + k5",
    "passes_lat": "k6 + k7",
    "passes_recv": "n - o",
    "passes_long_recv": "d",
    "passes_deep_recv": "t",
    "crosses": "k7 + k3",
    "duels_def": "o",
    "duels_air": "k5 + k6",
    "interceptions_raw": "q",
    "clearances_raw": "r",
    "def_actions": "n - r",
    "shots_blocked": "fr",
    "fouls": "z",
    "duels_off": "k1 + k7 + d",
    "dribbles": "k1",
    "accels": "k2",
    "runs_prog": "k2 + t",
    "shots": "a",
    "touches_box": "a + k7",
    "fouls_won": "z + k3",
    "goals90": "ad",
    "att_actions": "w1 + w7",
    "interception_won_p90": "k2 + w7",
    "total_clearance_p90": "r + k6",
    "outfielder_block_p90": "fr + w6",
    "ball_recovery_p90": "w3",
}
PERCENT = {
    "passes_pct": ("n - r", "n"),
    "passes_prog_pct": ("w1 + w2", "k1 + k2"),
    "passes_long_pct": ("w3", "k3"),
    "passes_final_pct": ("w2 + w4", "k2 + k4"),
    "passes_deep_pct": ("w6", "k6"),
    "passes_box_pct": ("w4 + w5", "k4 + k5"),
    "crosses_pct": ("w7 + w3", "k7 + k3"),
    "duels_def_pct": ("ow", "o"),
    "duels_air_pct": ("w5 + w6", "k5 + k6"),
    "duels_off_pct": ("w1 + w7", "k1 + k7 + d"),
    "dribbles_pct": ("w1", "k1"),
    "shots_pct": ("af", "a"),
}


def tallies(lines: DataFrame, *keys: str) -> DataFrame:
    """Integer totals per key; one pass, combined before the shuffle."""
    return lines.groupBy(*keys).agg(*[F.expr(text).alias(name) for name, text in TALLIES.items()])


def sheet_columns() -> list[str]:
    """Stat-sheet values from the totals, as select expressions."""
    rates = [f"if(minutes <> 0, ({count}) * 90D / minutes, 0D) AS {name}" for name, count in PER90.items()]
    shares = [
        f"if(({whole}) <> 0, ({part}) * 100D / ({whole}), 0D) AS {name}" for name, (part, whole) in PERCENT.items()
    ]
    totals = [
        "cast(ad AS double) AS goals",
        "cast(w4 AS double) AS assists",
        "k5 * 0.125D AS xa",
        "if(minutes <> 0, k4 * 90D / minutes, 0D) * 0.25D AS xg90",
    ]
    return totals + rates + shares


def position_code() -> Column:
    """A position code per part type; the size picks the side, 50 is a keeper, 49 is unknown."""
    small = C("p_size") <= 24
    return (
        F.when(C("p_size") == 50, "GK")
        .when(C("p_size") == 49, "XX")
        .when(C("p_type") == "ECONOMY", F.when(small, "RCB, RB").otherwise("CB"))
        .when(C("p_type") == "MEDIUM", F.when(small, "RB").otherwise("LWB, LB"))
        .when(C("p_type") == "PROMO", F.when(small, "DMF").otherwise("LCMF"))
        .when(C("p_type") == "LARGE", F.when(small, "RW").otherwise("LWF, LW"))
        .when(C("p_type") == "STANDARD", F.when(small, "AMF").otherwise("RAMF"))
        .otherwise("CF")
    )


def part_people() -> dict[str, Column]:
    size = C("p_size")
    return {
        "name": C("p_name"),
        "club": C("p_brand"),
        "position_raw": position_code(),
        "nationality": F.concat(F.lit("NATION_"), (size % 25).cast("string")),
        "foot_raw": F.when(size <= 20, "direito")
        .when(size <= 38, "esquerdo")
        .when(size <= 44, "both")
        .when(size <= 47, "ambos os pes"),
        "age": (F.lit(17) + size % 23).cast("int"),
        "height": F.when(size <= 3, 0).otherwise(F.lit(150) + size).cast("int"),
    }


def part_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """One typed sheet row per part with identity columns."""
    parts = table(spark, folder, "part").select(
        "p_partkey", *[e.alias(n) for n, e in part_people().items()]
    )
    counts = tallies(table(spark, folder, "lineitem"), "l_partkey")
    joined = parts.join(counts, parts["p_partkey"] == counts["l_partkey"], "left").na.fill(0)
    wide = joined.select(
        "p_partkey",
        *part_people(),
        C("minutes").cast("int").alias("minutes"),
        *map(F.expr, sheet_columns()),
    )
    return with_identity(wide, "p_partkey")


KNOWN_PARTS = 4_000_000
"""Part numbers up to this count, known from writing their parts, are broadcast."""


def _season_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").withColumn("season", F.year("l_shipdate"))


def _season_parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        "p_partkey", *[e.alias(n) for n, e in part_people().items()],
        F.when(C("p_size") > 25, "B").otherwise("A").alias("league"),
    )


def season_counts(spark: SparkSession, folder: str, families: Sequence[str] | None = None) -> DataFrame:
    """Totals of each part and shipping year with the part's identity, which is worked out once per part.

    Of all families or the named ones; the lines of other parts are then left out before they are added up.
    """
    lines, people = _season_lines(spark, folder), with_identity(_season_parts(spark, folder), "p_partkey")
    if families is not None:
        people, count = settle_counted(people.where(C("family").isin(*families)), "season-people")
        if count <= KNOWN_PARTS:
            lines = lines.join(F.broadcast(people.select(C("p_partkey").alias("l_partkey"))), "l_partkey", "left_semi")
    counts = tallies(lines, "l_partkey", "season")
    return counts.join(people, counts["l_partkey"] == people["p_partkey"]).drop("l_partkey")


def season_minutes(spark: SparkSession, folder: str) -> DataFrame:
    """Minutes of each part and shipping year, with the league."""
    minutes = F.expr(TALLIES["minutes"]).cast("int").alias("minutes")
    counts = _season_lines(spark, folder).groupBy("l_partkey", "season").agg(minutes)
    parts = _season_parts(spark, folder).select("p_partkey", "league")
    return counts.join(parts, counts["l_partkey"] == parts["p_partkey"]).select("season", "league", "minutes")


def season_sheet(counts: DataFrame) -> DataFrame:
    """One row per part and shipping year, with the league taken from the part size."""
    return counts.select(
        "p_partkey",
        "season",
        "league",
        *part_people(),
        C("minutes").cast("int").alias("minutes"),
        *map(F.expr, sheet_columns()),
        *IDENTITY,
    )


def match_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a match feed: the user is the athlete, the day the match, the event type the side."""
    return table(spark, folder, "events").select(
        C("user_id").alias("player_id"),
        F.concat(F.lit("user "), C("user_id").cast("string")).alias("player_name"),
        F.date_format("ts", "yyyy-MM-dd").alias("event_id"),
        F.floor(C("value") / 10).cast("bigint").alias("minutes_played"),
        C("event_type").isin("click", "view", "purchase").alias("is_home"),
        C("event_type").alias("home_team"),
        F.concat(F.lit("away "), C("event_type")).alias("away_team"),
        F.floor("value").cast("bigint").alias("interception_won"),
        (C("event_type") == "click").cast("bigint").alias("total_clearance"),
        (C("value") > 50).cast("bigint").alias("outfielder_block"),
        F.length("props").cast("bigint").alias("ball_recovery"),
    )
