"""Aggregates of the site pages and the offline studies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from . import ranks
from .pools import long_form, moments

C = F.col


def facet_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values per facet in long form; nothing is collected into one row."""
    entries = [F.struct(F.lit(c).alias("facet"), C(c).cast("string").alias("value")) for c in columns]
    return (
        df.select(F.explode(F.array(*entries)).alias("e"))
        .select("e.*")
        .where(C("value").isNotNull())
        .distinct()
    )


def filter_bounds(df: DataFrame) -> DataFrame:
    """Published bounds of the search filters."""
    return df.agg(
        F.min(F.when(C("height") > 0, C("height"))).alias("height_min"),
        F.max(F.when(C("height") > 0, C("height"))).alias("height_max"),
        F.lit(0).alias("minutes_min"),
        F.max("minutes").alias("minutes_max"),
        F.min("birth_year").alias("birth_min"),
        F.max("birth_year").alias("birth_max"),
        F.bround(F.min("rating"), 1).alias("rating_min"),
        F.bround(F.max("rating"), 1).alias("rating_max"),
    )


def page_bounds(df: DataFrame, year: int) -> DataFrame:
    """Bounds of the page sliders: ages and ratings widened to a tenth."""
    born = F.when(C("birth_year") != 0, C("birth_year"))
    return df.agg(
        (F.lit(year) - F.max(born)).alias("age_min"),
        (F.lit(year) - F.min(born)).alias("age_max"),
        (F.floor(F.min("rating") * 10) / F.lit(10.0)).alias("rating_min"),
        (F.ceil(F.max("rating") * 10) / F.lit(10.0)).alias("rating_max"),
    )


def counts_over(df: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """Rows per value of a dimension, 0 for values without rows, with the total."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("players"))
    out = values.join(counted, key, "left").withColumn("players", F.coalesce("players", F.lit(0)))
    total = counted.agg(F.coalesce(F.sum("players"), F.lit(0)).alias("t")).scalar()
    return out.withColumn("total", total)


def label_shares(df: DataFrame, label: str, *pool: str) -> DataFrame:
    """Count and percent of every label, per pool."""
    counted = df.groupBy(*pool, label).agg(F.count(F.lit(1)).alias("players"))
    whole = counted.groupBy(*pool).agg(F.sum("players").alias("_n"))
    joined = counted.join(F.broadcast(whole), list(pool)) if pool else counted.withColumn(
        "_n", whole.select("_n").scalar()
    )
    return joined.withColumn("percent", C("players") / C("_n") * F.lit(100.0)).drop("_n")


def descriptives(df: DataFrame, values: Mapping[str, str | Column]) -> DataFrame:
    """Mean, sample deviation, median and five-number summary, one row per value."""
    long = long_form(df, [], values)
    basic = long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("low"),
        F.max("value").alias("high"),
    )
    points = ranks.exact_quantiles(long, ["metric"], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return basic.join(points, "metric")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, from one pass over the data."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), C(f"c{i}").alias("r"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return row.select(F.explode(cells).alias("e")).select("e.*")


def block_correlations(pairs: DataFrame, first: Sequence[str], second: Sequence[str]) -> DataFrame:
    """Mean correlation inside each block and between the two blocks."""
    a1, b1 = C("a").isin(*first), C("b").isin(*first)
    a2, b2 = C("a").isin(*second), C("b").isin(*second)
    return pairs.agg(
        F.avg(F.when(a1 & b1, C("r"))).alias("inside_first"),
        F.avg(F.when(a2 & b2, C("r"))).alias("inside_second"),
        F.avg(F.when((a1 & b2) | (a2 & b1), C("r"))).alias("between"),
    )


def quantile_bins(df: DataFrame, volume: str, value: str, bins: int = 4) -> DataFrame:
    """Mean, deviation and count of a value per volume quantile bin (right-closed bins)."""
    points = {f"q{i}": i / bins for i in range(1, bins)}
    edges = ranks.exact_quantiles(
        df.select(F.lit(0).alias("_all"), C(volume).cast("double").alias("value")), ["_all"], points
    )
    joined = df.withColumn("_all", F.lit(0)).join(F.broadcast(edges), "_all")
    number = F.lit(1)
    for name in points:
        number = number + F.when(C(volume) > C(name), 1).otherwise(0)
    return _bin_summary(joined.withColumn("bin", number), volume, value)


def width_bins(df: DataFrame, volume: str, value: str, bins: int = 7, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """The same per equal-width bin between two quantiles; rows outside are left out."""
    edges = ranks.exact_quantiles(
        df.select(F.lit(0).alias("_all"), C(volume).cast("double").alias("value")), ["_all"], {"lo": low, "hi": high}
    )
    joined = df.withColumn("_all", F.lit(0)).join(F.broadcast(edges), "_all")
    joined = joined.where(C(volume).between(C("lo"), C("hi")))
    step = (C("hi") - C("lo")) / F.lit(float(bins))
    number = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((C(volume) - C("lo")) / step))).cast("int")
    return _bin_summary(joined.withColumn("bin", number), volume, value)


def _bin_summary(df: DataFrame, volume: str, value: str) -> DataFrame:
    return df.groupBy("bin").agg(
        F.avg(volume).alias("volume_mean"),
        F.avg(value).alias("value_mean"),
        F.stddev_samp(value).alias("value_sd"),
        F.count(F.lit(1)).alias("n"),
    )


def histogram(df: DataFrame, score: str, edges: int, low: float, high: float, margin: float = 2.0) -> DataFrame:
    """Counts per bin between the score range widened by a margin and held inside low..high."""
    ends = df.agg(
        F.greatest(F.lit(float(low)), F.min(score) - margin).alias("lo"),
        F.least(F.lit(float(high)), F.max(score) + margin).alias("hi"),
    ).withColumn("_all", F.lit(0))
    bins = edges - 1
    step = (C("hi") - C("lo")) / F.lit(float(bins))
    number = F.least(F.lit(bins - 1), F.floor((C(score) - C("lo")) / step)).cast("int")
    return (
        df.withColumn("_all", F.lit(0))
        .join(F.broadcast(ends), "_all")
        .where(C(score).between(C("lo"), C("hi")))
        .groupBy(number.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def cap_hits(df: DataFrame, residual: str, cap: float, *pool: str) -> DataFrame:
    """Share of residuals beyond the cap and their population deviation."""
    return df.groupBy(*pool).agg(
        F.avg(F.when(F.abs(C(residual)) > cap, 100.0).otherwise(0.0)).alias("hit_pct"),
        F.stddev_pop(residual).alias("sd"),
    )


def spearman(df: DataFrame, pool: Sequence[str], id_col: str, a: str, b: str) -> DataFrame:
    """Rank correlation per pool: Pearson on average ranks."""
    ranked = ranks.rank_columns(df, pool, id_col, {"_ra": (a, "average"), "_rb": (b, "average")})
    return ranked.groupBy(*pool).agg(F.corr("_ra", "_rb").alias("rho"))


def confusion(df: DataFrame, true: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """Counts of predicted labels per true label over a fixed label order."""
    return (
        df.where(C(true).isin(*labels))
        .groupBy(true)
        .pivot(predicted, list(labels))
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )


def agreement(df: DataFrame, base: str, *others: str) -> DataFrame:
    """How often the label columns agree with each other and with the base label."""
    models = [C(o) for o in others]
    unstable = F.lit(False)
    moved = F.lit(False)
    for m in models:
        unstable = unstable | (m != models[0])
        moved = moved | (m != C(base))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~unstable).alias("all_agree"),
        F.count_if(unstable).alias("unstable"),
        F.count_if(moved).alias("moved"),
    )


def family_dimension(spark, names: Sequence[str] | None = None) -> DataFrame:
    names = list(names or config.FAMILIES)
    return spark.createDataFrame([(n,) for n in names], "position_family string")
