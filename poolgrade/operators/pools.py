"""Statistics of a pool brought to its rows: moments, z-scores, residuals, scales.

Pool rows are tiny (one per family), so they return to the data as a broadcast. Means and
deviations are plain aggregates; medians come from the distributed rank table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import clamp, steady
from . import ranks


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def eligible(df: DataFrame, min_share: float = config.MIN_POOL_SHARE) -> DataFrame:
    """Rows of a known family whose minutes share is above the limit."""
    return df.where(F.col("family").isNotNull() & (F.col("minutes_share") > min_share))


def study_rows(df: DataFrame, required: Sequence[str], min_minutes: int = config.MIN_STUDY_MINUTES) -> DataFrame:
    """Rows with enough minutes and share and every required value present."""
    return df.dropna(subset=list(required)).where(
        (F.col("minutes") >= min_minutes) & (F.col("minutes_share") > config.MIN_POOL_SHARE)
    )


def long_form(df: DataFrame, pool: Sequence[str], values: Mapping[str, str | Column], *ids: str) -> DataFrame:
    entries = [F.struct(F.lit(n).alias("metric"), _col(v).cast("double").alias("value")) for n, v in values.items()]
    return df.select(*pool, *ids, F.explode(F.array(*entries)).alias("_e")).select(
        *pool, *ids, "_e.metric", "_e.value"
    )


def exact_quantiles(
    df: DataFrame, pool: Sequence[str], values: Mapping[str, str | Column], points: Mapping[str, float]
) -> DataFrame:
    """One row per pool and metric with the wanted quantiles."""
    return ranks.exact_quantiles(long_form(df, pool, values), [*pool, "metric"], points)


def medians(df: DataFrame, pool: Sequence[str], values: Mapping[str, str | Column]) -> DataFrame:
    """One row per pool with a ``med_<name>`` column per value."""
    q = exact_quantiles(df, pool, values, {"median": 0.5})
    return q.groupBy(*pool).agg(
        *[F.max(F.when(F.col("metric") == n, F.col("median"))).alias(f"med_{n}") for n in values]
    )


def moments(df: DataFrame, pool: Sequence[str], values: Mapping[str, str | Column], *kinds: str) -> DataFrame:
    """One row per pool with ``<kind>_<name>`` columns."""
    makers = {
        "mean": F.avg,
        "sd": F.stddev_samp,
        "sdp": F.stddev_pop,
        "min": F.min,
        "max": F.max,
    }
    cells = [makers[k](_col(v)).alias(f"{k}_{n}") for n, v in values.items() for k in kinds]
    return df.groupBy(*pool).agg(F.count(F.lit(1)).alias("pool_size"), *cells)


def _attach(df: DataFrame, stats: DataFrame, pool: Sequence[str], made: Mapping[str, Column]) -> DataFrame:
    keep = [F.col(c) for c in df.columns if c not in made]
    return df.join(F.broadcast(stats), list(pool)).select(*keep, *[e.alias(n) for n, e in made.items()])


def _standard(value: Column, centre: Column, sd: Column) -> Column:
    # a pool of one row has no sample deviation; it scores 0 like a constant pool
    return F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise((value - centre) / sd)


def clipped_z(
    df: DataFrame, pool: Sequence[str], values: Mapping[str, str | Column], prefix: str = "z_", clip: float = 2.0
) -> DataFrame:
    """Median-centred z-scores, scaled by the sample deviation and clipped."""
    stats = moments(df, pool, values, "sd").join(F.broadcast(medians(df, pool, values)), list(pool))
    made = {
        f"{prefix}{n}": steady(
            clamp(_standard(_col(v), F.col(f"med_{n}"), F.col(f"sd_{n}")), -clip, clip)
        )
        for n, v in values.items()
    }
    return _attach(df, stats, pool, made)


def mean_z(df: DataFrame, pool: Sequence[str], values: Mapping[str, str | Column], prefix: str = "mz_") -> DataFrame:
    """Mean-centred, unclipped z-scores."""
    stats = moments(df, pool, values, "mean", "sd")
    made = {
        f"{prefix}{n}": steady(_standard(_col(v), F.col(f"mean_{n}"), F.col(f"sd_{n}"))) for n, v in values.items()
    }
    return _attach(df, stats, pool, made)


def linear_100(
    df: DataFrame, pool: Sequence[str], values: Mapping[str, str | Column], spread: float = 15.0
) -> DataFrame:
    """50 + spread * z held inside 0..100, one output column per entry."""
    stats = moments(df, pool, values, "mean", "sd")
    made = {
        n: steady(
            clamp(F.lit(50.0) + _standard(_col(v), F.col(f"mean_{n}"), F.col(f"sd_{n}")) * F.lit(float(spread)), 0, 100)
        )
        for n, v in values.items()
    }
    return _attach(df, stats, pool, made)


def min_max(
    df: DataFrame, pool: Sequence[str], values: Mapping[str, str | Column], constant: float = 0.0
) -> DataFrame:
    """Scale to 0..1 inside the pool; a constant pool gets ``constant``."""
    stats = moments(df, pool, values, "min", "max")
    made = {
        n: F.when(F.col(f"max_{n}") <= F.col(f"min_{n}"), float(constant)).otherwise(
            (_col(v) - F.col(f"min_{n}")) / (F.col(f"max_{n}") - F.col(f"min_{n}"))
        )
        for n, v in values.items()
    }
    return _attach(df, stats, pool, made)


def residuals(df: DataFrame, pool: Sequence[str], fits: Mapping[str, tuple[str | Column, str | Column]]) -> DataFrame:
    """y minus the in-pool straight-line fit on x; a constant x leaves y minus its mean."""
    cells = []
    made = {}
    for out, (y, x) in fits.items():
        y, x = _col(y), _col(x)
        cells += [
            F.regr_slope(y, x).alias(f"slope_{out}"),
            F.regr_intercept(y, x).alias(f"icpt_{out}"),
            F.var_pop(x).alias(f"var_{out}"),
            F.avg(y).alias(f"ybar_{out}"),
        ]
        made[out] = steady(
            F.when(F.coalesce(F.col(f"var_{out}"), F.lit(0.0)) == 0, y - F.col(f"ybar_{out}")).otherwise(
                y - (F.col(f"icpt_{out}") + F.col(f"slope_{out}") * x)
            )
        )
    return _attach(df, df.groupBy(*pool).agg(*cells), pool, made)


def pool_means(df: DataFrame, pool: Sequence[str], values: Mapping[str, str | Column]) -> DataFrame:
    """Add the pool mean of each entry as a column."""
    stats = moments(df, pool, values, "mean")
    return _attach(df, stats, pool, {n: F.col(f"mean_{n}") for n in values})


def population_z(df: DataFrame, pool: Sequence[str], values: Mapping[str, str | Column]) -> DataFrame:
    """Mean-centred scores over the population deviation, the scaling of the cluster features."""
    stats = moments(df, pool, values, "mean", "sdp")
    made = {n: steady(_standard(_col(v), F.col(f"mean_{n}"), F.col(f"sdp_{n}"))) for n, v in values.items()}
    return _attach(df, stats, pool, made)
