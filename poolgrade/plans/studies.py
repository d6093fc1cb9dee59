"""Regression studies: fits on past seasons, scores of a target pool."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import attempts, clamp, guarded, row_mean_present, steady
from ..operators.measures import adjusted_cost, successful_actions, with_measures
from ..operators.ranks import rank_columns
from ..session import settle

C = F.col
FAMILY = ["family"]
IMPACT_METRICS = config.STUDY_METRICS[:4]
DEFENCE = config.STUDY_METRICS[4]


def season_shares(df: DataFrame, *keys: str, whole: DataFrame | None = None) -> DataFrame:
    """Minutes share inside each season file; ``whole`` holds the minutes of all its rows if ``df`` has only some."""
    most = (df if whole is None else whole).groupBy(*keys).agg(F.max("minutes").alias("_most"))
    return df.join(F.broadcast(most), list(keys)).withColumn(
        "minutes_share", guarded(C("minutes").cast("double"), C("_most").cast("double"))
    ).drop("_most")


def study_columns(df: DataFrame) -> DataFrame:
    """Volumes, efficiencies and impacts of the five study metrics."""
    df = with_measures(df) if "prog_done" not in df.columns else df
    out = df.withColumn("acoes_def", successful_actions())
    return out.withColumns(
        {
            "custo_def": adjusted_cost(C("acoes_def")),
            "inter_clear_p90": C("interception_won_p90") + C("total_clearance_p90"),
            "duels_def_impact": C("duels_def") * C("duels_def_pct") / F.lit(100.0),
            "duels_air_impact": C("duels_air") * C("duels_air_pct") / F.lit(100.0),
            "passes_prog_impact": C("prog_done"),
            "passes_long_impact": C("long_done"),
        }
    )


def refill_empty(df: DataFrame, pool: Sequence[str], column: str, replacement: Column) -> DataFrame:
    """Use ``replacement`` where a whole column of the pool is 0."""
    used = df.groupBy(*pool).agg((F.max(F.abs(C(column))) > 0).alias("_used"))
    return df.join(F.broadcast(used), list(pool)).withColumn(
        column, F.when(C("_used"), C(column)).otherwise(replacement)
    ).drop("_used")


def quadratic_fits(
    df: DataFrame, pool: Sequence[str], fits: Mapping[str, tuple[Column, Column]]
) -> DataFrame:
    """Least squares of y on 1, v, v*v for every entry (v, y), one row of coefficients per pool.

    Volumes are standardised first, then one pass of sums gives the normal equations. With fewer
    than three distinct volumes the curve is the straight line through them, or the mean.
    """
    pool = list(pool)
    first = df.groupBy(*pool).agg(
        *[c for n, (v, _) in fits.items() for c in (F.avg(v).alias(f"m_{n}"), F.stddev_pop(v).alias(f"s_{n}"))]
    )
    cells = []
    for n, (v, y) in fits.items():
        u = F.when(C(f"s_{n}") > 0, (v - C(f"m_{n}")) / C(f"s_{n}")).otherwise(0.0)
        for p in (1, 2, 3, 4):
            cells.append(F.sum(_power(u, p)).alias(f"u{p}_{n}"))
        cells += [F.sum(y).alias(f"y0_{n}"), F.sum(u * y).alias(f"y1_{n}"), F.sum(u * u * y).alias(f"y2_{n}")]
        cells += [F.first(f"m_{n}").alias(f"m_{n}"), F.first(f"s_{n}").alias(f"s_{n}")]
    sums = df.join(F.broadcast(first), pool).groupBy(*pool).agg(F.count(F.lit(1)).alias("fit_rows"), *cells)
    out = {}
    for n in fits:
        count = C("fit_rows").cast("double")
        u1, u2, u3, u4 = (C(f"u{p}_{n}") for p in (1, 2, 3, 4))
        y0, y1, y2 = (C(f"y{p}_{n}") for p in (0, 1, 2))
        matrix = ((count, u1, u2), (u1, u2, u3), (u2, u3, u4))
        det = _det(matrix)
        solved = [_det(_swap(matrix, i, (y0, y1, y2))) / det for i in range(3)]
        curved = F.abs(det) > F.pow(count, F.lit(3.0)) * 1e-10
        line = F.when(u2 > 0, y1 / u2).otherwise(0.0)
        c0 = F.when(curved, solved[0]).otherwise(y0 / count)
        c1 = F.when(curved, solved[1]).otherwise(line)
        c2 = F.when(curved, solved[2]).otherwise(0.0)
        mean, sd = C(f"m_{n}"), F.when(C(f"s_{n}") > 0, C(f"s_{n}")).otherwise(1.0)
        out[f"b0_{n}"] = c0 - c1 * mean / sd + c2 * mean * mean / (sd * sd)
        out[f"b1_{n}"] = c1 / sd - F.lit(2.0) * c2 * mean / (sd * sd)
        out[f"b2_{n}"] = c2 / (sd * sd)
    return sums.select(*pool, "fit_rows", *[e.alias(k) for k, e in out.items()])


def _power(value: Column, exponent: int) -> Column:
    out = value
    for _ in range(exponent - 1):
        out = out * value
    return out


def _det(m) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def _swap(m, column: int, values):
    return tuple(tuple(values[r] if j == column else m[r][j] for j in range(3)) for r in range(3))


def expected(name: str, volume: Column) -> Column:
    return C(f"b0_{name}") + C(f"b1_{name}") * volume + C(f"b2_{name}") * volume * volume


def with_fits(df: DataFrame, coefficients: DataFrame, pool: Sequence[str]) -> DataFrame:
    """Coefficients (one row per pool) brought to the rows of another pool set."""
    return df.join(F.broadcast(coefficients.drop("fit_rows")), list(pool))


def fit_quality(
    df: DataFrame, coefficients: DataFrame, pool: Sequence[str], fits: Mapping[str, tuple[Column, Column]]
) -> DataFrame:
    """R squared of each fit on its own rows; 0 for a constant target."""
    scored = with_fits(df, coefficients, pool)
    cells = []
    for n, (v, y) in fits.items():
        spread = F.var_pop(y)
        cells.append(
            F.when(spread > 0, F.lit(1.0) - F.var_pop(y - expected(n, v)) / spread).otherwise(0.0).alias(f"r2_{n}")
        )
    return scored.groupBy(*pool).agg(*cells)


def efficiency_of(metric: config.StudyMetric) -> Column:
    return -C(metric.efficiency) if metric.negate else C(metric.efficiency)


def efficiency_fits(metrics=config.STUDY_METRICS) -> dict[str, tuple[Column, Column]]:
    return {m.key: (C(m.volume), efficiency_of(m)) for m in metrics}


def impact_fits() -> dict[str, tuple[Column, Column]]:
    return {m.key: (C(m.volume), C(m.impact)) for m in IMPACT_METRICS}


def confidence(metric: config.StudyMetric) -> Column:
    return clamp(attempts(C(metric.volume), C("minutes")) / F.lit(metric.full_confidence), 0, 1)


def efficiency_scores(target: DataFrame, history: DataFrame, pool: Sequence[str] = FAMILY) -> DataFrame:
    """70 % capped efficiency residual (weighted by confidence), 30 % impact, per metric.

    Adds ``raw_<m>`` and ``res_<m>`` residuals, ``a_<m>``, ``b_<m>`` and ``score_<m>``.
    """
    fits = quadratic_fits(history, pool, efficiency_fits())
    scored = with_fits(target, fits, pool)
    for m in config.STUDY_METRICS:
        raw = steady(efficiency_of(m) - expected(m.key, C(m.volume)))
        scored = scored.withColumn(f"raw_{m.key}", raw).withColumn(
            f"res_{m.key}", clamp(C(f"raw_{m.key}"), -m.cap, m.cap)
        )
    scored = settle(scored, "residuals")
    wanted = {f"pa_{m.key}": (f"res_{m.key}", "mean") for m in config.STUDY_METRICS}
    wanted |= {f"b_{m.key}": (m.impact, "mean") for m in config.STUDY_METRICS}
    ranked = rank_columns(scored, pool, "player_id", wanted)
    for m in config.STUDY_METRICS:
        a = F.lit(50.0) + confidence(m) * (C(f"pa_{m.key}") - F.lit(50.0))
        ranked = ranked.withColumn(f"a_{m.key}", a).withColumn(
            f"score_{m.key}", F.lit(0.7) * C(f"a_{m.key}") + F.lit(0.3) * C(f"b_{m.key}")
        )
    return ranked


def axis_scores(target: DataFrame, history: DataFrame, pool: Sequence[str] = FAMILY) -> DataFrame:
    """Five axis scores: half impact residual and half impact, and 60/40 cost and actions."""
    fits = quadratic_fits(history, pool, impact_fits())
    scored = with_fits(target, fits, pool)
    scored = scored.withColumns(
        {f"res_{m.key}": steady(C(m.impact) - expected(m.key, C(m.volume))) for m in IMPACT_METRICS}
    )
    scored = settle(scored, "axis-residuals")
    wanted = {f"pr_{m.key}": (f"res_{m.key}", "mean") for m in IMPACT_METRICS}
    wanted |= {f"pi_{m.key}": (m.impact, "mean") for m in IMPACT_METRICS}
    wanted |= {"p_cost": ("custo_def", "mean"), "p_actions": ("acoes_def", "mean")}
    ranked = rank_columns(scored, pool, "player_id", wanted)
    out = {}
    for m in IMPACT_METRICS:
        residual = F.lit(50.0) + confidence(m) * (C(f"pr_{m.key}") - F.lit(50.0))
        out[f"axis_{m.key}"] = F.lit(0.5) * residual + F.lit(0.5) * C(f"pi_{m.key}")
    out["axis_eficiencia_def"] = F.lit(0.6) * (F.lit(100.0) - C("p_cost")) + F.lit(0.4) * C("p_actions")
    return ranked.withColumns(out).drop(*wanted, *[f"res_{m.key}" for m in IMPACT_METRICS])


def composite(scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of the present axis scores, pulled to 50 by missing minutes."""
    from .common import shrink

    mean = row_mean_present([C(c) for c in columns])
    return scores.withColumn("rating_mean", mean).withColumn(
        "rating_final", steady(shrink(C("rating_mean"), C("minutes_share"), config.AXIS_MU))
    )
