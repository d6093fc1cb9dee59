"""Shared frames of the queries and the shared SQL of their counterparts."""

from __future__ import annotations

import re

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.identity import outfield
from ..operators.measures import with_feed_values, with_measures, with_minutes_share, with_products
from ..operators.pools import eligible
from ..session import settle
from ..sources.tables import part_sheet

PLACES = 6
SHIFT = 1e-10
"""Added before rounding for output, so that half-way cases round alike in both engines."""


def sheet(spark: SparkSession, folder: str) -> DataFrame:
    """The sheet written once, so the order lines are scanned a single time per job."""
    return settle(part_sheet(spark, folder), "sheet")


def measures_of(people: DataFrame) -> DataFrame:
    return with_products(with_feed_values(with_measures(with_minutes_share(people))))


def measured(spark: SparkSession, folder: str) -> DataFrame:
    return measures_of(sheet(spark, folder))


def measured_columns(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The named columns of `measured`, written alone: the sheet is not written, so nothing else is worked out."""
    return settle(measures_of(part_sheet(spark, folder)).select(*columns), "people")


def pool(spark: SparkSession, folder: str) -> DataFrame:
    """Eligible rows of every family with measures, products and feed values."""
    return eligible(outfield(measured(spark, folder)))


def tidy(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, doubles rounded for output."""
    types = dict(df.dtypes)
    names = columns or df.columns
    return df.select(
        *[F.round(F.col(c) + SHIFT, PLACES).alias(c) if types[c] == "double" else F.col(c) for c in names]
    )


# ------------------------------------------------------------------------------------- SQL side


def r(expr: str, alias: str | None = None) -> str:
    out = f"CASE WHEN abs({expr}) < 4e-7 THEN 0e0 ELSE round({expr} + 1e-10, {PLACES}) END"
    return f"{out} AS {alias}" if alias else f"({out})"


def rounded(names: Sequence[str] | str) -> str:
    """Select items that round the named double columns."""
    if isinstance(names, str):
        names = names.split()
    return ", ".join(r(n, n) for n in names)


def p90(expr: str, name: str) -> str:
    return f"CASE WHEN minutes <> 0 THEN ({expr}) * 90e0 / minutes ELSE 0e0 END AS {name}"


def pct(part: str, whole: str, name: str) -> str:
    return f"CASE WHEN ({whole}) <> 0 THEN ({part}) * 100e0 / ({whole}) ELSE 0e0 END AS {name}"


TALLY_CELLS = """
count(*) AS n,
CAST(sum(CASE WHEN l_linestatus <> 'O' THEN l_quantity ELSE 0 END) AS BIGINT) AS minutes,
count(*) FILTER (l_linestatus = 'O') AS o,
count(*) FILTER (l_linestatus = 'O' AND l_returnflag <> 'R') AS ow,
count(*) FILTER (l_returnflag = 'R') AS r,
count(*) FILTER (l_linestatus <> 'O' AND l_returnflag = 'R') AS fr,
count(*) FILTER (l_returnflag = 'A') AS a,
count(*) FILTER (l_returnflag = 'A' AND l_linestatus <> 'O') AS af,
count(*) FILTER (l_returnflag = 'A' AND l_discount > 0.055) AS ad,
count(*) FILTER (l_discount > 0.055) AS d,
count(*) FILTER (l_tax > 0.045) AS t,
count(*) FILTER (l_tax < 0.005) AS z,
count(*) FILTER (l_quantity >= 26) AS q,
""" + ",\n".join(
    f"count(*) FILTER (l_linenumber = {i}) AS k{i}, "
    f"count(*) FILTER (l_linenumber = {i} AND l_returnflag <> 'R') AS w{i}"
    for i in range(1, 8)
)

SHEET_CELLS = ",\n".join(
    [
        "CAST(ad AS DOUBLE) AS goals",
        "CAST(w4 AS DOUBLE) AS assists",
        "k5 * 0.125e0 AS xa",
        p90("n", "passes"),
        p90("k1 + k2", "passes_prog"),
        p90("k3", "passes_long"),
        p90("k2 + k4", "passes_final"),
        p90("k5", "passes_key"),
        p90("k6", "passes_deep"),
        p90("k1 + k3 + k5", "passes_fwd"),
        p90("k7", "passes_smart"),
        p90("k4 + k5", "passes_box"),
        p90("k6 + k7", "passes_lat"),
        p90("n - o", "passes_recv"),
        p90("d", "passes_long_recv"),
        p90("t", "passes_deep_recv"),
        p90("k7 + k3", "crosses"),
        pct("n - r", "n", "passes_pct"),
        pct("w1 + w2", "k1 + k2", "passes_prog_pct"),
        pct("w3", "k3", "passes_long_pct"),
        pct("w2 + w4", "k2 + k4", "passes_final_pct"),
        pct("w6", "k6", "passes_deep_pct"),
        pct("w4 + w5", "k4 + k5", "passes_box_pct"),
        pct("w7 + w3", "k7 + k3", "crosses_pct"),
        p90("o", "duels_def"),
        p90("k5 + k6", "duels_air"),
        p90("q", "interceptions_raw"),
        p90("r", "clearances_raw"),
        p90("n - r", "def_actions"),
        p90("fr", "shots_blocked"),
        p90("z", "fouls"),
        pct("ow", "o", "duels_def_pct"),
        pct("w5 + w6", "k5 + k6", "duels_air_pct"),
        p90("k1 + k7 + d", "duels_off"),
        p90("k1", "dribbles"),
        p90("k2", "accels"),
        p90("k2 + t", "runs_prog"),
        p90("a", "shots"),
        p90("a + k7", "touches_box"),
        p90("z + k3", "fouls_won"),
        p90("ad", "goals90"),
        "CASE WHEN minutes <> 0 THEN k4 * 90e0 / minutes * 0.25e0 ELSE 0e0 END AS xg90",
        p90("w1 + w7", "att_actions"),
        pct("w1 + w7", "k1 + k7 + d", "duels_off_pct"),
        pct("w1", "k1", "dribbles_pct"),
        pct("af", "a", "shots_pct"),
        p90("k2 + w7", "interception_won_p90"),
        p90("r + k6", "total_clearance_p90"),
        p90("fr + w6", "outfielder_block_p90"),
        p90("w3", "ball_recovery_p90"),
    ]
)

CODE_SQL = """CASE WHEN p_size = 50 THEN 'GK' WHEN p_size = 49 THEN 'XX'
 WHEN p_type = 'ECONOMY' THEN CASE WHEN p_size <= 24 THEN 'RCB, RB' ELSE 'CB' END
 WHEN p_type = 'MEDIUM' THEN CASE WHEN p_size <= 24 THEN 'RB' ELSE 'LWB, LB' END
 WHEN p_type = 'PROMO' THEN CASE WHEN p_size <= 24 THEN 'DMF' ELSE 'LCMF' END
 WHEN p_type = 'LARGE' THEN CASE WHEN p_size <= 24 THEN 'RW' ELSE 'LWF, LW' END
 WHEN p_type = 'STANDARD' THEN CASE WHEN p_size <= 24 THEN 'AMF' ELSE 'RAMF' END
 ELSE 'CF' END"""

FAMILY_SQL = """CASE WHEN p_size >= 49 THEN NULL WHEN p_type = 'ECONOMY' THEN 'zagueiros'
 WHEN p_type = 'MEDIUM' THEN 'laterais' WHEN p_type = 'PROMO' THEN 'meio-campistas'
 WHEN p_type = 'LARGE' THEN 'extremos' WHEN p_type = 'STANDARD' THEN 'meias-ofensivos' ELSE 'atacantes' END"""

POSITION_SQL = """CASE WHEN p_size = 50 THEN 'Goleiro' WHEN p_size = 49 THEN NULL
 WHEN p_type = 'ECONOMY' THEN 'Zagueiro'
 WHEN p_type = 'MEDIUM' THEN CASE WHEN p_size <= 24 THEN 'Lateral Direito' ELSE 'Lateral Esquerdo' END
 WHEN p_type = 'PROMO' THEN 'Meio-campista'
 WHEN p_type = 'LARGE' THEN CASE WHEN p_size <= 24 THEN 'Extremo Direito' ELSE 'Extremo Esquerdo' END
 WHEN p_type = 'STANDARD' THEN 'Meia Ofensivo' ELSE 'Atacante' END"""

PEOPLE_SQL = f"""p_name AS name, p_brand AS club, {CODE_SQL} AS position_raw,
 {POSITION_SQL} AS position, {FAMILY_SQL} AS family,
 'NATION_' || (p_size % 25) AS nationality,
 CASE WHEN p_size <= 20 THEN 'direito' WHEN p_size <= 38 THEN 'esquerdo' WHEN p_size <= 44 THEN 'both'
      WHEN p_size <= 47 THEN 'ambos os pes' END AS foot_raw,
 CASE WHEN p_size <= 20 THEN 'Destro' WHEN p_size <= 38 THEN 'Canhoto' WHEN p_size <= 44 THEN 'Ambidestro'
      WHEN p_size <= 47 THEN 'Ambos Os Pes' END AS foot,
 17 + p_size % 23 AS age, 2026 - (17 + p_size % 23) AS birth_year,
 CASE WHEN p_size <= 3 THEN 0 ELSE 150 + p_size END AS height,
 p_name || ' (' || p_brand || ')' AS label,
 trim(regexp_replace(lower(p_name || '-' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') || '-' || p_partkey AS player_id"""

MEASURES_SQL = """
 runs_prog - accels AS carry_prog,
 duels_def_pct / 100e0 AS duels_def_rate, duels_air_pct / 100e0 AS duels_air_rate,
 duels_off - dribbles AS duels_off_net,
 CASE WHEN duels_off <> 0 THEN (duels_off * (duels_off_pct / 100e0) - dribbles) / duels_off ELSE 0e0 END AS duels_off_rate,
 passes_prog_pct / 100e0 AS prog_rate, passes_long_pct / 100e0 AS long_rate, passes_final_pct / 100e0 AS final_rate,
 duels_def * (100e0 - duels_def_pct) * -1e0 AS lost_load,
 passes_prog * (passes_prog_pct / 100e0) AS prog_done,
 passes_long * (passes_long_pct / 100e0) AS long_done,
 passes_final * (passes_final_pct / 100e0) AS final_done,
 CASE WHEN passes <> 0 THEN passes_prog / passes ELSE 0e0 END AS prog_share,
 CASE WHEN passes <> 0 THEN passes_long / passes ELSE 0e0 END AS long_share,
 CASE WHEN passes <> 0 THEN passes_final / passes ELSE 0e0 END AS final_share,
 crosses_pct / 100e0 AS cross_rate, passes_deep_pct / 100e0 AS deep_rate, passes_deep_recv AS deep_recv,
 passes_box * (passes_box_pct / 100e0) AS box_done,
 passes_smart AS passes_creative, passes_key AS passes_danger, passes_pct / 100e0 AS pass_rate,
 dribbles_pct / 100e0 AS dribble_rate, touches_box AS att_touches, passes_recv AS recv, passes_long_recv AS long_recv,
 xg90 AS npxg, goals90 - xg90 AS goals_over_xg, goals90 / greatest(touches_box, 0.1e0) AS goals_per_touch,
 shots_pct / 100e0 AS finish_rate, passes * (passes_pct / 100e0) AS passes_done
"""

BASE_SQL = f"""
tally AS (SELECT l_partkey, {TALLY_CELLS} FROM lineitem GROUP BY l_partkey),
people AS (SELECT p_partkey, {PEOPLE_SQL} FROM part),
filled AS (SELECT people.*, {", ".join(f"coalesce({c}, 0) AS {c}" for c in
    ["n", "minutes", "o", "ow", "r", "fr", "a", "af", "ad", "d", "t", "z", "q"]
    + [f"{k}{i}" for i in range(1, 8) for k in "kw"])}
  FROM people LEFT JOIN tally ON p_partkey = l_partkey),
sheet AS (SELECT p_partkey, name, club, position_raw, position, family, nationality, foot_raw, foot, age, birth_year,
  height, label, player_id, CAST(minutes AS INTEGER) AS minutes, {SHEET_CELLS} FROM filled),
meas0 AS (SELECT *, minutes / CAST((SELECT max(minutes) FROM sheet) AS DOUBLE) AS minutes_share, {MEASURES_SQL} FROM sheet),
meas1 AS (SELECT *,
  CASE WHEN lost_load <> 0 THEN (duels_def * duels_def_rate + clearances_raw) / lost_load ELSE 0e0 END AS duel_efficiency_sheet,
  CASE WHEN lost_load <> 0 THEN def_actions / lost_load ELSE 0e0 END AS reading_index,
  interception_won_p90 AS interceptions, total_clearance_p90 AS clearances,
  CASE WHEN lost_load <> 0 THEN (duels_def * duels_def_rate + total_clearance_p90) / lost_load ELSE 0e0 END AS duel_efficiency
  FROM meas0),
meas AS (SELECT *, crosses * cross_rate AS crosses_done, duels_off_net * duels_off_rate AS duels_off_done,
  dribbles * dribble_rate AS dribbles_done, shots * finish_rate AS shots_done,
  duels_def * duels_def_rate AS duels_def_done, duels_air * duels_air_rate AS duels_air_done FROM meas1),
pool AS (SELECT * FROM meas WHERE family IS NOT NULL AND position <> 'Goleiro' AND minutes_share > 0.2e0)
"""


def with_base(*ctes: str, select: str, once: bool = False) -> str:
    """The shared tables, further ones and the select; ``once`` keeps each table that is read several times."""
    tables = ", ".join([BASE_SQL.strip(), *ctes])
    if once:
        tables = re.sub(r"(\w+) AS \((?=\s*SELECT)", r"\1 AS MATERIALIZED (", tables)
    return f"WITH {tables} {select}"


def dense_pct(value: str, by: str = "family") -> str:
    """Dense percentile as SQL; needs the columns dr_<x> and so on inline."""
    return (
        f"(CASE WHEN max(dr_{value}) OVER (PARTITION BY {by}) <= 1 THEN 100e0 ELSE "
        f"(dr_{value} - 1) / CAST(max(dr_{value}) OVER (PARTITION BY {by}) - 1 AS DOUBLE) * 100e0 END)"
    )


def pct_ctes(source: str, target: str, columns: dict[str, str], by: str = "family") -> str:
    """Two CTEs that add dense percentiles: output name -> value expression."""
    ranks = ", ".join(
        f"dense_rank() OVER (PARTITION BY {by} ORDER BY {expr}) AS dr_{name}" for name, expr in columns.items()
    )
    cells = ", ".join(f"{dense_pct(name, by)} AS {name}" for name in columns)
    drop = ", ".join(f"dr_{name}" for name in columns)
    return (
        f"{target}_r AS (SELECT *, {ranks} FROM {source}), "
        f"{target} AS (SELECT * EXCLUDE ({drop}), {cells} FROM {target}_r)"
    )


def z_med(expr: str, by: str = "family") -> str:
    """Median-centred clipped z."""
    sd = f"stddev_samp({expr}) OVER (PARTITION BY {by})"
    med = f"median({expr}) OVER (PARTITION BY {by})"
    return (
        f"round(CASE WHEN coalesce({sd}, 0) = 0 THEN 0e0 ELSE "
        f"greatest(-2e0, least(2e0, ({expr} - {med}) / {sd})) END, 9)"
    )


def z_mean(expr: str, by: str = "family") -> str:
    sd = f"stddev_samp({expr}) OVER (PARTITION BY {by})"
    mean = f"avg({expr}) OVER (PARTITION BY {by})"
    return f"round(CASE WHEN coalesce({sd}, 0) = 0 THEN 0e0 ELSE ({expr} - {mean}) / {sd} END, 9)"


def resid(y: str, x: str, by: str = "family") -> str:
    w = f"OVER (PARTITION BY {by})"
    return (
        f"round(CASE WHEN coalesce(var_pop({x}) {w}, 0) = 0 THEN {y} - avg({y}) {w} ELSE {y} - (regr_intercept({y}, {x}) {w}"
        f" + regr_slope({y}, {x}) {w} * {x}) END, 9)"
    )


def lin100(expr: str, spread: str = "15e0", by: str = "family") -> str:
    sd = f"stddev_samp({expr}) OVER (PARTITION BY {by})"
    mean = f"avg({expr}) OVER (PARTITION BY {by})"
    return (
        f"round(greatest(0e0, least(100e0, 50e0 + (CASE WHEN coalesce({sd}, 0) = 0 THEN 0e0 "
        f"ELSE ({expr} - {mean}) / {sd} END) * {spread})), 9)"
    )
