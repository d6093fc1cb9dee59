"""Exact ranks, percentiles and quantiles inside pools of any size.

A pool (one position family, say) may hold a third of the data, so a window partitioned by the
pool would put that third into one task. The rank of a value depends only on how many rows lie
below it, which splits well:

1. count rows per distinct value (combined map-side, so a value shared by a billion rows is one
   record);
2. cut every pool into value buckets. The cut points are a hash-chosen sample of its distinct
   values, so a re-run of a lost task finds the same cuts;
3. run the cumulative window inside each bucket and add the totals of the buckets before it;
4. bring the result back to the rows. Columns of few distinct values, and values that hold a large share
   of a pool, travel as a broadcast, all others through a shuffled join.

The distinct values are written once, and counted with their pools while they are written. The counts
set the number of cuts, which values are frequent and which columns are looked up in a broadcast; the ranks
come from the same plan at every size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settle, settle_measured

BUCKET_VALUES = 250_000
"""Values that a bucket should hold; the number of cuts follows from the observed count."""

LEAST_CUTS = 7

FREQUENT = 10_000
"""A value is frequent when it holds more than 1/10,000 of all values, so at most 10,000 are."""

BROADCAST_ROWS = 1_000_000
"""Rank, cut and offset tables up to this size, known from the observed counts, are broadcast; larger ones are joined."""


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if the known bound on its rows allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass(frozen=True)
class Counts:
    """Numbers of rows with a value, of distinct values and (an upper bound) of pools."""

    rows: int
    values: int
    pools: int


def counted_values(rows: DataFrame, keys: Sequence[str], name: str, value: str = "value") -> tuple[DataFrame, Counts]:
    """(keys, value, cnt): the distinct values with their numbers of rows, written once and counted. Null values are left out."""
    distinct = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))
    seen = {"rows": F.sum("cnt"), "values": F.count(F.lit(1)), "pools": F.approx_count_distinct(F.struct(*keys))}
    out, found = settle_measured(distinct, name, seen)
    return out, Counts(found["rows"] or 0, found["values"], 2 * found["pools"] + 1)


def value_ranks(distinct: DataFrame, keys: Sequence[str], counts: Counts, value: str = "value") -> DataFrame:
    """One row per (keys, distinct value) with its position in the pool, from `counted_values`.

    Columns: ``cnt`` rows with the value, ``below`` rows strictly below, ``upto`` rows at or
    below, ``dense`` 1-based dense rank, ``n`` rows and ``n_dense`` distinct values of the pool.
    ``keys`` must come from a small dimension (families, metrics).
    """
    keys = list(keys)
    pools = counts.pools
    cuts_wanted = max(LEAST_CUTS, (1 << (counts.values // BUCKET_VALUES).bit_length()) - 1)
    cuts = (
        distinct.groupBy(*keys, F.pmod(F.xxhash64(value), F.lit(cuts_wanted)).alias("_slot"))
        .agg(F.min_by(value, F.xxhash64(F.lit("cut"), F.col(value))).alias("_cut"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("_cut")).alias("_cuts"))
    )
    bucketed = _locate(distinct.join(small(cuts, pools * cuts_wanted), keys), value, cuts_wanted).select(*keys, value, "cnt", "_bucket")
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    pool = Window.partitionBy(*keys)
    offsets = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(F.sum("cnt").alias("_rows"), F.count(F.lit(1)).alias("_values"))
        .select(
            *keys,
            "_bucket",
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows0"),
            F.coalesce(F.sum("_values").over(before), F.lit(0)).alias("_values0"),
            F.sum("_rows").over(pool).alias("n"),
            F.sum("_values").over(pool).alias("n_dense"),
        )
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        bucketed.withColumn("_run", F.sum("cnt").over(running))
        .withColumn("_nth", F.row_number().over(inside))
        .join(small(offsets, pools * (cuts_wanted + 1)), [*keys, "_bucket"])
        .select(
            *keys,
            value,
            "cnt",
            (F.col("_rows0") + F.col("_run") - F.col("cnt")).alias("below"),
            (F.col("_rows0") + F.col("_run")).alias("upto"),
            (F.col("_values0") + F.col("_nth")).cast("bigint").alias("dense"),
            "n",
            "n_dense",
        )
    )


def _locate(df: DataFrame, value: str, most: int) -> DataFrame:
    """Add ``_bucket``, the number of cut points below the value.

    A binary search over the sorted array, one projection per step, so it stays in generated code.
    """
    df = df.withColumn("_bucket", F.lit(0))
    for step in range((most + 1).bit_length() - 2, -1, -1):
        probe = F.get(F.col("_cuts"), F.col("_bucket") + (2**step - 1))
        df = df.withColumn("_bucket", F.col("_bucket") + F.when(probe < F.col(value), 2**step).otherwise(0))
    return df


def attach_ranks(
    rows: DataFrame, ranks: DataFrame, keys: Sequence[str], value: str, spread: str, payload: Mapping[str, Column], counts: Counts
) -> DataFrame:
    """Join rank columns back to the rows on (keys, value).

    A table of few values is broadcast whole, so the rows stay where they are. Of a larger one the frequent values travel as
    a broadcast of at most ``FREQUENT`` rows; any other is less than that fraction of the join's rows.

    ``payload`` names the columns to bring, as expressions over the rank table. ``spread`` is a
    column with many values (an id) that scatters the rows already served by the hot broadcast.
    """
    keys = list(keys)
    if counts.values <= BROADCAST_ROWS:
        told = ranks.select(*keys, value, *[expr.alias(f"_r_{name}") for name, expr in payload.items()])
        found = rows.join(F.broadcast(told), [*keys, value], "left")
        return found.select(*[F.col(c) for c in rows.columns], *[F.col(f"_r_{name}").alias(name) for name in payload])
    hot = F.col("cnt") * FREQUENT > max(counts.rows, FREQUENT)
    bundle = F.struct(*[expr.alias(name) for name, expr in payload.items()])
    frequent = ranks.where(hot).select(*keys, value, bundle.alias("_hot"))
    others = ranks.where(~hot).select(
        *keys, F.col(value).alias("_seek"), F.lit(0).cast("bigint").alias("_lane"), bundle.alias("_cold")
    )
    served = F.col("_hot").isNotNull()
    joined = (
        rows.join(F.broadcast(frequent), [*keys, value], "left")
        .withColumn("_seek", F.when(~served, F.col(value)))
        .withColumn(
            "_lane",
            F.when(served | F.col(value).isNull(), F.pmod(F.xxhash64(spread), F.lit(1 << 20)) + 1).otherwise(F.lit(0)),
        )
        .join(others, [*keys, "_seek", "_lane"], "left")
    )
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return joined.select(
        *[F.col(c) for c in rows.columns], *[found[name].alias(name) for name in payload]
    )


# Percentile and rank definitions, as expressions over the rank table.


def dense_percentile() -> Column:
    """0..100 by dense rank; a constant pool gives 100."""
    return F.when(F.col("n_dense") <= 1, F.lit(100.0)).otherwise(
        (F.col("dense") - 1) / (F.col("n_dense") - 1) * F.lit(100.0)
    )


def reversed_percentile() -> Column:
    """Share of the way down by min-rank from the top, so the largest value gets 0."""
    top = F.col("n") - F.col("upto")
    last = F.col("n") - F.col("lowest_upto")
    return F.when(last < 1, F.lit(100.0)).otherwise(top / last * F.lit(100.0))


def normalised_rank() -> Column:
    """100 for the best, 0 for the last place of a pool without ties."""
    return F.when(F.col("n") <= 1, F.lit(100.0)).otherwise(
        F.lit(100.0) * (F.col("n") - competition_rank()) / (F.col("n") - 1)
    )


def competition_rank() -> Column:
    """1 for the largest value; equal values share the place."""
    return (F.col("n") - F.col("upto") + 1).cast("bigint")


def mean_percentile_of_score() -> Column:
    """Average of the strict and the weak percentile."""
    return F.lit(50.0) * (F.col("below") + F.col("upto")) / F.col("n")


def average_rank_share() -> Column:
    """Average rank of the ties over the pool size."""
    return (F.col("below") + 1 + F.col("upto")) / F.lit(2.0) / F.col("n")


def cumulative_share() -> Column:
    return F.col("upto") / F.col("n")


def with_lowest(ranks: DataFrame, keys: Sequence[str], pools: int) -> DataFrame:
    """Add ``lowest_upto``: the rows holding the smallest value of the pool."""
    keys = list(keys)
    low = ranks.where(F.col("below") == 0).select(*keys, F.col("upto").alias("lowest_upto"))
    return ranks.join(small(low, pools), keys)


KINDS = {
    "dense": dense_percentile,
    "reversed": reversed_percentile,
    "normalised": normalised_rank,
    "rank": competition_rank,
    "mean": mean_percentile_of_score,
    "average": average_rank_share,
    "ecdf": cumulative_share,
}


def rank_columns(
    df: DataFrame, pool: Sequence[str], id_col: str, wanted: Mapping[str, tuple[str | Column, str]]
) -> DataFrame:
    """Add one column per entry of ``wanted``: output name -> (value, kind of rank).

    All columns are ranked together in long form, so twenty percentiles cost the same number of
    shuffles as one.
    """
    pool = list(pool)
    sources: dict[str, str | Column] = {}
    slot_of: dict[str, str] = {}
    for out, (value, _) in wanted.items():
        if isinstance(value, str):
            slot = next((s for s, e in sources.items() if isinstance(e, str) and e == value), out)
            sources.setdefault(slot, value)
            slot_of[out] = slot
        else:
            sources[out] = value
            slot_of[out] = out
    kinds = sorted({kind for _, kind in wanted.values()})
    number = {s: i for i, s in enumerate(sources)}

    def long(slots: Sequence[str], *ids: str) -> DataFrame:
        entries = [
            F.struct(F.lit(number[s]).alias("metric"), (F.col(e) if isinstance(e, str) else e).cast("double").alias("value"))
            for s, e in sources.items()
            if s in slots
        ]
        return df.select(*pool, *ids, F.explode(F.array(*entries)).alias("_e")).select(*pool, *ids, "_e.metric", "_e.value")

    keys = [*pool, "metric"]
    values, counts = counted_values(long(list(sources)), keys, "values")
    ranks = settle(value_ranks(values, keys, counts), "ranks")
    if "reversed" in kinds:
        ranks = with_lowest(ranks, keys, counts.pools)
    got = None
    for slots, part in _by_size(list(sources), values, counts):
        mine = ranks if len(slots) == len(sources) else ranks.where(F.col("metric").isin(*[number[s] for s in slots]))
        some = attach_ranks(long(slots, id_col), mine, keys, "value", id_col, {k: KINDS[k]() for k in kinds}, part)
        got = some if got is None else got.unionByName(some)
    cells = [
        F.max(F.when(F.col("metric") == number[slot_of[out]], F.col(kind))).alias(out) for out, (_, kind) in wanted.items()
    ]
    # values that were looked up leave a task as one row per id
    return df.join(got.groupBy(id_col).agg(*cells), id_col)


def _by_size(slots: Sequence[str], values: DataFrame, counts: Counts) -> list[tuple[list[str], Counts]]:
    """Columns whose distinct values are few enough together for one broadcast, and the others, with their counts."""
    if counts.values <= BROADCAST_ROWS or not BROADCAST_ROWS:
        return [(list(slots), counts)]
    found = values.groupBy("metric").agg(F.count(F.lit(1)).alias("values"), F.sum("cnt").alias("rows")).collect()
    told = {slots[r["metric"]]: r for r in found}
    few, total = [s for s in slots if s not in told], 0
    for slot in sorted(told, key=lambda s: told[s]["values"]):
        if total + told[slot]["values"] <= BROADCAST_ROWS:
            few.append(slot)
            total += told[slot]["values"]
    many = [s for s in slots if s not in few]
    rows = {k: sum(told[s]["rows"] for s in k if s in told) for k in (tuple(few), tuple(many))}
    parts = [(few, Counts(rows[tuple(few)], total, counts.pools)), (many, Counts(rows[tuple(many)], counts.values - total, counts.pools))]
    # a column of more values than a broadcast takes is joined, however few the others are
    return [(some, replace(part, values=max(part.values, BROADCAST_ROWS + 1)) if some is many else part) for some, part in parts if some]


def rank_settled(
    df: DataFrame, pool: Sequence[str], id_col: str, wanted: Mapping[str, tuple[str | Column, str]]
) -> DataFrame:
    """`rank_columns` followed by one write, for results that feed further pool statistics."""
    return settle(rank_columns(df, pool, id_col, wanted), "ranked")


def ordinal(df: DataFrame, pool: Sequence[str], order: Sequence[Column], id_col: str, out: str = "rank") -> DataFrame:
    """Sequential 1..n in the given order inside each pool; ``order`` must make rows distinct."""
    keys = list(pool) or ["_all"]
    keyed = df.select(
        *(pool or [F.lit(0).alias("_all")]), id_col, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("_o")
    )
    values, counts = counted_values(keyed, keys, "order", "_o")
    ranks = settle(value_ranks(values, keys, counts, "_o"), "ranks")
    got = attach_ranks(keyed, ranks, keys, "_o", id_col, {out: F.col("upto")}, counts).select(id_col, out)
    return df.join(got.withColumn(out, F.col(out).cast("bigint")), id_col)


def exact_quantiles(
    rows: DataFrame, keys: Sequence[str], points: Mapping[str, float], value: str = "value"
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per pool."""
    values, counts = counted_values(rows.select(*keys, value), keys, "values", value)
    return quantiles(value_ranks(values, keys, counts, value), keys, points, value)


def quantiles(ranks: DataFrame, keys: Sequence[str], points: Mapping[str, float], value: str = "value") -> DataFrame:
    """Exact quantiles with linear interpolation, one row per pool."""
    keys = list(keys)
    cells = []
    wanted = F.lit(False)
    for name, q in points.items():
        at = F.lit(float(q)) * (F.col("n") - 1)
        lo, hi = F.floor(at), F.ceil(at)
        has_lo = (F.col("below") <= lo) & (lo < F.col("upto"))
        has_hi = (F.col("below") <= hi) & (hi < F.col("upto"))
        wanted = wanted | has_lo | has_hi
        v_lo = F.max(F.when(has_lo, F.col(value)))
        v_hi = F.max(F.when(has_hi, F.col(value)))
        part = F.max(at - lo)
        cells.append((v_lo + (v_hi - v_lo) * part).alias(name))
    return ranks.where(wanted).groupBy(*keys).agg(*cells)
