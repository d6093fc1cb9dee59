"""Arithmetic shared by the jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(value: Column) -> Column:
    """A double; null, NaN and text that is no number become 0."""
    cast = value.try_cast("double")
    return F.when(cast.isNull() | F.isnan(cast), 0.0).otherwise(cast)


def guarded(numerator: Column, denominator: Column, otherwise: Column | float = 0.0) -> Column:
    """Quotient, or ``otherwise`` when the denominator is 0 or null."""
    fallback = otherwise if isinstance(otherwise, Column) else F.lit(float(otherwise))
    return F.when(F.coalesce(denominator, F.lit(0.0)) != 0, numerator / denominator).otherwise(fallback)


def per90(total: Column, minutes: Column) -> Column:
    return guarded(total * F.lit(90.0), minutes)


def attempts(per_90: Column, minutes: Column) -> Column:
    return per_90 * (minutes / F.lit(90.0))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def steady(value: Column) -> Column:
    """Nine decimals: sums differ in the last bits with task order, and ranks must not."""
    return F.round(value, 9)


def total(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out


def weighted(terms: Sequence[tuple[float, Column]]) -> Column:
    return total([F.lit(float(w)) * c for w, c in terms])


def row_mean(parts: Sequence[Column]) -> Column:
    return total(list(parts)) / F.lit(float(len(parts)))


def row_mean_present(parts: Sequence[Column]) -> Column:
    """Mean of the non-null values of a row."""
    present = total([p.isNotNull().cast("int") for p in parts])
    return total([F.coalesce(p, F.lit(0.0)) for p in parts]) / F.nullif(present, F.lit(0))


def row_median(parts: Sequence[Column]) -> Column:
    ordered = F.sort_array(F.array(*parts))
    mid = len(parts) // 2
    if len(parts) % 2:
        return F.get(ordered, mid)
    return (F.get(ordered, mid - 1) + F.get(ordered, mid)) / 2


def row_sd(parts: Sequence[Column]) -> Column:
    """Population standard deviation across the values of a row."""
    mean = row_mean(parts)
    return F.sqrt(row_mean([(p - mean) * (p - mean) for p in parts]))


def softmax_shares(scores: Sequence[Column]) -> list[Column]:
    """Percent shares of exp(score)."""
    peak = F.greatest(*scores)
    weights = [F.exp(s - peak) for s in scores]
    whole = total(weights)
    return [w / whole * F.lit(100.0) for w in weights]


def best_label(scores: Sequence[tuple[str, Column]]) -> Column:
    """Label of the largest score; the first listed wins a tie."""
    peak = F.greatest(*[s for _, s in scores])
    out = F.lit(scores[-1][0])
    for label, score in reversed(scores[:-1]):
        out = F.when(score == peak, F.lit(label)).otherwise(out)
    return out


def _slow_text(value: Column, places: int) -> Column:
    return F.replace(F.format_number(value, places), F.lit(","), F.lit(""))


def exact_text(value: Column, places: int, mark: str = ".") -> Column:
    """Fixed decimals, rounded half-even on the exact binary value, without grouping marks.

    Positive values are written from their scaled integer; the others, those near a tie and very large ones are formatted.
    """
    slow = _slow_text(value, places)
    scaled = value * F.lit(10.0**places)
    clear = (value > 0) & (scaled < 1e8) & (F.abs(scaled - F.floor(scaled) - F.lit(0.5)) > 1e-6)
    whole = F.rint(scaled).cast("long")
    if not places:
        return F.when(clear, whole.cast("string")).otherwise(slow)
    front = F.floor(whole / F.lit(10.0**places))
    digits = (whole - front * F.lit(10**places)).cast("string")
    digits = digits if places == 1 else F.lpad(digits, places, "0")
    slow = slow if mark == "." else F.replace(slow, F.lit("."), F.lit(mark))
    return F.when(clear, F.concat(front.cast("string"), F.lit(mark), digits)).otherwise(slow)


def exact_round(value: Column, places: int) -> Column:
    """The number that `exact_text` shows; only values near a tie, and very large ones, go through the text."""
    scale = F.lit(10.0**places)
    scaled = value * scale
    clear = (F.abs(scaled) < 1e8) & (F.abs(scaled - F.floor(scaled) - F.lit(0.5)) > 1e-6)
    return F.when(clear, F.rint(scaled) / scale).otherwise(_slow_text(value, places).cast("double"))


def comma_text(value: Column, places: int = 1) -> Column:
    return exact_text(value, places, ",")
