"""Contrast stretch and quantisation in single precision, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def stretch(v: Column, low: Column, high: Column) -> Column:
    """(v - low) / max(high - low, 1e-9), held to 0..1, every step rounded to a float; NaN stays NaN."""
    low, high = low.cast("float"), high.cast("float")
    span = F.greatest((high - low).cast("float"), F.lit(1e-9).cast("float"))
    t = ((v.cast("float") - low).cast("float") / span).cast("float")
    return F.when(F.isnan(v), v.cast("float")).otherwise(F.least(F.greatest(t, F.lit(0.0).cast("float")), F.lit(1.0).cast("float")))


def quantise(t: Column) -> Column:
    """0..1 to 0..255, halves up; NaN becomes 0."""
    return F.when(F.isnan(t), F.lit(0)).otherwise(F.floor(t.cast("double") * 255.0 + 0.5).cast("int"))


def limits(n: Column, total: Column, squares: Column) -> tuple[Column, Column]:
    """Mean less and plus two population standard deviations, from count, sum and sum of squares; (0, 255) without values."""
    mean = total / n
    var = (squares - total * total / n) / n
    sd = F.when(var > 0, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(F.lit(0.0))
    none = F.coalesce(n, F.lit(0)) == 0
    return F.when(none, 0.0).otherwise(mean - 2 * sd), F.when(none, 255.0).otherwise(mean + 2 * sd)


def percentile_rank(n: Column, percent: float, up: bool) -> Column:
    """The 0-based rank that a nearest-rank limit takes among n sorted values; products in single precision."""
    share = (F.lit(percent).cast("float") / F.lit(100.0).cast("float")).cast("float")
    at = n.cast("float") * share
    return F.least((F.ceil(at) if up else F.floor(at)).cast("long"), n.cast("long") - 1)
