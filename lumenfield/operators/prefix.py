"""Running values over long histories, without one task holding a whole history.

A history (the rows of one key) is cut into ranges of its whole-number order column. Running values
are worked out inside the ranges, the ranges' totals are carried forward over the few ranges of each
key, and the two are put together. Rows with a null order come in a range of their own, first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a range of the order column.
WIDTH = 1 << 20


def running(rows: DataFrame, key: str, order: str, maxima: dict[str, str] | None = None, sums: dict[str, Column] | None = None, before: dict[str, str] | None = None, width: int = WIDTH) -> DataFrame:
    """rows with running maxima and sums (the row itself included), and values of the row before.

    maxima and before: new column -> column; sums: new column -> expression. Orders are distinct within a key.
    """
    maxima, sums, before = maxima or {}, sums or {}, before or {}
    d = rows.withColumn("__part", F.floor(F.col(order) / width))
    inside = Window.partitionBy(key, "__part").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    totals = [F.max(c).alias(f"__{n}") for n, c in maxima.items()] + [F.sum(e).alias(f"__{n}") for n, e in sums.items()]
    totals += [F.max_by(F.struct(F.col(c).alias("v")), order).alias(f"__{n}") for n, c in before.items()]
    parts = d.groupBy(key, "__part").agg(*totals)
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.max(f"__{n}").over(earlier).alias(f"__{n}") for n in maxima] + [F.sum(f"__{n}").over(earlier).alias(f"__{n}") for n in sums]
    carried += [F.last(f"__{n}").over(earlier).alias(f"__{n}") for n in before]
    parts = parts.select(F.col(key).alias("__key"), F.col("__part").alias("__at"), *carried)
    own = [F.max(c).over(upto).alias(n) for n, c in maxima.items()] + [F.sum(e).over(upto).alias(n) for n, e in sums.items()]
    own += [F.lag(F.struct(F.col(c).alias("v"))).over(inside).alias(n) for n, c in before.items()]
    j = d.select("*", *own).join(parts, F.col(key).eqNullSafe(F.col("__key")) & F.col("__part").eqNullSafe(F.col("__at")))
    out = {n: F.greatest(F.col(n), F.col(f"__{n}")) for n in maxima} | {n: F.col(n) + F.coalesce(F.col(f"__{n}"), F.lit(0)) for n in sums}
    out |= {n: F.coalesce(F.col(n), F.col(f"__{n}"))["v"] for n in before}
    return j.withColumns(out).select(*rows.columns, *out)
