"""Window operators over *grouped* frames.

These run after an aggregation, on one row per group (months, plans,
regions...), so an unpartitioned window costs a single small partition.
Row-level global orderings use ``finlake.operators.ranking`` instead.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finlake.functions.exact import col_, pct


def with_share(df: DataFrame, value: str, out: str, digits: int = 2, scale: int = 2) -> DataFrame:
    """value / SUM(value) OVER () * 100, rounded (share of total)."""
    total = F.sum(F.col(value)).over(Window.partitionBy())
    return df.withColumn(out, pct(F.col(value), total, digits, scale))


def lag_growth_pct(value, order: list, digits: int = 2, scale: int = 2,
                   partition: list | None = None) -> Column:
    """(v - LAG(v)) / LAG(v) * 100 over the given order; NULL for the first row."""
    w = Window.orderBy(*order) if not partition else Window.partitionBy(*partition).orderBy(*order)
    v = col_(value)
    prev = F.lag(v).over(w)
    return pct(v - prev, prev, digits, scale)


def running_total(value, partition: list, order: list) -> Column:
    w = (Window.partitionBy(*partition).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return F.sum(col_(value)).over(w)


def moving_avg(value, order: list, rows: int) -> Column:
    """AVG over the current and ``rows-1`` preceding rows (decimal semantics)."""
    w = Window.orderBy(*order).rowsBetween(-(rows - 1), Window.currentRow)
    return F.avg(col_(value)).over(w)
