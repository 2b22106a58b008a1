"""Calendar dimension generator."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlake.functions.dates import calendar_columns


def calendar(spark: SparkSession, start: str | dt.date, end: str | dt.date,
             fiscal_start_month: int = 1) -> DataFrame:
    """One row per day from start to end inclusive (1,096 rows for 2022-2024)."""
    s, e = dt.date.fromisoformat(str(start)), dt.date.fromisoformat(str(end))
    n = (e - s).days + 1
    days = spark.range(0, max(n, 0), numPartitions=1).select(
        F.date_add(F.lit(s), F.col("id").cast("int")).alias("d"))
    return days.select(*calendar_columns("d", fiscal_start_month))


def calendar_spanning(dates: DataFrame, col: str = "d",
                      fiscal_start_month: int = 1) -> DataFrame:
    """Calendar covering whole years from the first to the last date found in
    ``dates[col]``, built lazily (no driver round trip).  Any span works: one
    mistyped date only makes the calendar longer, and joins with it carry no
    broadcast hint."""
    bounds = dates.agg(F.min(F.to_date(F.col(col))).alias("lo"),
                       F.max(F.to_date(F.col(col))).alias("hi"))
    span = bounds.select(
        F.make_date(F.year("lo"), F.lit(1), F.lit(1)).alias("s"),
        F.make_date(F.year("hi"), F.lit(12), F.lit(31)).alias("e"))
    days = span.select(F.explode(F.sequence("s", "e", F.expr("interval 1 day"))).alias("d"))
    return days.select(*calendar_columns("d", fiscal_start_month))
