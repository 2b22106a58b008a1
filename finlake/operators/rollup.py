"""Partial sums of the transaction fact, kept as a table and refreshed by year.

A row stands for a month, product, segment, region and payment status; it has
the fact's column names, sums in its measures, the month's first day that
occurs as date_key, and the number of rows.  Statements that only sum measures
of the fact read it in the fact's place.  Refreshing a year reads and writes
that year's partition alone, and doing it twice changes nothing.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEASURES = ["revenue_inr", "cogs_inr", "gross_profit_inr"]
GROUPS = ["fiscal_year", "fiscal_quarter", "fiscal_month", "product_key", "segment", "region", "payment_status"]


def rolled_up(fact: DataFrame) -> DataFrame:
    """The fact's partial sums; a group's rows are combined by task first."""
    month = F.floor(F.col("date_key") / 100).cast("int").alias("_month")
    g = fact.groupBy(*GROUPS, month).agg(F.min("date_key").alias("date_key"), F.count(F.lit(1)).alias("rows"),
                                         *[F.sum(m).alias(m) for m in MEASURES])
    return g.drop("_month")


def refresh_rollup(fact: DataFrame, path: str, years: list[int] | None = None) -> None:
    """Writes the partial sums of the given years of the fact (all without a
    list) over what the table has of them; other years are not touched."""
    rows = fact if years is None else fact.where(F.col("fiscal_year").isin(years))
    (rolled_up(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fiscal_year").parquet(path))


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumn("fiscal_year", F.col("fiscal_year").cast("smallint"))
