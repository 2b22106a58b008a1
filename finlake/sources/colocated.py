"""Tables laid out by customer: facts and customers bucketed on the customer's
key, so grouping a fact by customer and joining it to its customer need no
exchange of the fact.

A bucket is one task's work.  Customers that hold more than an even bucket's
share of a fact therefore go to a plain table beside it (at most as many as
there are buckets), which Spark splits by file size like any other.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlake.schemas import WAREHOUSE
from finlake.sources.staging import AUDIT_COLS, PARTITION_COLS

KEY = "customer_key"
LARGE = "_large"  # ending of the table that holds the large customers of a fact


def _save(df: DataFrame, table: str, path: str, buckets: int | None, years: list[str]) -> None:
    """One file per bucket and year; rows of one year are in the order of the key."""
    out = df.withColumns({c: F.current_timestamp() for c in AUDIT_COLS})
    if buckets:
        out = out.repartition(buckets, KEY)  # the same hash as the buckets': one task writes a bucket
    w = out.write.mode("overwrite").format("parquet").option("path", path)
    if buckets:
        w = w.bucketBy(buckets, KEY).sortBy(KEY)
    if years:
        w = w.partitionBy(*years)
    w.saveAsTable(table)


def large_keys(df: DataFrame, buckets: int) -> list:
    """Keys with more rows than an even bucket, fewer than ``buckets`` of them,
    and None where rows have no key: one pass, counted before the shuffle."""
    counts = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    apart = F.col(KEY).isNull() | (F.col("n") * buckets > F.col("total"))
    return [r[0] for r in counts.crossJoin(total).where(apart).select(KEY).collect()]


def write_colocated(star: dict, root: str, database: str, buckets: int, names: tuple[str, ...] = ("fact_transactions", "fact_churn"),
                    dims: tuple[str, ...] = ("dim_customers",)) -> None:
    """Tables ``database.name`` over ``root/name``, bucketed and sorted by
    customer; facts keep their partitions by year.  Rows without a customer
    form no group of a key's and lie in the plain table, too."""
    spark = next(iter(star.values())).sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{root}/_catalog'")
    for name in dims:
        _save(star[name], f"`{database}`.`{name}`", f"{root}/{name}", buckets, [])
    for name in names:
        fact, years = star[name], PARTITION_COLS.get(name, [])
        apart = large_keys(fact, buckets)
        large = F.col(KEY).isNull() | F.col(KEY).isin([k for k in apart if k is not None])
        _save(fact.where(~large) if apart else fact, f"`{database}`.`{name}`", f"{root}/{name}", buckets, years)
        spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}{LARGE}`")
        if apart:
            _save(fact.where(large), f"`{database}`.`{name}{LARGE}`", f"{root}/{name}{LARGE}", None, years)


def read_colocated(spark: SparkSession, database: str, audit: bool = False) -> dict[str, DataFrame]:
    """The tables of the database by name, each fact whole: where it has large
    customers, their rows are appended (and only then per-customer sums of the
    two parts meet in an exchange)."""
    tables = {t.name: spark.table(f"`{database}`.`{t.name}`") for t in spark.catalog.listTables(database)}
    out = {n: df for n, df in tables.items() if not n.endswith(LARGE)}
    for n, df in tables.items():
        if n.endswith(LARGE):
            out[n.removesuffix(LARGE)] = out[n.removesuffix(LARGE)].unionByName(df)
    for n, df in out.items():  # a partition column comes last in the catalog
        declared = [c for c in WAREHOUSE[n].names if c in df.columns] if n in WAREHOUSE else []
        out[n] = df.select(*declared, *[c for c in df.columns if c not in declared and (audit or c not in AUDIT_COLS)])
    return out
