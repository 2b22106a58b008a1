"""Warehouse tables in the session catalog, and the inventory read from it.

``register_star`` names the Parquet tables under a warehouse root in a
database, with their descriptions as table comments.  ``inventory`` lists what
the catalog has: names and descriptions come from it, row counts from a scan
without columns, which reads Parquet footers and no data pages.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def register_star(spark: SparkSession, root: str, database: str, descriptions: dict[str, str]) -> None:
    """External tables ``database.name`` over ``root/name``; tables that are
    registered already are named anew.  Dropping them leaves the files."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{root}/_catalog'")
    for name, said in descriptions.items():
        spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}`")
        table = f"`{database}`.`{name}`"
        spark.catalog.createTable(table, path=f"{root}/{name}", source="parquet", description=said)
        if any(c.isPartition for c in spark.catalog.listColumns(table)):
            spark.catalog.recoverPartitions(table)  # the catalog lists a table's partitions itself


def inventory(spark: SparkSession, database: str) -> DataFrame:
    """table_name, description, row_count of every table of the database, by name."""
    rows = [spark.table(f"`{database}`.`{t.name}`").agg(F.count(F.lit(1)).alias("row_count"))
            .select(F.lit(t.name).alias("table_name"), F.lit(t.description).alias("description"), "row_count")
            for t in spark.catalog.listTables(database)]
    return reduce(DataFrame.unionByName, rows).orderBy("table_name")
