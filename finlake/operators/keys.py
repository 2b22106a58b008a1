"""Surrogate keys (AUTO_INCREMENT) for warehouse loads.

* ``with_stored_keys``: unique, gap-free keys in no particular order, for facts.
  The rows are written once with their place in the writing task; a key is the
  task's offset plus that place.  Nothing is sorted or shuffled, and since the
  places stand in files, a retried task or a second reading gives the same keys.
* ``with_surrogate_key``: keys 1..n in the order of the natural key, from the
  distributed row number, which sorts and checkpoints the rows: dimensions
  whose key is an INT use them.
* ``with_hashed_key``: a 64-bit hash of some columns; rows equal in them have
  equal keys, so it is no primary key of rows that may repeat."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finlake.operators.ranking import global_row_number
from finlake.session import scratch_dir

_PLACE_BITS = 33  # of monotonically_increasing_id: task above, place in the task below


def with_surrogate_key(df: DataFrame, name: str, order_cols: list[str], start: int = 1,
                       partitions: int | None = None) -> DataFrame:
    out = global_row_number(df, [F.col(c).asc_nulls_last() for c in order_cols], "_sk", partitions)
    return out.withColumn(name, (F.col("_sk") + (start - 1)).cast("long")).drop("_sk")


def with_hashed_key(df: DataFrame, name: str, cols: list[str]) -> DataFrame:
    """`name` = hash of the given columns; rows equal in them have equal keys."""
    return df.withColumn(name, F.xxhash64(*cols))


def with_stored_keys(df: DataFrame, name: str, after: int = 0, path: str | None = None) -> DataFrame:
    """`name` = after + 1 .. after + rows, each once; repeated rows get a key
    each.  The rows are written when this is called, to `path` or to a fresh
    folder under ``spark.checkpoint.dir``; the offsets, one row per writing
    task, are broadcast back."""
    spark = df.sparkSession
    path = path or scratch_dir(spark, "keyed")
    df.withColumn("__place", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path).withColumn("__task", F.shiftright("__place", _PLACE_BITS))
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("__task").agg(F.count(F.lit(1)).alias("__n"))
               .select("__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    place = F.col("__place") - F.shiftleft("__task", _PLACE_BITS)
    return (rows.join(F.broadcast(offsets), "__task")
            .withColumn(name, F.lit(after) + F.col("__before") + place + 1).select(*df.columns, name))
