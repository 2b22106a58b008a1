"""Global row numbers, NTILE and running sums without a single-partition sort.

``ROW_NUMBER() / NTILE(k) / SUM(x) OVER (ORDER BY ... ROWS UNBOUNDED
PRECEDING)`` on row-level data makes Spark move every row into one
partition.  Here:

1. range-partition by the sort key (boundaries from a sample; a unique
   tie-breaker in the key lets a hot value span several partitions) and
   sort inside each partition;
2. checkpoint to the shared checkpoint folder, so partition contents and
   order are fixed (no re-sampling on recomputation; a lost executor only
   means re-reading files);
3. count (and sum) rows per partition -> a tiny table of per-partition
   offsets (one row per partition, bounded by the partition count) that is
   broadcast back;
4. row number = offset of the partition + position inside the partition,
   read from ``monotonically_increasing_id`` (partition index in the upper
   bits, position in the lower 33 bits) -- no further shuffle.  A running
   sum adds a window per range partition (one shuffle keyed by partition,
   still spread over all partitions).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finlake.session import ensure_checkpoint_dir

_POS_BITS = 33
_MID, _PID = "__gr_mid", "__gr_pid"


def _fixed_order(df: DataFrame, order: list[Column], partitions: int | None) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fixed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint(eager=True)
    return (fixed.withColumn(_MID, F.monotonically_increasing_id())
            .withColumn(_PID, F.shiftright(_MID, _POS_BITS)))


def _ranked(df: DataFrame, order: list[Column], partitions: int | None,
            value: str | None = None) -> DataFrame:
    """Adds __rn (1-based global position), __n (row count) and, with
    ``value``, __run (running sum in that order) and __tot (total)."""
    tagged = _fixed_order(df, order, partitions)
    aggs = [F.count(F.lit(1)).alias("__cnt")]
    if value is not None:
        aggs.append(F.sum(value).alias("__psum"))
    per = tagged.groupBy(_PID).agg(*aggs)
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    cols = [_PID, F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__off"),
            F.sum("__cnt").over(everything).alias("__n")]
    if value is not None:
        cols += [F.sum("__psum").over(before).alias("__soff"),
                 F.sum("__psum").over(everything).alias("__tot")]
    offs = per.select(*cols)
    pos = F.col(_MID) - F.shiftleft(F.col(_PID), _POS_BITS)
    res = tagged.join(F.broadcast(offs), _PID).withColumn("__rn", F.col("__off") + pos + 1)
    if value is not None:
        local = F.sum(value).over(Window.partitionBy(_PID).orderBy(_MID)
                                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        prev = F.col("__soff")
        res = res.withColumn("__run", F.when(prev.isNull(), local)
                             .otherwise(F.coalesce(local, F.lit(0)) + prev))
    return res.drop(_MID, _PID, "__off", "__soff")


def global_row_number(df: DataFrame, order: list[Column], out: str = "row_num",
                      partitions: int | None = None, with_total: str | None = None) -> DataFrame:
    """Adds ``out`` = 1-based position of each row in the total order ``order``
    (which should end with a unique column to make it deterministic);
    ``with_total`` also adds the number of rows."""
    res = _ranked(df, order, partitions).withColumnRenamed("__rn", out)
    return res.withColumnRenamed("__n", with_total) if with_total else res.drop("__n")


def ntile_of_rank(rank, total, k: int) -> Column:
    """NTILE(k) bucket of 1-based row ``rank`` among ``total`` rows: the first
    total % k buckets hold one row more than the others."""
    r = F.col(rank) if isinstance(rank, str) else rank
    n = F.col(total) if isinstance(total, str) else total
    q = F.floor(n / k).cast("long")
    m = (n % k).cast("long")
    big = m * (q + 1)
    small_sz = F.greatest(q, F.lit(1))
    return F.when(r <= big, F.ceil(r / (q + 1))).otherwise(
        m + F.ceil((r - big) / small_sz)).cast("int")


def with_ntile(df: DataFrame, order: list[Column], k: int, out: str = "ntile",
               partitions: int | None = None) -> DataFrame:
    ranked = _ranked(df, order, partitions)
    return ranked.withColumn(out, ntile_of_rank("__rn", "__n", k)).drop("__rn", "__n")


def with_prefix_sum(df: DataFrame, order: list[Column], value: str, out: str = "running_sum",
                    total: str | None = None, ntile: tuple[int, str] | None = None,
                    partitions: int | None = None) -> DataFrame:
    """Running SUM(value) in the total order ``order`` (ROWS UNBOUNDED
    PRECEDING), optionally the grand total and an NTILE, from one ordering."""
    r = _ranked(df, order, partitions, value).withColumnRenamed("__run", out)
    if ntile:
        r = r.withColumn(ntile[1], ntile_of_rank("__rn", "__n", ntile[0]))
    r = r.withColumnRenamed("__tot", total) if total else r.drop("__tot")
    return r.drop("__rn", "__n")
