"""Distributed row number / NTILE equal the single-partition window."""
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from finlake.operators.keys import with_surrogate_key
from finlake.operators.ranking import global_row_number, with_ntile


@pytest.mark.parametrize("n,k,parts", [(1, 5, 3), (4, 5, 2), (5, 5, 4), (13, 5, 3), (1000, 5, 7), (997, 3, 8)])
def test_ntile_matches_window(spark, n, k, parts):
    rnd = random.Random(n * 31 + k)
    rows = [(i, rnd.choice([1, 2, 3, 5, 8, 13, 21])) for i in range(n)]   # many ties
    df = spark.createDataFrame(rows, "id int, v int")
    order = [F.col("v").desc(), F.col("id").asc()]
    ours = with_ntile(df, order, k, "q", partitions=parts).select("id", "q")
    ref = df.select("id", F.ntile(k).over(Window.orderBy(*order)).alias("q"))
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, ref.collect()))


def test_row_number_and_hot_key(spark):
    # one value holds a third of the rows: the unique tie-breaker spreads it
    rows = [(i, 7 if i % 3 == 0 else i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, v int")
    order = [F.col("v").asc(), F.col("id").asc()]
    ours = global_row_number(df, order, "rn", partitions=6).select("id", "rn")
    ref = df.select("id", F.row_number().over(Window.orderBy(*order)).alias("rn"))
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, ref.collect()))


def test_surrogate_keys_dense(spark):
    df = spark.createDataFrame([(f"C{i:03d}",) for i in range(50)], "code string")
    keys = [r.k for r in with_surrogate_key(df, "k", ["code"], partitions=4).orderBy("code").collect()]
    assert keys == list(range(1, 51))


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_prefix_sum_matches_window(spark, parts):
    from decimal import Decimal

    from finlake.operators.ranking import with_prefix_sum
    rnd = random.Random(parts)
    rows = [(i, Decimal(rnd.choice(["1.10", "2.25", "5.00", "9.99"])) if i % 17 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, v decimal(12,2)")
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    ours = with_prefix_sum(df, order, "v", "run", total="tot", ntile=(5, "q"), partitions=parts)
    w = Window.orderBy(*order)
    ref = df.select("id", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
                    F.sum("v").over(Window.partitionBy()).alias("tot"), F.ntile(5).over(w).alias("q"))
    assert sorted(map(tuple, ours.select("id", "run", "tot", "q").collect())) == \
        sorted(map(tuple, ref.collect()))
