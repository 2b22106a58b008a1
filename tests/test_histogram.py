"""NTILE sums from a value histogram and the duplicate-key screen against plain windows and groups."""
import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from finlake.operators.histogram import tile_sums
from finlake.operators.quality import duplicate_key_count


def frame(spark, values):
    return spark.createDataFrame([(i, None if v is None else Decimal(v)) for i, v in enumerate(values)], "id int, v decimal(12,2)")


CASES = {
    "many": [random.Random(1).randint(-500, 100_000) for _ in range(3000)],
    "hot value": [7] * 1000 + [random.Random(2).randint(0, 20) for _ in range(2000)],
    "one value": [5] * 13,
    "few rows": [3, 1],
    "nulls": [None] * 40 + [random.Random(3).randint(0, 9) for _ in range(37)],
    "only nulls": [None] * 7,
    "none": [],
}


@pytest.mark.parametrize("bins", [1, 3, 256])
@pytest.mark.parametrize("case", sorted(CASES))
def test_tile_sums_equal_ntile(spark, case, bins):
    df = frame(spark, CASES[case])
    got = tile_sums(df, "v", 5, {"s": "v", "share": "round(v / cast(nullif(total, 0) AS decimal(20,2)), 4)"}, bins)
    total = df.agg(F.sum("v")).first()[0]
    plain = df.withColumn("tile", F.ntile(5).over(Window.orderBy(F.col("v").desc_nulls_last(), "id")))
    share = F.round(F.col("v") / (F.lit(total).cast("decimal(20,2)") if total else F.lit(None).cast("decimal(20,2)")), 4)
    want = plain.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(share).alias("share"))

    def rows(d):
        return sorted((r.tile, r.n, r.s, r.share) for r in d.select("tile", "n", "s", "share").collect())
    assert rows(got) == rows(want)


def test_nothing_runs_before_the_action(spark):
    df = frame(spark, CASES["many"])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("built", "query building")
    tile_sums(df, "v", 5, {"s": "v"})
    assert tracker.getJobIdsForGroup("built") == []
    spark.sparkContext.setJobGroup("rest", "")


def test_duplicate_keys(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (None, "b"), (None, "b"), (3, None), (4, None), (5, "c"), (5, "c"), (5, "c")]
    df = spark.createDataFrame(rows, "k int, s string")
    for keys, n in ((["k"], 3), (["s"], 4), (["k", "s"], 3)):
        assert duplicate_key_count(df, keys).first()[0] == n
    assert duplicate_key_count(df.limit(0), ["s"]).first()[0] == 0
    # the screen keeps the answer right where hashes meet: swapped NULLs hash alike
    swapped = spark.createDataFrame([(1, None), (None, 1)], "a int, b int")
    assert swapped.select(F.xxhash64("a", "b")).distinct().count() == 1
    assert duplicate_key_count(swapped, ["a", "b"]).first()[0] == 0
