"""Connected components of an edge table by alternating stars.

A large star links every larger neighbour of a node to the node's smallest
neighbour, a small star does so for the smaller ones; repeated, every node ends
linked to its component's smallest node.  Each round is two aggregations and
two joins, written as a table under ``spark.checkpoint.dir``; nothing but two
sums comes to the driver.  A node with very many neighbours is pre-aggregated by
the minimum and, as a join key, split by Spark's skew join.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlake.session import scratch_dir


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u")
    return small.select("u", F.col("m").alias("v")).union(
        small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (u, v); root is the smallest node
    of its component and has a row of its own.  Loops and NULL ends are
    ignored, repeated edges count once, no edges give no rows."""
    spark = edges.sparkSession
    base = scratch_dir(spark, "components")
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges.write.parquet(f"{base}/0")
    edges, seen, k = spark.read.parquet(f"{base}/0"), None, 0
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, k = state, k + 1
        _round(edges).write.parquet(f"{base}/{k}")
        edges = spark.read.parquet(f"{base}/{k}")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select("v", "v").distinct().toDF("node", "root"))
