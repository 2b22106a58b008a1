"""Top-k through a join equals join-then-top-k."""
import random

import pytest
from pyspark.sql import functions as F

from finlake.operators.topk import top_k_through_join


@pytest.mark.parametrize("seed,k", [(1, 3), (2, 10), (3, 25), (4, 1)])
def test_top_k_through_join_matches_plain(spark, seed, k):
    rnd = random.Random(seed)
    facts = [(i, rnd.randrange(12), rnd.choice([None, 5, 10, 10, 20, 30, 40, 40, 50])) for i in range(300)]
    # customers: keys 0..5 only (6..11 have no match, drop rows); key 2 appears twice (repeats rows)
    dims = [(c, f"name{c}") for c in range(6)] + [(2, "name2b")]
    fact = spark.createDataFrame(facts, "id int, ck int, v int")
    dim = spark.createDataFrame(dims, "ck int, name string")

    def join(f):
        return f.join(dim, "ck").select("id", "name", "v")

    order = [F.col("v").desc_nulls_last(), F.col("id").asc(), F.col("name").asc()]
    got = [tuple(r) for r in top_k_through_join(fact, "v", k, join, order).collect()]
    want = [tuple(r) for r in join(fact).orderBy(*order).limit(k).collect()]
    assert got == want


def test_margin_used_up_reads_the_rest(spark):
    """The join drops every row of the head: the whole fact decides."""
    fact = spark.range(300).selectExpr("id", "case when id % 50 = 49 then null else id div 2 end as v")
    dim = spark.range(40).withColumnRenamed("id", "key")
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    for margin in (0, 5, 1000):
        got = top_k_through_join(fact, "v", 5, lambda f: f.join(dim, f["id"] == dim["key"]), order, margin=margin).collect()
        want = fact.join(dim, fact["id"] == dim["key"]).orderBy(*order).limit(5).collect()
        assert got == want
