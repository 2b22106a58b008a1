"""Stored sketches, partial sums and the catalog inventory on hand frames."""
import glob
import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from finlake.operators.rollup import MEASURES, read_rollup, refresh_rollup
from finlake.operators.sketches import exact_counts, merged_estimates, period_sketches
from finlake.plans.profitability import prf_clv_plan, prf_clv_segment_region, prf_clv_top20
from finlake.plans.revenue import rev_by_industry
from finlake.sources.catalog import inventory, register_star
from finlake.sources.colocated import large_keys, read_colocated, write_colocated
from finlake.sources.testdata import star_from_testdata
from tests.conftest import SF_SMALL


@pytest.fixture
def folder(spark):
    return tempfile.mkdtemp(dir=spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))


def test_sketches_merge_for_any_period(spark, folder):
    fact = spark.range(60000).selectExpr("id % 24 AS month", "id div 3 AS a", "if(id % 5 = 0, NULL, id % 7) AS b")
    period_sketches(fact, ["month"], ["a", "b"]).write.parquet(f"{folder}/s")
    stored = spark.read.parquet(f"{folder}/s")
    assert stored.count() == 48
    for months in (range(24), (3,), (1, 2, 20)):
        some = F.col("month").isin(list(months))
        got = {r.column_name: r.estimate for r in merged_estimates(stored.where(some)).collect()}
        want = {r.column_name: r.exact for r in exact_counts(fact.where(some), ["a", "b"]).collect()}
        assert set(got) == set(want) == {"a", "b"}
        for c, n in want.items():
            assert abs(got[c] - n) <= 0.03 * n + 1
    assert period_sketches(fact.limit(0), ["month"], ["a"]).collect() == []


def test_rollup_refreshes_by_year(spark, folder):
    fact = star_from_testdata(spark, SF_SMALL)["fact_transactions"].cache()
    years = sorted(r[0] for r in fact.select("fiscal_year").distinct().collect())
    path = f"{folder}/r"

    def totals(df):
        n = F.sum("rows") if "rows" in df.columns else F.count(F.lit(1))
        return {r.fiscal_year: (r.n, *[r[m] for m in MEASURES]) for r in df.groupBy("fiscal_year").agg(n.alias("n"), *[F.sum(m).alias(m) for m in MEASURES]).collect()}
    for y in years:
        refresh_rollup(fact, path, [y])
    assert totals(read_rollup(spark, path)) == totals(fact)
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}
    more = fact.unionByName(fact.where(F.col("fiscal_year") == years[1]))
    refresh_rollup(more, path, [years[1]])
    assert totals(read_rollup(spark, path)) == totals(more)
    kept = [f for f in before if f"fiscal_year={years[1]}" not in f]
    assert kept and all(os.stat(f).st_mtime_ns == before[f] for f in kept)
    fact.unpersist()


def test_inventory_comes_from_the_catalog(spark, folder):
    spark.range(7).write.parquet(f"{folder}/a")
    spark.range(0).write.parquet(f"{folder}/b")
    database = "finlake_test_inventory"
    register_star(spark, folder, database, {"a": "first", "b": "second's"})
    assert [tuple(r) for r in inventory(spark, database).collect()] == [("a", "first", 7), ("b", "second's", 0)]
    plan = inventory(spark, database)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan or "struct<>" in plan
    register_star(spark, folder, database, {"a": "renamed"})
    assert {t.name: t.description for t in spark.catalog.listTables(database)}["a"] == "renamed"
    spark.sql(f"DROP DATABASE {database} CASCADE")
    assert spark.read.parquet(f"{folder}/a").count() == 7


def _exchanges_by_customer(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning\(customer_key#\d+L?, \d+\)", plan))


def test_tables_by_customer_need_no_exchange_of_the_fact(spark, folder):
    star = star_from_testdata(spark, SF_SMALL)
    database = "finlake_test_colocated"
    write_colocated(star, folder, database, 8)
    laid = {**star, **read_colocated(spark, database)}
    for name in ("fact_transactions", "fact_churn", "dim_customers"):
        assert laid[name].columns == star[name].columns and dict(laid[name].dtypes) == dict(star[name].dtypes)
        assert laid[name].exceptAll(star[name]).isEmpty() and star[name].exceptAll(laid[name]).isEmpty()
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for plan in (prf_clv_plan, prf_clv_top20, prf_clv_segment_region, rev_by_industry):
            assert _exchanges_by_customer(plan(laid)) == 0 < _exchanges_by_customer(plan(star))
            assert sorted(map(tuple, plan(laid).collect())) == sorted(map(tuple, plan(star).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        spark.sql(f"DROP DATABASE {database} CASCADE")


def test_large_customers_lie_in_a_plain_table(spark, folder):
    database = "finlake_test_large"
    fact = spark.range(9000).selectExpr("if(id % 3 = 0, 7, if(id % 100 = 1, NULL, id % 500)) AS customer_key", "id AS v")
    customers = spark.range(500).selectExpr("id AS customer_key")
    star = {"fact_churn": fact, "dim_customers": customers}
    assert set(large_keys(fact, 8)) == {7, None} and large_keys(fact.where("customer_key <> 7"), 8) == []
    write_colocated(star, folder, database, 8, names=("fact_churn",))
    plain = spark.table(f"{database}.fact_churn_large")
    assert {r[0] for r in plain.select("customer_key").distinct().collect()} == {7, None}
    assert spark.table(f"{database}.fact_churn").where("customer_key = 7 OR customer_key IS NULL").isEmpty()
    back = read_colocated(spark, database)
    assert set(back) == {"fact_churn", "dim_customers"}
    assert back["fact_churn"].count() == 9000 and back["fact_churn"].exceptAll(fact).isEmpty()
    # without large customers the table beside it goes; an empty fact has none
    write_colocated({**star, "fact_churn": fact.where("customer_key <> 7")}, folder, database, 8, names=("fact_churn",))
    assert not spark.catalog.tableExists(f"{database}.fact_churn_large")
    write_colocated({**star, "fact_churn": fact.limit(0)}, folder, database, 8, names=("fact_churn",))
    assert read_colocated(spark, database)["fact_churn"].isEmpty()
    spark.sql(f"DROP DATABASE {database} CASCADE")
