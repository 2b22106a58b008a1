"""Work per task does not grow with the input: shuffle partitions follow the
stored bytes, no task holds a year or a product, staging files stay small."""
import pytest
from pyspark.sql import functions as F

from finlake import session
from finlake.operators.reload import reload_table
from finlake.plans import ingest, warehouse
from finlake.schemas import FACT_TRANSACTIONS
from finlake.session import fit_partitions, scratch_dir
from finlake.sources import staging
from finlake.sources.seed import product_rows, product_seed

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


@pytest.fixture
def star(spark):
    from finlake.sources.testdata import star_from_testdata
    return star_from_testdata(spark, "/root/testdata/sf0.001")


@pytest.fixture
def unset(spark):
    had = {k: spark.conf.get(k, None) for k in (INITIAL, "finlake.initialPartitionNum")}
    for k in had:
        spark.conf.unset(k)
    yield
    for k, v in had.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_partitions_follow_the_stored_bytes(spark, unset, monkeypatch):
    path = scratch_dir(spark, "stored")
    spark.range(50_000).write.parquet(path)
    assert fit_partitions(spark, [path]) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(session, "BYTES_PER_PARTITION", 2_000)
    n = fit_partitions(spark, [path, path + "-not-there"])
    assert n > 50 and spark.conf.get(INITIAL) == str(n)
    spark.conf.set(INITIAL, "33")  # the user's own
    assert fit_partitions(spark, [path]) == 33 and spark.conf.get(INITIAL) == "33"


def test_product_seed_has_a_known_size(spark):
    seed = product_seed(spark)
    assert [tuple(r) for r in seed.collect()] == product_rows()
    assert int(str(seed._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 10_000


def test_transaction_load_sorts_no_rows_by_product(spark, star):
    stg = warehouse.render_transactions(star["fact_transactions"], star["dim_customers"], star["dim_product"])
    plan = _plan(warehouse.load_fact_transactions(stg, star["dim_customers"], star["dim_product"]))
    top = plan[:plan.index("Aggregate")]
    assert "SortMergeJoin" not in top.split("ShuffledHashJoin")[0] and "ShuffledHashJoin" in top


def test_products_by_text_and_by_collation(spark):
    """Products that collate alike are all found, by any spelling; a null finds none."""
    p = spark.createDataFrame([(1, "Core", "Sub"), (2, "CORE", "sub "), (3, "Api", "Sub"), (None, "Null key", "Sub"), (5, None, "Sub")],
                              "product_key int, product_line string, category string")
    rows = [("a", "Core ", "Sub"), ("b", "cöre", "SUB"), ("c", "Api", " Sub"), ("d", "api", "Sub"), ("e", "none", "Sub"), ("f", None, "Sub"),
            ("g", "Null key", "Sub"), ("h", "null KEY", "Sub")]
    s = spark.createDataFrame(rows, "id string, ProductLine string, Category string")
    got = sorted((r.id, r.product_key or 0) for r in warehouse._with_product(s, p).collect())
    assert got == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 3), ("d", 3), ("g", 0), ("h", 0)]


def test_staging_files_are_cut_and_read_back(spark, star, monkeypatch):
    monkeypatch.setattr(staging, "STAGING_FILE_ROWS", 500)
    text = warehouse.render_transactions(star["fact_transactions"], star["dim_customers"], star["dim_product"]).cache()
    path = scratch_dir(spark, "cut")
    staging.write_staging(text, path)
    got = staging.read_staging(spark, path, "transactions")
    assert len(got.inputFiles()) >= text.count() / 500 and all(f.endswith(".csv.gz") for f in got.inputFiles())
    assert got.exceptAll(text).count() == 0 and text.exceptAll(got).count() == 0


@pytest.mark.parametrize("query", ["load_read_back_fact_transactions", "load_read_back_fact_churn"])
def test_read_back_writes_without_a_shuffle_by_year(spark, star, query, monkeypatch):
    asked = []
    monkeypatch.setattr(ingest, "write_star", lambda s, root, files_per_partition=4: asked.append(files_per_partition) or staging.write_star(s, root, files_per_partition))
    assert ingest.READ_BACK[query](star).count() > 0
    assert asked == [None]


def test_first_load_writes_its_rows_once(spark, star, monkeypatch):
    made = []
    monkeypatch.setattr("finlake.operators.reload.scratch_dir", lambda s, p: made.append(scratch_dir(s, p)) or made[-1])
    path = scratch_dir(spark, "first")
    fact = star["fact_transactions"].drop("transaction_key")
    said = reload_table(fact, path, ["transaction_id"], FACT_TRANSACTIONS, "transaction_key", "fiscal_year")
    assert spark.read.parquet(path).count() == said.where("kind = 'new'").count() == fact.select("transaction_id").distinct().count()
    import os
    assert not os.path.exists(f"{made[0].removeprefix('file:')}/rows")


def test_rendering_shuffles_no_whole_facts_by_customer(spark):
    """Customer ids are joined with orders: what becomes text is not sorted by customer again."""
    from finlake.registry import _star
    star, had = _star(spark, "/root/testdata/sf0.001", False), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10000")  # the products alone
    try:
        for text in (warehouse.staging_from_star(star)["transactions"], warehouse.transactions_text(star)):
            plan = _plan(text)
            assert "SortMergeJoin" not in plan[:plan.index("TXN-")] and "SortMergeJoin" in plan
            lines = plan[plan.index("SortMergeJoin"):]
            assert lines.index("l_orderkey") < lines.index("l_partkey")  # parts are joined below orders
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)


def test_rendering_with_ids_gives_the_rows_of_the_join(spark):
    """Repeated, unknown and null keys too: each fact meets each of its customer's rows."""
    from finlake.sources.testdata import NAMED, TABLES, star_from_testdata
    path = scratch_dir(spark, "odd")
    for t in TABLES:
        df = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        if t == "customer":
            df = df.where("c_custkey % 7 > 0").unionByName(df.where("c_custkey % 5 = 0").selectExpr("c_custkey", "concat(c_name, '+') c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
            df = df.unionByName(df.limit(2).selectExpr("cast(null as bigint) c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
        if t in ("orders", "lineitem", "part"):
            key = df.columns[1 if t == "orders" else 0]
            df = df.unionByName(df.limit(20)).unionByName(df.limit(5).withColumn(key, F.lit(None).cast("bigint")))
        df.write.parquet(f"{path}/{t}.parquet")
    star = star_from_testdata(spark, path, named=True)
    want = warehouse.render_transactions(star["fact_transactions"], star["dim_customers"], star["dim_product"]).cache()
    got = warehouse.transactions_text(star)
    assert NAMED in star and NAMED not in star_from_testdata(spark, path, defects=True, named=True)
    assert want.count() > star["fact_transactions"].count() > 0  # customers do repeat
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_reload_keeps_the_kinds_alone(spark, star, monkeypatch):
    """Whole rows that are written on the way are gone when the table stands; session options are as they were."""
    import os
    made = []
    for module in ("reload", "keys"):
        monkeypatch.setattr(f"finlake.operators.{module}.scratch_dir", lambda s, p: made.append(scratch_dir(s, p)) or made[-1])
    path, fact = scratch_dir(spark, "kinds-alone"), star["fact_transactions"].drop("transaction_key")
    had = {k: spark.conf.get(k, None) for k in session.WRITES_IN_A_ROW}
    how = dict(keys=["transaction_id"], schema=FACT_TRANSACTIONS, surrogate="transaction_key", partition="fiscal_year")
    reload_table(fact.where("customer_key % 10 > 3"), path, **how)
    said = reload_table(fact.withColumn("payment_status", F.when(F.col("customer_key") % 10 == 5, "Moved").otherwise(F.col("payment_status"))), path, **how)
    assert {r.kind for r in said.select("kind").distinct().collect()} == {"new", "changed", "same"}
    assert [os.listdir(m.removeprefix("file:")) for m in made if os.path.exists(m.removeprefix("file:"))] == [["kinds"]] * 2
    assert {k: spark.conf.get(k, None) for k in had} == had


@pytest.mark.parametrize("most", [28, 15])
def test_rows_are_split_by_keys_without_a_shuffle(spark, monkeypatch, most):
    from finlake.operators import keybits
    monkeypatch.setattr(keybits, "MAX_BITS", most)
    df = spark.range(60_000).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("k"), F.col("id"))).alias("a"), (F.col("id") % 5).alias("b"), F.col("id").alias("v"))
    keys = df.where("v % 10 = 3").select("a", "b").distinct()
    some, others = keybits.split_by_keys(df, keys.select(keybits.key_hash(["a", "b"])), ["a", "b"], keys.count())
    assert some.count() + others.count() == 60_000 and some.unionByName(others).exceptAll(df).count() == 0
    on = (df["a"].eqNullSafe(keys["a"]) & df["b"].eqNullSafe(keys["b"]))
    inside = {r.v for r in df.join(keys, on, "left_semi").collect()}
    passed = {r.v for r in some.collect()}
    assert inside <= passed and len(passed) < len(inside) + 54_000 * (0.09 if most > 15 else 0.3)
    for part in (some, others):  # only the keys are dealt
        plan = _plan(part)
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_transactions_alone_are_the_transactions(spark):
    """Repeated, unknown and null keys too; lines meet parts below orders."""
    from finlake.sources.testdata import ALONE, TABLES, star_from_testdata
    path, had = scratch_dir(spark, "alone"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for t in TABLES:
        df = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        if t in ("customer", "orders", "lineitem", "part"):
            key = df.columns[1 if t == "orders" else 0]
            df = df.where(f"{key} % 11 > 0").unionByName(df.limit(20)).unionByName(df.limit(5).withColumn(key, F.lit(None).cast("bigint")))
        df.write.parquet(f"{path}/{t}.parquet")
    star = star_from_testdata(spark, path, named=True)
    want, got = star["fact_transactions"], star[ALONE]
    assert got.columns == want.columns and got.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert ALONE not in star_from_testdata(spark, path, defects=True, named=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10000")
    try:
        plan = _plan(got.drop("transaction_key"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    lines = plan[plan.index("SortMergeJoin"):]
    assert lines.index("l_orderkey") < lines.index("l_partkey")
