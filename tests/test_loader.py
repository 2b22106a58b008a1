"""Staging CSV scan + typed loaders."""
import os
import tempfile


from finlake.plans.warehouse import (load_dim_customers, load_fact_transactions, reject_transactions,
                                     render_customers, staging_from_star)
from finlake.sources.seed import product_seed
from finlake.sources.staging import read_staging
from finlake.sources.testdata import star_from_testdata
from tests.conftest import SF_SMALL

HEADER_T = ("TransactionID,CustomerID,TransactionDate,FiscalYear,FiscalQuarter,FiscalMonth,Category,ProductLine,"
            "Region,Segment,Plan,Revenue_INR,COGS_INR,GrossProfit_INR,GrossMargin_Pct,PaymentStatus,InvoiceID")


def test_csv_round_trip(spark):
    star = star_from_testdata(spark, SF_SMALL)
    stg = staging_from_star(star)["customers"]
    d = tempfile.mkdtemp(dir=spark.conf.get("spark.checkpoint.dir"))
    stg.write.mode("overwrite").option("header", True).csv(f"{d}/customers")
    back = read_staging(spark, f"{d}/customers", "customers")
    loaded = load_dim_customers(back, surrogate=False)
    want = star["dim_customers"].drop("customer_key")
    assert loaded.exceptAll(want).count() == 0 and want.exceptAll(loaded).count() == 0


def test_hand_rows_quotes_crlf_rejects(spark):
    cust_rows = render_customers(star_from_testdata(spark, SF_SMALL)["dim_customers"]).limit(3)
    cust = load_dim_customers(cust_rows)
    ids = [r.customer_id for r in cust.orderBy("customer_id").collect()]
    lines = [HEADER_T,
             f'T1,{ids[0]},5-Jan-2022,2022,Q1,Jan-2022,Training,API Suite,North,SMB,Starter,"1,234.50",100.00,1134.50,91.90,Paid,I1',
             f'T2,{ids[1].lower()} ,05-JAN-2022,2022,Q1,Jan-2022,Subscription, Core Platform ,North,SMB,Starter,10,1,9,90,overdue ,I2',
             'T3,NOPE,2022-01-05,2022,Q1,Jan-2022,Training,API Suite,North,SMB,Starter,10,1,9,90,Paid,I3',
             f'T4,{ids[2]},2022-01-05,2022,Q1,Jan-2022,Training,Unknown Line,North,SMB,Starter,10,1,9,90,Paid,I4',
             f'T5,{ids[2]},garbage,2022.7,Q1,Jan-2022,Training,API Suite,North,SMB,Starter,,1,9,90,Paid,I5']
    d = tempfile.mkdtemp(dir=spark.conf.get("spark.checkpoint.dir"))
    with open(os.path.join(d, "t.csv"), "w", newline="") as f:
        f.write("\r\n".join(lines) + "\r\n")
    stg = read_staging(spark, d, "transactions")
    prod = product_seed(spark)
    got = {r.transaction_id: r for r in load_fact_transactions(stg, cust, prod).collect()}
    assert set(got) == {"T1", "T2", "T5"}
    assert str(got["T1"].revenue_inr) == "1234.50" and got["T1"].date_key == 20220105
    assert got["T2"].date_key == 20220105 and got["T2"].product_key == 1
    assert got["T2"].payment_status == "Overdue"      # ENUM stores the declared spelling
    assert got["T5"].date_key is None and got["T5"].revenue_inr is None and got["T5"].fiscal_year == 2022
    assert got["T1"].invoice_id == "I1"          # last column has no stray \r
    rej = {r.TransactionID: r.reject_reason for r in reject_transactions(stg, cust, prod).collect()}
    assert rej == {"T3": "unknown customer", "T4": "unknown product"}


def test_write_table_spread_files(spark):
    import glob

    from finlake.sources.staging import read_table, write_table
    star = star_from_testdata(spark, SF_SMALL)
    d = tempfile.mkdtemp(dir=spark.conf.get("spark.checkpoint.dir"))
    fact = star["fact_transactions"]
    write_table(fact, f"{d}/ft", "fact_transactions", files_per_partition=2, spread_cols=["customer_key"])
    years = glob.glob(f"{d}/ft/fiscal_year=*")
    assert len(years) == fact.select("fiscal_year").distinct().count()
    assert all(len(glob.glob(f"{y}/*.parquet")) <= 2 for y in years)
    back = read_table(spark, f"{d}/ft").select(*fact.columns)
    assert back.exceptAll(fact).count() == 0 and fact.exceptAll(back).count() == 0


def test_materialized_lines_give_the_same_star(spark):
    lazy = star_from_testdata(spark, SF_SMALL)
    cut = star_from_testdata(spark, SF_SMALL, checkpoint_lines=True)
    for name in ["fact_transactions", "fact_budget_vs_actual"]:
        a, b = lazy[name], cut[name]
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_staging_keeps_corrupt_lines(spark):
    d = tempfile.mkdtemp(dir=spark.conf.get("spark.checkpoint.dir"))
    header = ("Period,FiscalYear,FiscalQuarter,Month,Department,BudgetedRevenue_INR,ActualRevenue_INR,"
              "RevenueVariance_INR,RevenueVariance_Pct,BudgetedOpEx_INR,ActualOpEx_INR,OpExVariance_INR,"
              "OpExVariance_Pct,BudgetedEBITDA_INR,ActualEBITDA_INR,HeadCount_Budget,HeadCount_Actual")
    good = "01-Jan-2022,2022,Q1,Jan-2022,Sales,10,11,1,10.00,5,5,0,0.00,2,3,4,4"
    short = "01-Feb-2022,2022,Q1,Feb-2022,Sales"
    with open(os.path.join(d, "b.csv"), "w") as f:
        f.write("\n".join([header, good, short]) + "\n")
    from finlake.plans.warehouse import load_fact_budget
    stg = read_staging(spark, d, "budget", keep_corrupt=True)
    rows = {r.Month: r._corrupt_record for r in stg.collect()}
    assert rows == {"Jan-2022": None, "Feb-2022": short}
    loaded = load_fact_budget(read_staging(spark, d, "budget")).collect()
    assert sorted(r.date_key for r in loaded) == [20220101, 20220201]


def test_loader_semantics_of_odd_cells(spark):
    """Empty texts, accents, overflow and truncation, label case, repeated ids."""
    from finlake.functions.parse import parse_int
    from finlake.plans.warehouse import ambiguous_customers, load_fact_churn, one_spelling, reject_churn
    row = spark.createDataFrame([("12.99999", "300", "-7.9", "x", "")], "a string, b string, c string, d string, e string").select(
        parse_int("a", "tinyint"), parse_int("b", "tinyint"), parse_int("c", "tinyint"), parse_int("d"), parse_int("e")).first()
    assert list(row) == [12, None, -7, None, None]
    cust = spark.createDataFrame([("CÉ1", 1), ("ce1", 2), ("C2", 3)], "customer_id string, customer_key int")
    assert sorted((r.customer_key, r.sharing) for r in ambiguous_customers(cust).collect()) == [(1, 2), (2, 2)]
    lines = [HEADER_T, ',cE1 ,5-Jan-2022,2022.9,Q1,Jan-2022,Training,api suite,north,smb,STARTER,10,1,9,90,Paid,',
             '\\N,C2,5-Jan-2022,2022,Q1,Jan-2022,Training,API Suite,North,SMB,Starter,10,1,9,90,Paid,I2']
    d = tempfile.mkdtemp(dir=spark.conf.get("spark.checkpoint.dir"))
    with open(os.path.join(d, "t.csv"), "w") as f:
        f.write("\n".join(lines) + "\n")
    got = load_fact_transactions(read_staging(spark, d, "transactions"), cust, product_seed(spark), surrogate=True).collect()
    assert [(r.transaction_id, r.customer_key, r.fiscal_year, r.region, r.segment, r.plan, r.invoice_id) for r in got] == [
        ("", 1, 2022, "North", "SMB", "Starter", "")]
    from finlake.schemas import STG_CHURN
    churn = spark.createDataFrame([("c2", *[None] * 17), ("gone", *[None] * 17)], STG_CHURN)
    assert [r.customer_key for r in load_fact_churn(churn, cust).collect()] == [3]
    assert [(r.CustomerID, r.reject_reason) for r in reject_churn(churn, cust).collect()] == [("gone", "unknown customer")]
    labels = spark.createDataFrame([("Price",), ("price",), ("PRICE",), ("Other",), (None,)], "churn_reason string")
    assert sorted(str(r[0]) for r in one_spelling(labels, "churn_reason").collect()) == ["None", "Other", "PRICE", "PRICE", "PRICE"]


def test_read_back_keeps_declared_types(spark):
    from finlake.sources.staging import read_table, write_table
    fact = star_from_testdata(spark, SF_SMALL)["fact_budget_vs_actual"]
    d = tempfile.mkdtemp(dir=spark.conf.get("spark.checkpoint.dir"))
    write_table(fact, f"{d}/b", "fact_budget_vs_actual", files_per_partition=1)
    back = read_table(spark, f"{d}/b", "fact_budget_vs_actual")
    assert dict(back.dtypes) == dict(fact.dtypes) and dict(back.dtypes)["fiscal_year"] == "smallint"
    audit = read_table(spark, f"{d}/b", "fact_budget_vs_actual", audit=True).select("created_at", "updated_at").first()
    assert audit[0] == audit[1] is not None


def test_no_local_folder_on_a_cluster():
    import pytest

    from finlake.session import ensure_checkpoint_dir, is_local

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session)
    assert [is_local(m) for m in ("local", "local[8]", "local[*]", "local-cluster[3,2,1024]", "yarn")] == [True, True, True, False, False]


def test_scratch_tables_go(spark):
    from finlake.session import drop_scratch, scratch_dir
    path = scratch_dir(spark, "gone")
    spark.range(3).write.parquet(path)
    assert drop_scratch(spark) >= 1 and not os.path.exists(path.removeprefix("file:"))


def test_building_the_budget_load_starts_no_job(spark):
    from finlake.plans.warehouse import q_load_fact_budget
    star = star_from_testdata(spark, SF_SMALL)
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    q_load_fact_budget(star)
    assert spark.sparkContext._jsc.sc().dagScheduler().nextJobId() == before
