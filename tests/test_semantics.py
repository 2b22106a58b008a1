"""Hand-made frames for the reference's non-obvious semantics."""
import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from finlake.functions import enum_rank, parse_date, parse_decimal, parse_flag, parse_int, pct, quotient
from finlake.schemas import SEGMENTS
from finlake.sources.calendar import calendar


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_division_by_zero_is_null(spark):
    assert one(spark, pct(F.lit(5), F.lit(0))) is None
    assert one(spark, quotient(F.lit(1), F.lit(3))) == Decimal("0.333333")


def test_round_half_up_on_decimals(spark):
    assert one(spark, F.round(F.lit(Decimal("2.5")), 0)) == Decimal("3")
    assert one(spark, F.round(F.lit(Decimal("-2.5")), 0)) == Decimal("-3")
    assert one(spark, pct(F.lit(1), F.lit(32), 2, 0)) == Decimal("3.13")


def test_enum_order(spark):
    df = spark.createDataFrame([("Enterprise",), ("SMB",), ("Mid-Market",)], "segment string")
    got = [r[0] for r in df.orderBy(enum_rank("segment", SEGMENTS)).collect()]
    assert got == SEGMENTS


def test_calendar_attributes(spark):
    cal = calendar(spark, "2022-01-01", "2024-12-31")
    assert cal.count() == 1096
    first = cal.filter(F.col("date_key") == 20220101).first()
    assert first["day_of_week"] == 6 and first["day_name"] == "Saturday"
    assert first["week_of_year"] == 52 and first["month_name"] == "January"
    assert first["month_short"] == "Jan" and first["fiscal_month_label"] == "Jan-2022"
    assert first["fiscal_year_quarter"] == "2022-Q1"
    from finlake.plans.warehouse import verify_calendar
    rows = {r["fiscal_year"]: r for r in verify_calendar({"dim_date": cal}).collect()}
    assert rows[2024]["total_days"] == 366 and rows[2024]["month_ends"] == 12
    assert rows[2024]["quarter_ends"] == 4 and rows[2022]["weekend_days"] == 105


def test_parsers(spark):
    df = spark.createDataFrame(
        [("5-Jan-2022", "1,234.50", "12.7", "yes"), ("05-JAN-2022 ", " 99 ", "", "No "),
         ("2022-01-05", "bad", "x", None), ("31/01/2022", "", "7", "YES")], "d string, m string, i string, f string")
    got = df.select(parse_date("d").alias("d"), parse_decimal("m", 12, 2).alias("m"),
                    parse_int("i").alias("i"), parse_flag("f").alias("f")).collect()
    assert [r.d for r in got] == [dt.date(2022, 1, 5)] * 3 + [None]
    assert [r.m for r in got] == [Decimal("1234.50"), Decimal("99.00"), None, None]
    assert [r.i for r in got] == [12, None, None, 7]
    assert [r.f for r in got] == [1, 0, 0, 1]


def test_greatest_keeps_null(spark):
    from finlake.plans.churn import _greatest0
    assert one(spark, _greatest0(F.lit(None).cast("int"))) is None
    assert one(spark, _greatest0(F.lit(-3))) == 0


def _mini_star(spark):
    from finlake.sources.seed import product_seed
    cust = spark.createDataFrame(
        [(1, "CUST-1", dt.date(2022, 1, 10), Decimal("100.00")), (2, "CUST-2", dt.date(2022, 2, 1), Decimal("50.00")),
         (3, "CUST-3", dt.date(2022, 5, 1), Decimal("70.00"))],
        "customer_key int, customer_id string, acquisition_date date, mrr_inr decimal(12,2)")
    churn = spark.createDataFrame([(10, 1, Decimal("100.00"), 400)],
                                  "churn_key long, customer_key int, mrr_at_churn_inr decimal(12,2), days_to_churn smallint")
    txn = spark.createDataFrame(
        [(20221215, 2022, "Dec-2022", Decimal("100.00"), Decimal("10.00")),
         (20230105, 2023, "Jan-2023", Decimal("150.00"), Decimal("10.00")),
         (20230210, 2023, "Feb-2023", Decimal("50.00"), Decimal("10.00"))],
        "date_key int, fiscal_year smallint, fiscal_month string, revenue_inr decimal(14,2), gross_profit_inr decimal(14,2)")
    return {"dim_customers": cust, "fact_churn": churn, "fact_transactions": txn,
            "dim_date": calendar(spark, "2022-01-01", "2023-12-31"), "dim_product": product_seed(spark)}


def test_cohort_without_churn_keeps_null(spark):
    from finlake.plans.churn import chn_cohort_retention
    rows = {r["acq_cohort"]: r for r in chn_cohort_retention(_mini_star(spark)).collect()}
    assert rows["2022-Q1"]["churned_count"] == 1 and rows["2022-Q1"]["retained_mrr"] == 50.0
    assert rows["2022-Q2"]["mrr_churned"] is None and rows["2022-Q2"]["retained_mrr"] is None
    assert rows["2022-Q2"]["cohort_retention_rate_pct"] == 100.0


def test_ytd_restarts_but_mom_crosses_years(spark):
    from finlake.plans.revenue import rev_monthly_ytd_mom
    rows = rev_monthly_ytd_mom(_mini_star(spark)).collect()
    assert [r["ytd_revenue"] for r in rows] == [100.0, 150.0, 200.0]
    assert [r["mom_growth_pct"] for r in rows] == [None, 50.0, -66.67]


def test_rank_ties_share_rank(spark):
    from pyspark.sql import Window
    df = spark.createDataFrame([(2022, "a", 1.5), (2022, "b", 1.5), (2022, "c", 1.0)], "y int, l string, m double")
    r = df.select("l", F.rank().over(Window.partitionBy("y").orderBy(F.col("m").desc())).alias("k")).collect()
    assert sorted((x.l, x.k) for x in r) == [("a", 1), ("b", 1), ("c", 3)]


def test_category_year_heatmap_pivot(spark):
    from finlake.plans.revenue import rev_category_by_year
    from finlake.sources.testdata import star_from_testdata
    from tests.conftest import SF_SMALL
    star = star_from_testdata(spark, SF_SMALL)
    hm = rev_category_by_year(star, (1995, 1996))
    assert hm.columns == ["category", "fy_1995", "fy_1996", "fy_other"] and hm.count() == 5
    t = star["fact_transactions"].join(star["dim_product"], "product_key").filter("fiscal_year = 1995")
    want = {r[0]: float(round(r[1], 0)) for r in t.groupBy("category").agg(F.sum("revenue_inr")).collect()}
    assert {r.category: r.fy_1995 for r in hm.collect()} == want


def test_clv_dedup_variant(spark):
    from finlake.plans.profitability import prf_clv_plan
    from finlake.sources.testdata import star_from_testdata
    from tests.conftest import SF_SMALL
    star = star_from_testdata(spark, SF_SMALL)
    a = {r.plan: r for r in prf_clv_plan(star).collect()}
    b = {r.plan: r for r in prf_clv_plan(star, dedup=True).collect()}
    assert set(a) == set(b)
    assert all(a[p].customer_count == b[p].customer_count for p in a)
    assert any(a[p].avg_mrr != b[p].avg_mrr for p in a)


def test_calendar_of_a_mistyped_date(spark):
    """One date far off makes the calendar long, and nothing else."""
    from finlake.sources.calendar import calendar_spanning
    df = spark.createDataFrame([(dt.date(1000, 1, 1),), (dt.date(2020, 1, 1),)], "d date")
    assert calendar_spanning(df).count() == (dt.date(2020, 12, 31) - dt.date(1000, 1, 1)).days + 1

def test_yoy_bridge_skips_gap_years(spark):
    from finlake.plans.revenue import rev_yoy_bridge
    txn = spark.createDataFrame(
        [(2020, Decimal("100.00")), (2021, Decimal("150.00")), (2023, Decimal("300.00")), (2024, Decimal("150.00"))],
        "fiscal_year smallint, revenue_inr decimal(14,2)")
    rows = [(r.from_year, r.to_year, r.growth_pct) for r in rev_yoy_bridge({"fact_transactions": txn}).collect()]
    assert rows == [(2020, 2021, 50.0), (2023, 2024, -50.0)]
