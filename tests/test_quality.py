"""Data-quality rules on planted defects and tolerance boundaries."""
from decimal import Decimal

from finlake.plans import quality
from finlake.sources.testdata import star_from_testdata
from tests.conftest import SF_SMALL


def test_defects_are_found(spark):
    star = star_from_testdata(spark, "/root/testdata/sf0.01", defects=True)
    assert quality.dq_orphan_txn_dates(star).first()[0] > 0
    assert quality.dq_gross_profit_mismatch(star).first()[0] > 0
    assert quality.dq_dup_customers(star).count() > 0
    sc = {r.table_name: r for r in quality.dq_scorecard(star).collect()}
    assert sc["dim_customers"].duplicates == 0 and sc["fact_transactions"].critical_nulls > 0


def test_clean_star_is_clean(spark):
    star = star_from_testdata(spark, SF_SMALL)
    assert quality.dq_orphan_txn_dates(star).first()[0] == 0
    assert quality.dq_health_range(star).first()[0] == 0
    assert quality.dq_dup_churn(star).count() == 0


def test_tolerance_boundary(spark):
    df = spark.createDataFrame(
        [(Decimal("10.00"), Decimal("4.00"), Decimal("7.00")),     # off by 1.00: passes
         (Decimal("10.00"), Decimal("4.00"), Decimal("7.01")),     # off by 1.01: fails
         (None, Decimal("4.00"), Decimal("7.01"))],                 # NULL: not counted
        "revenue_inr decimal(14,2), cogs_inr decimal(14,2), gross_profit_inr decimal(14,2)")
    assert quality.dq_gross_profit_mismatch({"fact_transactions": df}).first()[0] == 1
