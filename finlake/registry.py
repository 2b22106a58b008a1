"""Registered queries: name -> plan over the star schema built from the
driver's tables.  Data-quality checks run on the planted-defect star."""
from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from finlake.plans import churn, ingest, profitability, quality, revenue, warehouse

# name -> (plan, source): source "star" = clean star, "defects" = planted-
# defect star, "raw" = plan takes (spark, sf_dir) itself
PLANS: dict[str, tuple[Callable[..., DataFrame], str]] = {}


def _reg(module, names: list[str], defects: bool = False, attr: dict | None = None) -> None:
    for n in names:
        PLANS[n] = (getattr(module, (attr or {}).get(n, n)), "defects" if defects else "star")


_reg(revenue, ["rev_kpis", "rev_annual_yoy", "rev_quarterly_qoq", "rev_monthly_ytd_mom",
               "rev_mrr_by_plan", "rev_mrr_segment_region", "rev_mrr_pareto", "rev_mrr_pareto_ranked",
               "rev_by_segment",
               "rev_by_industry", "rev_by_region_year", "rev_by_product_line", "rev_mix_recurring",
               "rev_category_heatmap", "rev_rolling", "rev_seasonality", "rev_yoy_bridge",
               "rev_forecast_next_year", "rev_by_payment_status", "rev_overdue_by_region"])
_reg(churn, ["chn_summary", "chn_annual", "chn_monthly", "chn_by_plan", "chn_by_segment",
             "chn_by_region", "chn_by_reason_type", "chn_voluntary_share", "chn_cohort_size",
             "chn_cohort_retention", "chn_days_buckets", "chn_at_risk_top50", "chn_risk_by_plan",
             "chn_win_back", "chn_nrr"])
_reg(profitability, ["prf_margin_line_year", "prf_margin_category", "prf_margin_quarterly",
                     "prf_clv_plan", "prf_clv_segment_region", "prf_clv_top20", "prf_annual_pnl",
                     "prf_department_pnl", "prf_monthly_variance", "prf_missed_budget",
                     "prf_headcount", "prf_scorecard"])
_reg(quality, ["dq_nulls_customers", "dq_nulls_transactions", "dq_nulls_churn", "dq_dup_customers",
               "dq_dup_transactions", "dq_dup_churn", "dq_dup_budget", "dq_orphan_txn_dates",
               "dq_orphan_churn_dates", "dq_orphan_budget_dates", "dq_nonpositive_revenue",
               "dq_cogs_exceeds_revenue", "dq_gross_profit_mismatch", "dq_arr_mrr_mismatch",
               "dq_health_range", "dq_churn_before_acq", "dq_days_to_churn", "dq_nps_range",
               "dq_variance_mismatch", "dq_mrr_by_plan", "dq_revenue_by_line", "dq_churn_by_reason",
               "dq_revenue_outliers", "dq_high_tickets", "dq_scorecard"], defects=True)
_reg(warehouse, ["load_stg_customers", "load_stg_transactions", "load_stg_churn", "load_stg_budget",
                 "load_dim_date", "verify_calendar", "sample_calendar", "load_dim_customers",
                 "load_fact_transactions", "load_fact_churn", "load_fact_budget", "load_counts_staging",
                 "load_counts_warehouse", "load_counts_single", "table_inventory",
                 "load_write_read_back", "load_dirty_staging"],
     attr={n: f"q_{n}" for n in ["load_dim_customers", "load_fact_transactions", "load_fact_churn",
                                 "load_fact_budget"]})
_reg(ingest, ["load_keyed_appends", "load_quarantine", "load_fault_counts", "load_whole_rows", "load_reload_changes",
              "load_label_spelling", "rev_distinct_by_sketch", "rev_monthly_from_rollup", "catalog_inventory", "rev_by_industry_colocated",
              "prf_clv_plan_colocated", "prf_clv_top20_colocated"])
PLANS.update({n: (fn, "star") for n, fn in ingest.READ_BACK.items()})
# the years of the test tables; a user names those of their own
PLANS["rev_category_by_year"] = (partial(revenue.rev_category_by_year, years=tuple(range(1995, 2002))), "star")
_reg(warehouse, ["check_constraints"], defects=True)
PLANS["load_product_seed"] = (warehouse.load_product_seed, "raw")


def _star(spark: SparkSession, sf_dir: str, defects: bool):
    from finlake.session import fit_partitions
    from finlake.sources.testdata import TABLES, star_from_testdata
    fit_partitions(spark, [f"{sf_dir}/{n}.parquet" for n in TABLES])
    return star_from_testdata(spark, sf_dir, defects=defects, named=True)


def make_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn, source = PLANS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if source == "raw":
            return fn(spark, sf_dir)
        return fn(_star(spark, sf_dir, source == "defects"))
    run.__name__ = name
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: make_query(n) for n in PLANS}


def oracle_sql() -> dict[str, str]:
    from finlake.oracle import churn as o_chn
    from finlake.oracle import ingest as o_ing
    from finlake.oracle import profitability as o_prf
    from finlake.oracle import quality as o_dq
    from finlake.oracle import warehouse as o_wh
    from finlake.oracle import revenue as o_rev
    out: dict[str, str] = {}
    for mod in (o_rev, o_chn, o_prf, o_dq, o_wh, o_ing):
        out.update(mod.Q)
    return {k: v for k, v in out.items() if k in PLANS}
