"""Profitability: gross margin, customer lifetime value, budget vs actual P&L,
executive scorecard."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from finlake.functions.exact import out_double, pct, quotient
from finlake.plans._common import Star, dbl_avg, dbl_sum, n_rows, products

D = DecimalType

# ---- fixed values: monthly performance flag cut-offs (avg variance %) ----
FLAG_CUTOFFS = [(-5, "MISSED TARGET"), (0, "SLIGHTLY BELOW"), (5, "ON TARGET")]
FLAG_REST = "EXCEEDED TARGET"


def _margin_aggs() -> list[Column]:
    return [dbl_sum("revenue_inr", "total_revenue"), dbl_sum("cogs_inr", "total_cogs"),
            dbl_sum("gross_profit_inr", "gross_profit"),
            F.round(F.avg("gross_margin_pct"), 2).alias("_m")]


def prf_margin_line_year(star: Star) -> DataFrame:
    """Gross margin per product line and year, ranked within the year on the
    rounded margin (ties share a rank)."""
    t = star["fact_transactions"].join(products(star, "product_line"), "product_key")
    g = (t.groupBy("product_line", F.col("fiscal_year").cast("int").alias("fiscal_year"))
         .agg(*_margin_aggs()))
    rank = F.rank().over(Window.partitionBy("fiscal_year").orderBy(F.col("_m").desc()))
    return g.select("product_line", "fiscal_year", "total_revenue", "total_cogs", "gross_profit",
                    out_double("_m").alias("avg_gross_margin_pct"), rank.alias("margin_rank")
                    ).orderBy("fiscal_year", "margin_rank")


def prf_margin_category(star: Star) -> DataFrame:
    t = star["fact_transactions"].join(products(star, "category", "is_recurring", "cogs_pct_std"),
                                       "product_key")
    g = t.groupBy("category", "is_recurring", "cogs_pct_std").agg(*_margin_aggs())
    vs = F.round(F.col("_m") - (F.lit(100) - F.col("cogs_pct_std")), 2)
    return g.select("category", F.col("is_recurring").cast("int").alias("is_recurring"),
                    "total_revenue", "total_cogs", "gross_profit",
                    out_double("_m").alias("avg_gross_margin_pct"),
                    out_double(vs).alias("margin_vs_standard_pct")
                    ).orderBy(F.col("avg_gross_margin_pct").desc())


def prf_margin_quarterly(star: Star) -> DataFrame:
    g = (star["fact_transactions"]
         .groupBy(F.col("fiscal_year").cast("int").alias("fiscal_year"), "fiscal_quarter")
         .agg(dbl_sum("revenue_inr", "revenue"), dbl_sum("gross_profit_inr", "gross_profit"),
              F.avg("gross_margin_pct").alias("_m")))
    prev = F.lag("_m").over(Window.orderBy("fiscal_year", "fiscal_quarter"))
    return g.select("fiscal_year", "fiscal_quarter", "revenue", "gross_profit",
                    out_double(F.round("_m", 2)).alias("avg_gross_margin_pct"),
                    out_double(F.round(F.col("_m") - prev, 2)).alias("qoq_margin_change_pp")
                    ).orderBy("fiscal_year", "fiscal_quarter")


def _txn_per_customer(star: Star) -> DataFrame:
    """Fact reduced to one row per customer before joining the customer
    dimension: transaction count and margin sum/count."""
    return (star["fact_transactions"].groupBy("customer_key")
            .agg(F.count(F.lit(1)).alias("_n"), F.sum("gross_margin_pct").alias("_msum"),
                 F.count("gross_margin_pct").alias("_mcnt")))


def _clv_base(star: Star) -> DataFrame:
    c = star["dim_customers"].filter(F.col("is_active") == 1)
    return c.join(_txn_per_customer(star), "customer_key")


def _pct_to_ratio(p: Column) -> Column:
    """A 6-digit percentage as an exact 8-digit ratio (narrow operands keep
    Spark's decimal division from dropping digits)."""
    return (p.cast(D(12, 6)) / F.lit(100).cast(D(3, 0))).cast(D(10, 8))


def _clv_group(star: Star, keys: list[str], total: bool, dedup: bool = False) -> DataFrame:
    """CLV = AVG(mrr) x AVG(margin)/100 x AVG(lifetime months), where the
    averages run over customer x transaction rows, as in the reference
    (customers with more transactions weigh more).  The weighted sums are
    computed from per-customer aggregates.  ``dedup=True`` averages MRR and
    lifetime over customers instead (each customer once)."""
    b = _clv_base(star)
    n = F.lit(1).cast("long") if dedup else F.col("_n")
    g = (b.groupBy(*keys)
         .agg(F.countDistinct("customer_key").alias("customer_count"),
              F.sum(F.col("mrr_inr") * n).alias("_mrr_w"),
              F.sum(F.when(F.col("mrr_inr").isNotNull(), n)).alias("_mrr_n"),
              F.sum("_msum").alias("_ms"), F.sum("_mcnt").alias("_mc"),
              F.sum(F.col("expected_cltv_months").cast("long") * n).alias("_l_w"),
              F.sum(F.when(F.col("expected_cltv_months").isNotNull(), n)).alias("_l_n")))
    a_mrr = quotient("_mrr_w", "_mrr_n")                   # scale 6, as AVG(dec(12,2))
    a_m = quotient("_ms", "_mc")                           # scale 6, as AVG(dec(6,2))
    a_l = F.try_divide(F.col("_l_w").cast(D(20, 0)), F.col("_l_n").cast(D(20, 0)))
    a_l4 = F.round(a_l, 4)                                 # AVG(int): 4 digits
    factor = _pct_to_ratio(a_m) * a_l4.cast(D(12, 4))
    cols = [*keys, "customer_count", out_double(F.round(a_mrr, 0)).alias("avg_mrr"),
            out_double(F.round(a_m, 2)).alias("avg_gross_margin_pct"),
            out_double(F.round(a_l4, 0)).alias("avg_lifetime_months"),
            out_double(F.round(a_mrr.cast(D(20, 6)) * factor, 0)).alias("avg_clv_inr")]
    if total:
        cols.append(out_double(F.round(F.col("_mrr_w").cast(D(24, 2)) * factor, 0))
                    .alias("total_clv_potential_inr"))
    return g.select(*cols).orderBy(F.col("avg_clv_inr").desc())


def prf_clv_plan(star: Star, dedup: bool = False) -> DataFrame:
    return _clv_group(star, ["plan"], total=True, dedup=dedup)


def prf_clv_segment_region(star: Star, dedup: bool = False) -> DataFrame:
    return _clv_group(star, ["segment", "region"], total=False, dedup=dedup)


def prf_clv_top20(star: Star, k: int = 20) -> DataFrame:
    b = _clv_base(star)
    a_m = quotient("_msum", "_mcnt")
    clv = F.round(F.col("mrr_inr") * _pct_to_ratio(a_m)
                  * F.col("expected_cltv_months").cast(D(3, 0)), 0)
    out = b.select("customer_id", "company_name", "plan", "segment", "industry", "region",
                   out_double(F.round("mrr_inr", 0)).alias("mrr_inr"),
                   out_double(F.round("arr_inr", 0)).alias("arr_inr"),
                   F.col("expected_cltv_months").cast("int").alias("expected_cltv_months"),
                   out_double(F.round(a_m, 2)).alias("avg_gross_margin_pct"),
                   out_double(clv).alias("estimated_clv_inr"), "health_status")
    return out.orderBy(F.col("estimated_clv_inr").desc_nulls_last(), F.col("customer_id")).limit(k)


def prf_annual_pnl(star: Star) -> DataFrame:
    g = (star["fact_budget_vs_actual"].groupBy(F.col("fiscal_year").cast("int").alias("fiscal_year"))
         .agg(dbl_sum("budgeted_revenue_inr", "total_budgeted_revenue"),
              dbl_sum("actual_revenue_inr", "total_actual_revenue"),
              dbl_sum("revenue_variance_inr", "total_revenue_variance"),
              dbl_avg("revenue_variance_pct", "avg_revenue_variance_pct", 2),
              dbl_sum("budgeted_opex_inr", "total_budgeted_opex"),
              dbl_sum("actual_opex_inr", "total_actual_opex"),
              dbl_sum("opex_variance_inr", "total_opex_variance"),
              F.sum("budgeted_ebitda_inr").alias("_be"), F.sum("actual_ebitda_inr").alias("_ae")))
    return g.select("*", out_double(F.round("_be", 0)).alias("total_budgeted_ebitda"),
                    out_double(F.round("_ae", 0)).alias("total_actual_ebitda"),
                    out_double(pct(F.col("_ae") - F.col("_be"), F.abs("_be"))).alias("ebitda_variance_pct")
                    ).drop("_be", "_ae").orderBy("fiscal_year")


def prf_department_pnl(star: Star) -> DataFrame:
    g = (star["fact_budget_vs_actual"].groupBy("department")
         .agg(F.sum("budgeted_revenue_inr").alias("_br"), F.sum("actual_revenue_inr").alias("_ar"),
              dbl_sum("revenue_variance_inr", "total_revenue_variance"),
              dbl_avg("revenue_variance_pct", "avg_revenue_variance_pct", 2),
              dbl_sum("actual_opex_inr", "total_actual_opex"),
              F.sum("actual_ebitda_inr").alias("_ae")))
    return g.select("department", out_double(F.round("_br", 0)).alias("total_budgeted_revenue"),
                    out_double(F.round("_ar", 0)).alias("total_actual_revenue"),
                    "total_revenue_variance", "avg_revenue_variance_pct", "total_actual_opex",
                    out_double(F.round("_ae", 0)).alias("total_actual_ebitda"),
                    out_double(pct("_ae", "_ar")).alias("ebitda_margin_pct"),
                    out_double(pct("_ar", "_br")).alias("budget_attainment_pct")
                    ).orderBy(F.col("total_actual_revenue").desc())


def performance_flag(avg_pct: Column) -> Column:
    e = None
    for cut, label in FLAG_CUTOFFS:
        e = F.when(avg_pct < cut, label) if e is None else e.when(avg_pct < cut, label)
    return e.otherwise(FLAG_REST)


def prf_monthly_variance(star: Star) -> DataFrame:
    g = (star["fact_budget_vs_actual"]
         .groupBy(F.col("fiscal_year").cast("int").alias("fiscal_year"), "fiscal_quarter",
                  "month_label", "date_key")
         .agg(dbl_sum("budgeted_revenue_inr", "budgeted_revenue"),
              dbl_sum("actual_revenue_inr", "actual_revenue"),
              dbl_sum("revenue_variance_inr", "revenue_variance"),
              F.avg("revenue_variance_pct").alias("_v"),
              dbl_sum("actual_ebitda_inr", "actual_ebitda")))
    return g.select("fiscal_year", "fiscal_quarter", "month_label", "budgeted_revenue", "actual_revenue",
                    "revenue_variance", out_double(F.round("_v", 2)).alias("variance_pct"),
                    "actual_ebitda", performance_flag(F.col("_v")).alias("performance_flag"),
                    "date_key").orderBy("date_key").drop("date_key")


def prf_missed_budget(star: Star) -> DataFrame:
    v = F.col("revenue_variance_pct")
    g = (star["fact_budget_vs_actual"].groupBy("department")
         .agg(n_rows("total_months"),
              F.sum(F.when(v < 0, 1).otherwise(0)).alias("months_below_budget"),
              F.sum(F.when(v >= 0, 1).otherwise(0)).alias("months_above_budget"),
              dbl_avg("revenue_variance_pct", "avg_variance_pct", 2),
              out_double(F.round(F.min(v), 2)).alias("worst_month_pct"),
              out_double(F.round(F.max(v), 2)).alias("best_month_pct")))
    return g.select("department", "total_months", "months_below_budget", "months_above_budget",
                    out_double(pct("months_below_budget", "total_months", 1, 0)).alias("pct_months_missed"),
                    "avg_variance_pct", "worst_month_pct", "best_month_pct"
                    ).orderBy(F.col("pct_months_missed").desc())


def prf_headcount(star: Star) -> DataFrame:
    g = (star["fact_budget_vs_actual"]
         .groupBy("department", F.col("fiscal_year").cast("int").alias("fiscal_year"))
         .agg(F.avg(F.col("headcount_budget").cast(D(10, 0))).alias("_hb"),
              F.avg(F.col("headcount_actual").cast(D(10, 0))).alias("_ha"),
              F.sum("actual_revenue_inr").alias("_rev")))
    per_head = F.round(quotient("_rev", F.nullif(F.col("_ha"), F.lit(0)), 4), 0)
    return g.select("department", "fiscal_year",
                    out_double(F.round("_hb", 0)).alias("avg_budgeted_headcount"),
                    out_double(F.round("_ha", 0)).alias("avg_actual_headcount"),
                    out_double(F.round(F.col("_ha") - F.col("_hb"), 1)).alias("headcount_variance"),
                    out_double(F.round("_rev", 0)).alias("total_revenue"),
                    out_double(per_head).alias("revenue_per_head_inr")
                    ).orderBy("department", "fiscal_year")


def prf_scorecard(star: Star) -> DataFrame:
    """13-KPI dashboard: one pass with conditional aggregates per table, then
    a cross join of the one-row results."""
    active = F.col("is_active") == 1
    t = star["fact_transactions"].agg(
        F.sum("revenue_inr").alias("_rev"), F.sum("gross_profit_inr").alias("_gp"),
        F.avg("gross_margin_pct").alias("_m"))
    c = star["dim_customers"].agg(
        F.sum(F.when(active, F.col("mrr_inr"))).alias("_mrr"),
        F.sum(F.when(active, F.col("arr_inr"))).alias("_arr"),
        F.count_if(active).alias("active_customers"),
        F.avg(F.when(active, F.col("mrr_inr"))).alias("_amrr"),
        F.count(F.lit(1)).alias("_all"),
        F.count_if(active & (F.col("health_status") == "Critical")).alias("critical_health_customers"),
        F.count_if(active & (F.col("health_status") == "At Risk")).alias("at_risk_customers"))
    ch = star["fact_churn"].agg(F.count(F.lit(1)).alias("_churned"),
                                F.sum("mrr_at_churn_inr").alias("_lost"),
                                F.avg(F.col("days_to_churn").cast(D(20, 0))).alias("_days"))
    b = star["fact_budget_vs_actual"].agg(F.avg("revenue_variance_pct").alias("_bv"))
    j = t.crossJoin(c).crossJoin(ch).crossJoin(b)
    return j.select(
        out_double(F.round("_rev", 0)).alias("total_revenue_inr"),
        out_double(F.round("_gp", 0)).alias("total_gross_profit_inr"),
        out_double(F.round("_m", 2)).alias("avg_gross_margin_pct"),
        out_double(F.round("_mrr", 0)).alias("current_total_mrr"),
        out_double(F.round("_arr", 0)).alias("current_total_arr"),
        "active_customers",
        out_double(F.round("_amrr", 0)).alias("avg_mrr_per_customer"),
        out_double(pct("_churned", "_all", 2, 0)).alias("overall_churn_rate_pct"),
        out_double(F.round("_lost", 0)).alias("total_mrr_lost_to_churn"),
        out_double(F.round("_days", 0)).alias("avg_days_to_churn"),
        "critical_health_customers", "at_risk_customers",
        out_double(F.round("_bv", 2)).alias("avg_budget_variance_pct"))
