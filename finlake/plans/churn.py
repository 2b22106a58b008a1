"""Churn and retention: KPIs, churn by dimension, cohorts, risk, NRR."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from finlake.functions.exact import out_double, pct, quotient
from finlake.operators.windows import moving_avg, with_share
from finlake.plans._common import Star, dates, dbl_avg, dbl_sum, n_rows

D = DecimalType

# ---- fixed values: days-to-churn buckets (upper bound inclusive, label) ----
CHURN_BUCKETS = [(90, "0-90 days (Early Churn)"), (180, "91-180 days"),
                 (365, "181-365 days (Year 1)"), (540, "366-540 days (Year 1-2)")]
CHURN_BUCKET_REST = "540+ days (Long-term)"
# composite risk score weights (health, login recency, tickets, NPS)
RISK_WEIGHTS = ("0.40", "0.25", "0.20", "0.15")


def _customer_totals(star: Star) -> DataFrame:
    """One-row frame: all customers, active customers, total MRR."""
    return star["dim_customers"].agg(
        F.count(F.lit(1)).alias("_all_customers"),
        F.count_if(F.col("is_active") == 1).alias("_active_customers"),
        F.sum("mrr_inr").alias("_all_mrr"))


def chn_summary(star: Star) -> DataFrame:
    ch = star["fact_churn"].agg(F.count(F.lit(1)).alias("_churned"),
                                F.sum("mrr_at_churn_inr").alias("_lost"),
                                F.avg(F.col("days_to_churn").cast(D(20, 0))).alias("_days"))
    j = _customer_totals(star).crossJoin(ch)
    return j.select(
        F.col("_all_customers").alias("total_customers"),
        F.col("_churned").alias("total_churned"),
        F.col("_active_customers").alias("active_customers"),
        out_double(pct("_churned", "_all_customers", 2, 0)).alias("overall_churn_rate_pct"),
        out_double(pct("_lost", "_all_mrr")).alias("mrr_churn_rate_pct"),
        out_double(F.round("_lost", 0)).alias("total_mrr_lost_inr"),
        out_double(F.round("_days", 0)).alias("avg_days_to_churn"))


def _churn_metrics(*extra: Column) -> list[Column]:
    return [F.count("churn_key").alias("_n"), F.sum("mrr_at_churn_inr").alias("_lost"), *extra]


def chn_annual(star: Star) -> DataFrame:
    """Churn by year; the rate's denominator is all customers ever (as in
    the reference, despite its comment)."""
    j = star["fact_churn"].join(dates(star, "fiscal_year").withColumnRenamed("date_key", "churn_date_key"),
                                "churn_date_key")
    g = (j.groupBy(F.col("fiscal_year").cast("int").alias("fiscal_year"))
         .agg(F.count("churn_key").alias("churned_customers"),
              dbl_sum("mrr_at_churn_inr", "mrr_lost_inr"),
              dbl_avg("days_to_churn", "avg_days_to_churn", 0, int_input=True),
              dbl_avg("last_health_score", "avg_health_score_at_churn", 1)))
    g = g.crossJoin(F.broadcast(_customer_totals(star).select("_all_customers")))
    return g.select("fiscal_year", "churned_customers", "mrr_lost_inr", "avg_days_to_churn",
                    "avg_health_score_at_churn",
                    out_double(pct("churned_customers", "_all_customers", 2, 0)).alias("churn_rate_pct")
                    ).orderBy("fiscal_year")


def chn_monthly(star: Star) -> DataFrame:
    d = dates(star, "fiscal_year", "month_num", "fiscal_month_label").withColumnRenamed("date_key", "churn_date_key")
    g = (star["fact_churn"].join(d, "churn_date_key")
         .groupBy(F.col("fiscal_year").cast("int").alias("fiscal_year"),
                  F.col("month_num").cast("int").alias("month_num"),
                  F.col("fiscal_month_label").alias("churn_month"))
         .agg(F.count("churn_key").alias("churned_customers"),
              dbl_sum("mrr_at_churn_inr", "mrr_lost_inr")))
    roll = moving_avg(F.col("churned_customers").cast(D(20, 0)), ["fiscal_year", "month_num"], 3)
    return g.select("fiscal_year", "month_num", "churn_month", "churned_customers", "mrr_lost_inr",
                    out_double(F.round(roll, 1)).alias("rolling_3m_avg_churn")
                    ).orderBy("fiscal_year", "month_num")


def _churn_by(star: Star, key: str, rate_name: str, cols: list[Column], out: list[str]) -> DataFrame:
    """Churn metrics per value of ``key`` with the rate against the customers
    holding that value.  The reference's correlated subquery becomes a
    per-key customer count joined on the (low-cardinality) key."""
    g = star["fact_churn"].groupBy(key).agg(F.count("churn_key").alias("churned_customers"), *cols)
    base = star["dim_customers"].groupBy(key).agg(F.count(F.lit(1)).alias("_base"))
    j = g.join(base, on=key, how="left")
    return j.select(key, "churned_customers", *out,
                    out_double(pct("churned_customers", "_base", 2, 0)).alias(rate_name)
                    ).orderBy(F.col("total_mrr_lost").desc())


def chn_by_plan(star: Star) -> DataFrame:
    return _churn_by(star, "plan", "plan_churn_rate_pct",
                     [dbl_sum("mrr_at_churn_inr", "total_mrr_lost"),
                      dbl_avg("mrr_at_churn_inr", "avg_mrr_at_churn", 0),
                      dbl_avg("days_to_churn", "avg_days_to_churn", 0, int_input=True),
                      dbl_avg("last_health_score", "avg_health_score", 1)],
                     ["total_mrr_lost", "avg_mrr_at_churn", "avg_days_to_churn", "avg_health_score"])


def chn_by_segment(star: Star) -> DataFrame:
    return _churn_by(star, "segment", "segment_churn_rate_pct",
                     [dbl_sum("mrr_at_churn_inr", "total_mrr_lost"),
                      dbl_avg("days_to_churn", "avg_days_to_churn", 0, int_input=True),
                      dbl_avg("last_health_score", "avg_last_health_score", 1)],
                     ["total_mrr_lost", "avg_days_to_churn", "avg_last_health_score"])


def chn_by_region(star: Star) -> DataFrame:
    return _churn_by(star, "region", "region_churn_rate_pct",
                     [dbl_sum("mrr_at_churn_inr", "total_mrr_lost"),
                      dbl_avg("days_to_churn", "avg_days_to_churn", 0, int_input=True)],
                     ["total_mrr_lost", "avg_days_to_churn"])


def chn_by_reason_type(star: Star) -> DataFrame:
    g = (star["fact_churn"].groupBy("churn_reason", "churn_type")
         .agg(F.count("churn_key").alias("churned_customers"),
              dbl_sum("mrr_at_churn_inr", "total_mrr_lost"),
              dbl_avg("mrr_at_churn_inr", "avg_mrr_at_churn", 0),
              dbl_avg("days_to_churn", "avg_days_to_churn", 0, int_input=True),
              dbl_avg("last_health_score", "avg_last_health_score", 1),
              F.sum(F.col("win_back_eligible").cast("long")).alias("win_back_eligible_count")))
    return g.orderBy(F.col("total_mrr_lost").desc())


def chn_voluntary_share(star: Star) -> DataFrame:
    g = (star["fact_churn"].groupBy("churn_type")
         .agg(n_rows("churned_customers"), dbl_sum("mrr_at_churn_inr", "total_mrr_lost"),
              dbl_avg("days_to_churn", "avg_days_to_churn", 0, int_input=True)))
    g = with_share(g, "churned_customers", "_s", 2, 0)
    return g.select("churn_type", "churned_customers", "total_mrr_lost", "avg_days_to_churn",
                    out_double("_s").alias("share_pct"))


def _cohort(c: Column) -> Column:
    return F.concat(F.year(c).cast("string"), F.lit("-Q"), F.quarter(c).cast("string"))


def chn_cohort_size(star: Star) -> DataFrame:
    g = (star["dim_customers"].groupBy(_cohort(F.col("acquisition_date")).alias("acquisition_cohort"))
         .agg(n_rows("cohort_size"), dbl_sum("mrr_inr", "cohort_mrr"), dbl_avg("mrr_inr", "avg_mrr", 0)))
    return g.orderBy("acquisition_cohort")


def chn_cohort_retention(star: Star) -> DataFrame:
    """Acquisition-quarter cohorts with churned/retained counts and MRR.
    A cohort without churn keeps NULL churned MRR (and retained MRR)."""
    cb = star["dim_customers"].select("customer_key", _cohort(F.col("acquisition_date")).alias("acq_cohort"),
                                      "mrr_inr")
    ch = star["fact_churn"].select(F.col("customer_key").alias("_ck"), "churn_key", "mrr_at_churn_inr",
                                   "days_to_churn")
    j = cb.join(ch, cb["customer_key"] == ch["_ck"], "left")
    g = (j.groupBy("acq_cohort")
         .agg(F.count("customer_key").alias("cohort_size"),
              F.round(F.sum("mrr_inr"), 0).alias("_start"),
              F.count("churn_key").alias("churned_count"),
              F.round(F.sum("mrr_at_churn_inr"), 0).alias("_churned"),
              F.round(F.avg(F.col("days_to_churn").cast(D(20, 0))), 0).alias("_days")))
    retained = F.col("cohort_size") - F.col("churned_count")
    return g.select(
        "acq_cohort", "cohort_size", out_double("_start").alias("cohort_starting_mrr"), "churned_count",
        retained.alias("retained_count"), out_double("_churned").alias("mrr_churned"),
        out_double(F.col("_start") - F.col("_churned")).alias("retained_mrr"),
        out_double(pct("churned_count", "cohort_size", 2, 0)).alias("cohort_churn_rate_pct"),
        out_double(pct(retained, "cohort_size", 2, 0)).alias("cohort_retention_rate_pct"),
        out_double("_days").alias("avg_days_to_churn")).orderBy("acq_cohort")


def churn_bucket(days: Column) -> Column:
    e = None
    for hi, label in CHURN_BUCKETS:
        e = F.when(days <= hi, label) if e is None else e.when(days <= hi, label)
    return e.otherwise(CHURN_BUCKET_REST)


def chn_days_buckets(star: Star) -> DataFrame:
    g = (star["fact_churn"].groupBy(churn_bucket(F.col("days_to_churn")).alias("churn_bucket"))
         .agg(n_rows("customers"), dbl_sum("mrr_at_churn_inr", "mrr_lost"),
              dbl_avg("mrr_at_churn_inr", "avg_mrr_at_churn", 0),
              dbl_avg("last_health_score", "avg_health_score", 1),
              F.min("days_to_churn").alias("_min_days")))
    return g.orderBy("_min_days").drop("_min_days")


def _greatest0(x: Column) -> Column:
    """GREATEST(0, x) that stays NULL when x is NULL (SQL-standard rule)."""
    return F.when(x.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(0), x))


def composite_risk_score(c: DataFrame | None = None) -> Column:
    w = [F.lit(v).cast(D(3, 2)) for v in RISK_WEIGHTS]
    health = F.col("health_score") * w[0]
    login = _greatest0(F.lit(100) - F.col("last_login_days_ago").cast("int")) * w[1]
    tickets = _greatest0(F.lit(100) - F.col("support_tickets_90d").cast("int") * 8) * w[2]
    nps = _greatest0((F.col("nps_score").cast(D(10, 0)) + 100) / F.lit(2).cast(D(10, 0))) * w[3]
    return F.round(health + login + tickets + nps, 1)


def risk_category() -> Column:
    hs, st = F.col("health_score"), F.col("health_status")
    return (F.when(st == "Critical", "HIGH RISK")
            .when((st == "At Risk") & (F.col("last_login_days_ago") > 30), "HIGH RISK")
            .when(st == "At Risk", "MEDIUM RISK")
            .when(hs < 50, "MEDIUM RISK")
            .otherwise("LOW RISK"))


def chn_at_risk_top50(star: Star, k: int = 50) -> DataFrame:
    """k most at-risk active customers (lowest composite score); ties broken
    by customer_id.  orderBy+limit plans as a distributed top-k."""
    c = star["dim_customers"].filter(F.col("is_active") == 1)
    out = c.select(
        "customer_id", "company_name", "plan", "segment", "region", "health_status",
        out_double("health_score").alias("health_score"), out_double("mrr_inr").alias("mrr_inr"),
        F.col("last_login_days_ago").cast("int").alias("last_login_days_ago"),
        F.col("support_tickets_90d").cast("int").alias("support_tickets_90d"),
        F.col("nps_score").cast("int").alias("nps_score"),
        composite_risk_score().alias("_score"), risk_category().alias("risk_category"))
    top = out.orderBy(F.col("_score").asc_nulls_last(), F.col("customer_id")).limit(k)
    return top.withColumn("composite_risk_score", out_double("_score")).select(
        "customer_id", "company_name", "plan", "segment", "region", "health_status", "health_score",
        "mrr_inr", "last_login_days_ago", "support_tickets_90d", "nps_score", "composite_risk_score",
        "risk_category")


def chn_risk_by_plan(star: Star) -> DataFrame:
    c = star["dim_customers"].filter(F.col("is_active") == 1)
    st = F.col("health_status")
    risky = st.isin("Critical", "At Risk")
    g = (c.groupBy("plan")
         .agg(F.count(F.when(st == "Critical", 1)).alias("critical_count"),
              F.count(F.when(st == "At Risk", 1)).alias("at_risk_count"),
              F.count(F.when(st == "Healthy", 1)).alias("healthy_count"),
              n_rows("total_customers"),
              out_double(F.round(F.sum(F.when(risky, F.col("mrr_inr")).otherwise(F.lit(0))), 0))
              .alias("mrr_at_risk_inr"),
              F.count(F.when(risky, 1)).alias("_risky")))
    return g.select("plan", "critical_count", "at_risk_count", "healthy_count", "total_customers",
                    "mrr_at_risk_inr",
                    out_double(pct("_risky", "total_customers", 2, 0)).alias("pct_at_risk")
                    ).orderBy(F.col("mrr_at_risk_inr").desc())


def chn_win_back(star: Star) -> DataFrame:
    g = (star["fact_churn"].filter(F.col("win_back_eligible") == 1)
         .groupBy("plan", "segment", "churn_reason")
         .agg(n_rows("win_back_candidates"), dbl_sum("mrr_at_churn_inr", "recoverable_mrr"),
              dbl_avg("days_to_churn", "avg_days_to_churn", 0, int_input=True)))
    return g.orderBy(F.col("recoverable_mrr").desc())


def chn_nrr(star: Star, base_num: int = 1200, base_den: int = 1410,
            expansion_rate: str = "0.08") -> DataFrame:
    """Net revenue retention approximation with the reference's constants
    (beginning MRR = current x 1200/1410, expansion = 8 % of current)."""
    m = (star["dim_customers"].filter(F.col("is_active") == 1)
         .agg(F.sum("mrr_inr").alias("_mrr")))
    m = m.select(F.round(quotient(F.col("_mrr") * base_num, F.lit(base_den)), 0).alias("b"),
                 F.round(F.col("_mrr") * F.lit(expansion_rate).cast(D(4, 2)), 0).alias("e"))
    c = star["fact_churn"].agg(F.round(F.sum("mrr_at_churn_inr"), 0).alias("c"))
    j = m.crossJoin(c)
    ending = F.col("b") + F.col("e") - F.col("c")
    return j.select(out_double("b").alias("beginning_mrr"), out_double("e").alias("expansion_mrr"),
                    out_double("c").alias("churned_mrr"), out_double(ending).alias("ending_mrr"),
                    out_double(pct(ending, "b", 2, 0)).alias("nrr_pct"))
