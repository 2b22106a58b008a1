"""Data-quality suite: nulls, duplicates, referential integrity, business
rules, distributions, scorecard."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlake.functions.exact import out_double
from finlake.operators.quality import duplicate_keys, null_counts, orphans, rule_counts
from finlake.operators.topk import top_k_through_join
from finlake.plans._common import Star, dbl_avg, dbl_sum, n_rows
from finlake.plans.revenue import rev_by_product_line

TOLERANCE = 1  # currency units allowed for recomputed amounts


def dq_nulls_customers(star: Star) -> DataFrame:
    return null_counts(star["dim_customers"], {
        "null_customer_id": "customer_id", "null_company_name": "company_name", "null_plan": "plan",
        "null_segment": "segment", "null_acquisition_date": "acquisition_date", "null_mrr": "mrr_inr",
        "null_health_score": "health_score", "null_csm_owner": "csm_owner"})


def dq_nulls_transactions(star: Star) -> DataFrame:
    return null_counts(star["fact_transactions"], {
        "null_txn_id": "transaction_id", "null_customer_key": "customer_key", "null_date_key": "date_key",
        "null_revenue": "revenue_inr", "null_cogs": "cogs_inr", "null_gross_profit": "gross_profit_inr",
        "null_payment_status": "payment_status"})


def dq_nulls_churn(star: Star) -> DataFrame:
    return null_counts(star["fact_churn"], {
        "null_customer_key": "customer_key", "null_churn_date": "churn_date_key",
        "null_mrr_at_churn": "mrr_at_churn_inr", "null_churn_reason": "churn_reason",
        "null_days_to_churn": "days_to_churn"})


def dq_dup_customers(star: Star) -> DataFrame:
    return duplicate_keys(star["dim_customers"], ["customer_id"])


def dq_dup_transactions(star: Star) -> DataFrame:
    return duplicate_keys(star["fact_transactions"], ["transaction_id"])


def dq_dup_churn(star: Star) -> DataFrame:
    return duplicate_keys(star["fact_churn"], ["customer_key"])


def dq_dup_budget(star: Star) -> DataFrame:
    return duplicate_keys(star["fact_budget_vs_actual"], ["date_key", "department"])


def _dates(star: Star) -> DataFrame:
    """The calendar that facts refer to: the loaded one, where it is cut."""
    return star.get("dim_date_loaded", star["dim_date"])


def dq_orphan_txn_dates(star: Star) -> DataFrame:
    return orphans(star["fact_transactions"], "date_key", _dates(star), "date_key", "orphan_txn_dates")


def dq_orphan_churn_dates(star: Star) -> DataFrame:
    return orphans(star["fact_churn"], "churn_date_key", _dates(star), "date_key", "orphan_churn_dates")


def dq_orphan_budget_dates(star: Star) -> DataFrame:
    return orphans(star["fact_budget_vs_actual"], "date_key", _dates(star), "date_key",
                   "orphan_budget_dates")


# ---- business rules, grouped per table so a full check is one pass each ----
def transaction_rules(tol: int = TOLERANCE) -> dict:
    rev, cogs, gp = F.col("revenue_inr"), F.col("cogs_inr"), F.col("gross_profit_inr")
    return {"negative_revenue_rows": rev <= 0,
            "cogs_exceeds_revenue": cogs > rev,
            "gross_profit_mismatch": F.abs(gp - (rev - cogs)) > tol}


def customer_rules(tol: int = TOLERANCE) -> dict:
    return {"arr_mrr_mismatch": F.abs(F.col("arr_inr") - F.col("mrr_inr") * 12) > tol,
            "invalid_health_scores": (F.col("health_score") < 0) | (F.col("health_score") > 100),
            "invalid_nps": (F.col("nps_score") < -100) | (F.col("nps_score") > 100)}


def churn_rules() -> dict:
    return {"invalid_days_to_churn": F.col("days_to_churn") <= 0}


def budget_rules(tol: int = TOLERANCE) -> dict:
    return {"variance_mismatch": F.abs(F.col("revenue_variance_inr")
                                       - (F.col("actual_revenue_inr") - F.col("budgeted_revenue_inr"))) > tol}


def _one(df: DataFrame, rules: dict, name: str) -> DataFrame:
    return rule_counts(df, {name: rules[name]})


def dq_nonpositive_revenue(star: Star) -> DataFrame:
    return _one(star["fact_transactions"], transaction_rules(), "negative_revenue_rows")


def dq_cogs_exceeds_revenue(star: Star) -> DataFrame:
    return _one(star["fact_transactions"], transaction_rules(), "cogs_exceeds_revenue")


def dq_gross_profit_mismatch(star: Star, tolerance: int = TOLERANCE) -> DataFrame:
    return _one(star["fact_transactions"], transaction_rules(tolerance), "gross_profit_mismatch")


def dq_arr_mrr_mismatch(star: Star, tolerance: int = TOLERANCE) -> DataFrame:
    return _one(star["dim_customers"], customer_rules(tolerance), "arr_mrr_mismatch")


def dq_health_range(star: Star) -> DataFrame:
    return _one(star["dim_customers"], customer_rules(), "invalid_health_scores")


def dq_nps_range(star: Star) -> DataFrame:
    return _one(star["dim_customers"], customer_rules(), "invalid_nps")


def dq_days_to_churn(star: Star) -> DataFrame:
    return _one(star["fact_churn"], churn_rules(), "invalid_days_to_churn")


def dq_variance_mismatch(star: Star, tolerance: int = TOLERANCE) -> DataFrame:
    return _one(star["fact_budget_vs_actual"], budget_rules(tolerance), "variance_mismatch")


def dq_churn_before_acq(star: Star) -> DataFrame:
    """Churn dated on/before acquisition.  The customer join only filters (and
    multiplies by duplicate customer rows), so customers are reduced to a
    key multiplicity first.  The calendar joins stay: dates that are in no
    calendar cannot be compared."""
    mult = star["dim_customers"].groupBy("customer_key").agg(F.count(F.lit(1)).alias("_mult"))
    d = star["dim_date"].select("date_key", "full_date")
    acq = d.select(F.col("date_key").alias("_ak"), F.col("full_date").alias("_acq"))
    chd = d.select(F.col("date_key").alias("_ck"), F.col("full_date").alias("_chd"))
    ch = star["fact_churn"].select("customer_key", "acquisition_date_key", "churn_date_key")
    j = (ch.join(acq, F.col("acquisition_date_key") == F.col("_ak"))
         .join(chd, F.col("churn_date_key") == F.col("_ck"))
         .filter(F.col("_chd") <= F.col("_acq"))
         .join(mult, "customer_key"))
    return j.agg(F.coalesce(F.sum("_mult"), F.lit(0)).cast("long").alias("churn_before_acquisition"))


def dq_mrr_by_plan(star: Star) -> DataFrame:
    g = (star["dim_customers"].groupBy("plan")
         .agg(n_rows("customer_count"), out_double(F.round(F.min("mrr_inr"), 0)).alias("min_mrr"),
              dbl_avg("mrr_inr", "avg_mrr", 0), out_double(F.round(F.max("mrr_inr"), 0)).alias("max_mrr"),
              dbl_sum("mrr_inr", "total_mrr"),
              out_double(F.round(F.sum("mrr_inr") * 12, 0)).alias("total_arr")))
    return g.orderBy("avg_mrr")


def dq_revenue_by_line(star: Star) -> DataFrame:
    return rev_by_product_line(star)


def dq_churn_by_reason(star: Star) -> DataFrame:
    g = (star["fact_churn"].groupBy("churn_reason")
         .agg(n_rows("churned_customers"), dbl_sum("mrr_at_churn_inr", "total_mrr_lost"),
              dbl_avg("days_to_churn", "avg_days_to_churn", 0, int_input=True),
              dbl_avg("last_health_score", "avg_last_health_score", 1)))
    return g.orderBy(F.col("total_mrr_lost").desc())


def dq_revenue_outliers(star: Star, k: int = 10) -> DataFrame:
    """Top-k transactions by revenue (NULLs last, ties by id and the other
    output columns).  Only the fact rows that can reach the top k are joined
    to the customer dimension (see operators.topk)."""
    c = star["dim_customers"].select("customer_key", "company_name")
    p = star["dim_product"].select("product_key", "category", "product_line")
    t = star["fact_transactions"].select("transaction_id", "customer_key", "product_key", "fiscal_year",
                                         "revenue_inr", "gross_margin_pct")

    def join(f):
        j = f.join(c, "customer_key").join(p, "product_key")
        return j.select("transaction_id", "company_name", "category", "product_line",
                        F.col("fiscal_year").cast("int").alias("fiscal_year"),
                        F.col("revenue_inr").alias("_rev"),
                        out_double(F.round("gross_margin_pct", 2)).alias("gross_margin_pct"))

    order = [F.col("_rev").desc_nulls_last(), F.col("transaction_id").asc_nulls_last(),
             F.col("company_name").asc_nulls_last(), F.col("category").asc_nulls_last(),
             F.col("product_line").asc_nulls_last(), F.col("fiscal_year").asc_nulls_last(),
             F.col("gross_margin_pct").asc_nulls_last()]
    top = top_k_through_join(t, "revenue_inr", k, join, order)
    return top.select("transaction_id", "company_name", "category", "product_line", "fiscal_year",
                      out_double(F.round("_rev", 2)).alias("revenue_inr"), "gross_margin_pct")


def dq_high_tickets(star: Star, min_tickets: int = 10) -> DataFrame:
    c = star["dim_customers"].filter(F.col("support_tickets_90d") >= min_tickets)
    return c.select("customer_id", "company_name", "plan", "health_status",
                    F.col("support_tickets_90d").cast("int").alias("support_tickets_90d"),
                    out_double("health_score").alias("health_score")
                    ).orderBy(F.col("support_tickets_90d").desc())


def dq_scorecard(star: Star) -> DataFrame:
    """table, rows, critical NULLs, duplicate keys: each table is read once --
    rows and NULLs are counted per natural key, and the keys' counts are summed."""
    def row(name: str, critical, keys):
        df = star[name].withColumn("_critical", F.when(critical, 1).otherwise(0))
        if keys:
            df = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.sum("_critical").alias("_critical"))
        else:
            df = df.select(F.lit(1).alias("_rows"), "_critical")
        duplicates = F.count_if(F.col("_rows") > 1) if keys else F.lit(0)
        return df.agg(F.coalesce(F.sum("_rows"), F.lit(0)).cast("long").alias("total_rows"),
                      F.sum("_critical").cast("long").alias("critical_nulls"),
                      duplicates.cast("long").alias("duplicates")).select(F.lit(name).alias("table_name"), "*")

    rev = F.col("revenue_inr")
    rows = [
        row("dim_customers", F.col("acquisition_date").isNull(), None),
        row("fact_transactions", rev.isNull() | (rev <= 0), ["transaction_id"]),
        row("fact_churn", F.col("churn_date_key").isNull(), ["customer_key"]),
        row("fact_budget_vs_actual", F.col("actual_revenue_inr").isNull(), ["date_key", "department"]),
    ]
    return reduce(DataFrame.unionByName, rows)
