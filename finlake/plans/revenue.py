"""Revenue analysis: totals, growth, MRR/ARR, segmentation, forecasting base,
collections."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from finlake.functions.exact import out_double, pct, quotient
from finlake.operators.histogram import tile_sums
from finlake.operators.ranking import with_prefix_sum
from finlake.operators.windows import lag_growth_pct, moving_avg, running_total, with_share
from finlake.plans._common import Star, dates, dbl_avg, dbl_sum, n_distinct, n_rows, products

D = DecimalType


def rev_kpis(star: Star, exact: bool = True) -> DataFrame:
    """Overall revenue KPIs in one pass over the fact."""
    t = star["fact_transactions"]
    g = t.agg(F.sum("revenue_inr").alias("rev"), F.sum("cogs_inr").alias("cogs"),
              F.sum("gross_profit_inr").alias("gp"),
              F.avg("gross_margin_pct").alias("m"),
              n_distinct("transaction_id", "total_transactions", exact),
              n_distinct("customer_key", "unique_customers_billed", exact))
    return g.select(
        out_double(F.round("rev", 0)).alias("total_revenue_inr"),
        out_double(F.round("cogs", 0)).alias("total_cogs_inr"),
        out_double(F.round("gp", 0)).alias("total_gross_profit_inr"),
        out_double(F.round("m", 2)).alias("avg_gross_margin_pct"),
        "total_transactions", "unique_customers_billed",
        out_double(F.round(quotient("rev", "unique_customers_billed"), 0))
        .alias("avg_revenue_per_customer"))


def rev_annual_yoy(star: Star, exact: bool = True) -> DataFrame:
    t = star["fact_transactions"]
    g = (t.groupBy(F.col("fiscal_year").cast("int").alias("fiscal_year"))
         .agg(F.sum("revenue_inr").alias("_rev"),
              dbl_sum("gross_profit_inr", "total_gross_profit_inr"),
              dbl_avg("gross_margin_pct", "avg_gross_margin_pct", 2),
              n_distinct("transaction_id", "total_transactions", exact),
              n_distinct("customer_key", "unique_customers", exact)))
    return g.select(
        "fiscal_year", out_double(F.round("_rev", 0)).alias("total_revenue_inr"),
        "total_gross_profit_inr", "avg_gross_margin_pct", "total_transactions",
        "unique_customers",
        out_double(lag_growth_pct("_rev", ["fiscal_year"])).alias("yoy_revenue_growth_pct"),
    ).orderBy("fiscal_year")


def rev_quarterly_qoq(star: Star) -> DataFrame:
    t = star["fact_transactions"]
    g = (t.groupBy(F.col("fiscal_year").cast("int").alias("fiscal_year"), "fiscal_quarter")
         .agg(F.sum("revenue_inr").alias("_rev"),
              dbl_sum("gross_profit_inr", "quarterly_gross_profit"),
              dbl_avg("gross_margin_pct", "avg_gross_margin_pct", 2),
              n_distinct("customer_key", "unique_customers")))
    return g.select(
        "fiscal_year", "fiscal_quarter",
        F.concat(F.col("fiscal_year").cast("string"), F.lit("-"), "fiscal_quarter").alias("year_quarter"),
        out_double(F.round("_rev", 0)).alias("quarterly_revenue"),
        "quarterly_gross_profit", "avg_gross_margin_pct", "unique_customers",
        out_double(lag_growth_pct("_rev", ["fiscal_year", "fiscal_quarter"])).alias("qoq_growth_pct"),
    ).orderBy("fiscal_year", "fiscal_quarter")


def rev_monthly_ytd_mom(star: Star) -> DataFrame:
    """Monthly revenue with a year-to-date running total (restarts each year)
    and month-over-month growth (runs across years)."""
    t = star["fact_transactions"].join(dates(star, "month_num"), "date_key")
    g = (t.groupBy(F.col("fiscal_year").cast("int").alias("fiscal_year"), "fiscal_month",
                   F.col("month_num").cast("int").alias("month_num"))
         .agg(F.sum("revenue_inr").alias("_rev"), F.sum("gross_profit_inr").alias("_gp")))
    return g.select(
        "fiscal_year", "fiscal_month", "month_num",
        out_double(F.round("_rev", 0)).alias("monthly_revenue"),
        out_double(F.round("_gp", 0)).alias("monthly_gross_profit"),
        out_double(F.round(running_total("_rev", ["fiscal_year"], ["month_num"]), 0)).alias("ytd_revenue"),
        out_double(lag_growth_pct("_rev", ["fiscal_year", "month_num"])).alias("mom_growth_pct"),
    ).orderBy("fiscal_year", "month_num")


def _active(star: Star) -> DataFrame:
    return star["dim_customers"].filter(F.col("is_active") == 1)


def rev_mrr_by_plan(star: Star) -> DataFrame:
    g = (_active(star).groupBy("plan")
         .agg(n_rows("customer_count"), F.sum("mrr_inr").alias("_mrr"),
              dbl_sum("arr_inr", "total_arr_inr"), dbl_avg("mrr_inr", "avg_mrr_per_customer", 0)))
    g = with_share(g, "_mrr", "_share")
    return g.select("plan", "customer_count", out_double(F.round("_mrr", 0)).alias("total_mrr_inr"),
                    "total_arr_inr", "avg_mrr_per_customer",
                    out_double("_share").alias("mrr_contribution_pct")
                    ).orderBy(F.col("total_mrr_inr").desc())


def rev_mrr_segment_region(star: Star) -> DataFrame:
    from finlake.functions.enums import enum_rank
    from finlake.schemas import SEGMENTS
    g = (_active(star).groupBy("segment", "region")
         .agg(n_rows("customer_count"), dbl_sum("mrr_inr", "total_mrr"),
              dbl_avg("mrr_inr", "avg_mrr", 0), dbl_sum("arr_inr", "total_arr")))
    return g.orderBy(enum_rank("segment", SEGMENTS), F.col("total_mrr").desc())


def rev_mrr_pareto(star: Star, quantiles: int = 5) -> DataFrame:
    """MRR concentration by quintile of active customers ranked by MRR.

    Everything shown depends on how often each MRR occurs, so the quintiles
    are cut from a value histogram (``operators.histogram``): no customer is
    ordered, and nothing runs before the action."""
    share = "cast(round(try_divide(cast(v AS decimal(38,2)), cast(total AS decimal(38,2))) * 100, 4) AS decimal(12,4))"
    g = tile_sums(_active(star), "mrr_inr", quantiles, {
        "_mrr": "v", "_share": share, "_known": "cast(if(v IS NULL, 0, 1) AS decimal(1,0))"})
    # AVG of DECIMAL(12,4) keeps 8 digits
    mean = F.round(F.try_divide(F.col("_share").cast(D(20, 4)), F.col("_known").cast(D(12, 0))), 8)
    g = with_share(g, "_mrr", "_q")
    return g.select(F.col("tile").alias("quintile"), F.col("n").alias("customers_in_quintile"),
                    out_double(F.round("_mrr", 0)).alias("total_mrr"), out_double(F.round(mean, 4)).alias("avg_mrr_share_pct"),
                    out_double("_q").alias("quintile_mrr_pct")).orderBy("quintile")


def rev_mrr_pareto_ranked(star: Star, quantiles: int = 5) -> DataFrame:
    """Per active customer: MRR share, cumulative share in descending MRR
    order and quintile (the ranked CTE of the Pareto statement).  One
    distributed ordering yields the running sum, the total and the NTILE."""
    c = _active(star).select("customer_id", "company_name", "plan", "segment", "mrr_inr")
    r = with_prefix_sum(c, [F.col("mrr_inr").desc(), F.col("customer_id").asc()], "mrr_inr",
                        out="_run", total="_tot", ntile=(quantiles, "quintile"))
    return r.select("customer_id", "company_name", "plan", "segment", out_double("mrr_inr").alias("mrr_inr"),
                    out_double(pct("mrr_inr", "_tot", 4)).alias("mrr_share_pct"),
                    out_double(pct("_run", "_tot", 2)).alias("cumulative_mrr_pct"), "quintile")


def _shared(g: DataFrame, cols: list, order_desc: str = "total_revenue") -> DataFrame:
    g = with_share(g, "_rev", "_share")
    return g.select(*cols, out_double("_share").alias("revenue_share_pct")) \
        .orderBy(F.col(order_desc).desc())


def rev_by_segment(star: Star) -> DataFrame:
    g = (star["fact_transactions"].groupBy("segment")
         .agg(n_distinct("customer_key", "unique_customers"),
              F.count("transaction_id").alias("total_transactions"),
              F.sum("revenue_inr").alias("_rev"), dbl_sum("gross_profit_inr", "total_gross_profit"),
              dbl_avg("gross_margin_pct", "avg_gross_margin_pct", 2))
         .withColumn("total_revenue", out_double(F.round("_rev", 0))))
    return _shared(g, ["segment", "unique_customers", "total_transactions", "total_revenue",
                       "total_gross_profit", "avg_gross_margin_pct"])


def rev_by_industry(star: Star) -> DataFrame:
    """Revenue by customer industry.  The fact is first reduced to one row
    per customer (sums and counts), so the join to the customer dimension
    shuffles customers, not transactions."""
    per_cust = (star["fact_transactions"].groupBy("customer_key")
                .agg(F.sum("revenue_inr").alias("_rev_c"),
                     F.sum("gross_margin_pct").alias("_m_sum"),
                     F.count("gross_margin_pct").alias("_m_cnt")))
    c = star["dim_customers"].select("customer_key", "industry")
    j = per_cust.join(c, "customer_key")
    g = (j.groupBy("industry")
         .agg(F.countDistinct("customer_key").alias("unique_customers"),
              F.sum("_rev_c").alias("_rev"), F.sum("_m_sum").alias("_ms"),
              F.sum("_m_cnt").alias("_mc"))
         .withColumn("total_revenue", out_double(F.round("_rev", 0)))
         .withColumn("avg_gross_margin_pct", out_double(F.round(quotient("_ms", "_mc"), 2))))
    return _shared(g, ["industry", "unique_customers", "total_revenue", "avg_gross_margin_pct"])


def rev_by_region_year(star: Star) -> DataFrame:
    g = (star["fact_transactions"]
         .groupBy("region", F.col("fiscal_year").cast("int").alias("fiscal_year"))
         .agg(dbl_sum("revenue_inr", "total_revenue"), dbl_sum("gross_profit_inr", "gross_profit"),
              dbl_avg("gross_margin_pct", "avg_margin_pct", 2),
              n_distinct("customer_key", "unique_customers")))
    return g.orderBy("region", "fiscal_year")


def rev_by_product_line(star: Star) -> DataFrame:
    t = star["fact_transactions"].join(products(star, "product_line"), "product_key")
    g = (t.groupBy("product_line")
         .agg(F.count("transaction_id").alias("total_transactions"),
              F.sum("revenue_inr").alias("_rev"), dbl_sum("cogs_inr", "total_cogs"),
              dbl_sum("gross_profit_inr", "total_gross_profit"),
              dbl_avg("gross_margin_pct", "avg_gross_margin_pct", 2))
         .withColumn("total_revenue", out_double(F.round("_rev", 0))))
    return _shared(g, ["product_line", "total_transactions", "total_revenue", "total_cogs",
                       "total_gross_profit", "avg_gross_margin_pct"])


def rev_mix_recurring(star: Star) -> DataFrame:
    t = star["fact_transactions"].join(products(star, "product_group", "is_recurring"), "product_key")
    g = (t.groupBy("product_group", "is_recurring")
         .agg(F.count("transaction_id").alias("total_transactions"),
              F.sum("revenue_inr").alias("_rev"))
         .withColumn("total_revenue", out_double(F.round("_rev", 0)))
         .withColumn("revenue_type", F.when(F.col("is_recurring") == 1, "Recurring")
                     .otherwise("Non-Recurring")))
    return _shared(g, ["product_group", "revenue_type", "total_transactions", "total_revenue"])


def rev_category_heatmap(star: Star) -> DataFrame:
    """As written in the reference this statement equals rev_by_product_line."""
    return rev_by_product_line(star)


def rev_category_by_year(star: Star, years: tuple[int, ...]) -> DataFrame:
    """The heatmap the title describes: revenue per category (rows) and fiscal
    year (columns).  ``years`` must be named, so the pivot needs no extra pass;
    revenue of other years is in ``fy_other``, so none is lost.  Revenue is summed per
    product and year before the category is joined."""
    t = (star["fact_transactions"].groupBy("product_key", F.col("fiscal_year").cast("int").alias("_fy"))
         .agg(F.sum("revenue_inr").alias("_rev")).join(products(star, "category"), "product_key"))
    year = F.when(F.col("_fy").isin(*years), F.col("_fy").cast("string")).otherwise("other")
    p = t.withColumn("_year", year).groupBy("category").pivot("_year", [*map(str, years), "other"]).agg(F.round(F.sum("_rev"), 0))
    return p.select("category", *[out_double(F.col(str(y))).alias(f"fy_{y}") for y in [*years, "other"]])


def _monthly(star: Star, *extra: str) -> DataFrame:
    t = star["fact_transactions"].join(dates(star, "month_num", *extra), "date_key")
    return t


def rev_rolling(star: Star, windows: tuple[int, int] = (3, 6)) -> DataFrame:
    m = (_monthly(star).groupBy(F.col("fiscal_year").cast("int").alias("fiscal_year"),
                                F.col("month_num").cast("int").alias("month_num"), "fiscal_month")
         .agg(F.round(F.sum("revenue_inr"), 0).alias("_mr")))
    order = ["fiscal_year", "month_num"]
    a, b = windows
    return m.select(
        "fiscal_year", "month_num", "fiscal_month", out_double("_mr").alias("monthly_revenue"),
        out_double(F.round(moving_avg("_mr", order, a), 0)).alias(f"rolling_{a}m_avg"),
        out_double(F.round(moving_avg("_mr", order, b), 0)).alias(f"rolling_{b}m_avg"),
    ).orderBy(*order)


def rev_seasonality(star: Star) -> DataFrame:
    """Month-of-year index against the grand mean.  As in the reference the
    inner grouping includes date_key, so the average is over daily totals."""
    daily = (_monthly(star, "month_short")
             .groupBy("fiscal_year", "month_num", "date_key", "month_short")
             .agg(F.round(F.sum("revenue_inr"), 0).alias("_rev")))
    m = (daily.groupBy(F.col("month_num").cast("int").alias("month_num"), "month_short")
         .agg(F.round(F.avg("_rev"), 0).alias("_avg")))
    grand = F.round(F.avg("_avg").over(Window.partitionBy()), 0)
    return m.select("month_num", "month_short", out_double("_avg").alias("avg_monthly_revenue"),
                    out_double(F.round(quotient("_avg", grand, 0), 4)).alias("seasonality_index")
                    ).orderBy("month_num")


def _yearly(star: Star, rounded: bool) -> DataFrame:
    s = F.sum("revenue_inr")
    return (star["fact_transactions"].groupBy(F.col("fiscal_year").cast("int").alias("fy"))
            .agg((F.round(s, 0) if rounded else s).alias("rev")))


def rev_yoy_bridge(star: Star) -> DataFrame:
    """Consecutive-year revenue change; a missing year breaks the chain.
    The reference self-joins yearly totals on year + 1; as years are unique
    after grouping, pairing each year with the previous present year and
    keeping only pairs one year apart is the same set -- from a single
    aggregation of the fact instead of two."""
    y = _yearly(star, True)
    w = Window.orderBy("fy")
    p = y.select(F.lag("fy").over(w).alias("from_year"), F.col("fy").alias("to_year"),
                 F.lag("rev").over(w).alias("r1"), F.col("rev").alias("r2"))
    p = p.filter(F.col("from_year") == F.col("to_year") - 1)
    diff = F.col("r2") - F.col("r1")
    return p.select("from_year", "to_year", out_double("r1").alias("from_revenue"),
                    out_double("r2").alias("to_revenue"),
                    out_double(F.round(diff, 0)).alias("absolute_change"),
                    out_double(pct(diff, F.col("r1"), 2, 0)).alias("growth_pct")
                    ).orderBy("from_year")


def rev_forecast_next_year(star: Star) -> DataFrame:
    """Next-year projection = highest yearly revenue x (1 + mean YoY growth)."""
    y = _yearly(star, False)
    prev = F.lag("rev").over(Window.orderBy("fy"))
    g = y.select("fy", "rev", quotient(F.col("rev") - prev, prev).alias("g")).filter(F.col("g").isNotNull())
    # narrow the operand so AVG keeps its full s+4 digits (Spark drops to 6
    # digits when averaging a DECIMAL(38,6))
    a = g.agg(F.max("rev").alias("mx"), F.avg(F.col("g").cast(D(20, 6))).alias("ag"),
              F.max("fy").alias("last"))
    factor = (F.lit(1) + F.col("ag")).cast(D(12, 10))
    return a.select(
        F.concat(F.lit("FY"), (F.col("last") + 1).cast("string"),
                 F.lit(" Forecast (Avg Growth)")).alias("scenario"),
        out_double(F.round(F.col("mx").cast(D(25, 2)) * factor, 0)).alias("projected_revenue_inr"),
        out_double(F.round(F.col("ag") * 100, 2)).alias("avg_growth_rate_used_pct"))


def rev_by_payment_status(star: Star) -> DataFrame:
    g = (star["fact_transactions"].groupBy("payment_status")
         .agg(n_rows("transaction_count"), F.sum("revenue_inr").alias("_rev"),
              dbl_avg("revenue_inr", "avg_transaction_value", 0))
         .withColumn("total_revenue", out_double(F.round("_rev", 0))))
    return _shared(g, ["payment_status", "transaction_count", "total_revenue", "avg_transaction_value"])


def rev_overdue_by_region(star: Star, status: str = "Overdue") -> DataFrame:
    g = (star["fact_transactions"].filter(F.col("payment_status") == status).groupBy("region")
         .agg(n_rows("overdue_transactions"), dbl_sum("revenue_inr", "overdue_revenue_at_risk"),
              dbl_avg("revenue_inr", "avg_overdue_amount", 0)))
    return g.orderBy(F.col("overdue_revenue_at_risk").desc())
