"""Adapter views: the driver's TPC-H-like tables mapped onto the star schema.

Every view is a lazy DataFrame derived from the parquet tables, so the work
of any query grows with the input.  The mapping is deterministic and uses
only integer/decimal arithmetic, so an independent SQL engine reproduces it
exactly (see ``finlake.oracle.prelude``).

Joins carry no hints: statistics and AQE turn small sides into broadcasts.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from finlake.functions.dates import date_key
from finlake.functions.exact import pct
from finlake.schemas import PLANS
from finlake.sources.calendar import calendar_spanning
from finlake.sources.seed import product_seed

D = DecimalType

# ---- fixed values of the fixture mapping ----
SEGMENT_OF_MKT = {"AUTOMOBILE": "SMB", "BUILDING": "SMB", "FURNITURE": "Mid-Market",
                  "HOUSEHOLD": "Mid-Market", "MACHINERY": "Enterprise"}
REGION_OF_NAME = {"AFRICA": "South", "AMERICA": "West", "ASIA": "East",
                  "EUROPE": "North", "MIDDLE EAST": "Central"}
PAYMENT_OF_STATUS = {"F": "Paid", "O": "Pending", "P": "Overdue"}
CHURN_REASONS = ["Price", "Competition", "Product Gap", "Support", "Other"]
ACTIVE_SINCE = dt.date(2001, 2, 1)        # last order before this -> churned
DEFECT_CALENDAR_END = dt.date(2000, 12, 31)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
NAMED = "named_transactions"
ALONE = "transactions_alone"


def read_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def _map(c, mapping: dict) -> F.Column:
    expr = None
    for k, v in mapping.items():
        expr = (F.when(c == k, v) if expr is None else expr.when(c == k, v))
    return expr


def _orders(t):
    return t["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                              F.to_date("o_orderdate").alias("odate"))


def customer_base(t: dict[str, DataFrame]) -> DataFrame:
    """dim_customers columns plus first/last order date and order total."""
    ho = (_orders(t).groupBy("o_custkey")
          .agg(F.min("odate").alias("first_d"), F.max("odate").alias("last_d"),
               F.sum(F.col("o_totalprice").cast(D(14, 2))).cast(D(14, 2)).alias("rec")))
    geo = (t["nation"].select("n_nationkey", "n_regionkey")
           .join(t["region"].select("r_regionkey", "r_name"),
                 F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", "r_name"))
    c = (t["customer"]
         .join(ho, F.col("c_custkey") == F.col("o_custkey"))
         .join(geo, F.col("c_nationkey") == F.col("n_nationkey")))
    k = F.col("c_custkey")
    health = ((k * 37) % 1001).cast(D(6, 0)) * F.lit(0.1).cast(D(1, 1))
    mrr = (F.col("c_acctbal").cast(D(12, 2)) + F.lit(1000)).cast(D(12, 2))
    return c.select(
        k.cast("int").alias("customer_key"),
        F.concat(F.lit("CUST-"), k.cast("string")).alias("customer_id"),
        F.col("c_name").alias("company_name"),
        F.element_at(F.array(*[F.lit(p) for p in PLANS]), (k % 4 + 1).cast("int")).alias("plan"),
        _map(F.col("c_mktsegment"), SEGMENT_OF_MKT).alias("segment"),
        F.col("c_mktsegment").alias("industry"),
        _map(F.col("r_name"), REGION_OF_NAME).alias("region"),
        F.col("first_d").alias("acquisition_date"),
        F.concat(F.lit("CH-"), (k % 5).cast("string")).alias("acquisition_channel"),
        mrr.alias("mrr_inr"),
        (mrr * 12).cast(D(14, 2)).alias("arr_inr"),
        (12 * (1 + k % 3)).cast("tinyint").alias("contract_length_months"),
        health.cast(D(5, 1)).alias("health_score"),
        F.when(health >= 70, "Healthy").when(health >= 40, "At Risk")
         .otherwise("Critical").alias("health_status"),
        F.concat(F.lit("CSM-"), (k % 10).cast("string")).alias("csm_owner"),
        ((k * 53) % 201 - 100).cast("smallint").alias("nps_score"),
        ((k * 29) % 120).cast("smallint").alias("last_login_days_ago"),
        (((k * 17) % 400).cast(D(6, 0)) * F.lit(0.1).cast(D(1, 1))).cast(D(6, 1))
         .alias("avg_monthly_logins"),
        ((k * 13) % 15).cast("tinyint").alias("support_tickets_90d"),
        (12 + k % 49).cast("tinyint").alias("expected_cltv_months"),
        F.when(F.col("last_d") < F.lit(ACTIVE_SINCE), 0).otherwise(1)
         .cast("tinyint").alias("is_active"),
        "first_d", "last_d", "rec",
    )


DIM_CUSTOMER_COLS = ["customer_key", "customer_id", "company_name", "plan", "segment",
                     "industry", "region", "acquisition_date", "acquisition_channel",
                     "mrr_inr", "arr_inr", "contract_length_months", "health_score",
                     "health_status", "csm_owner", "nps_score", "last_login_days_ago",
                     "avg_monthly_logins", "support_tickets_90d", "expected_cltv_months",
                     "is_active"]


def _cents(c: str) -> F.Column:
    """A 2-decimal double (price, rate) as exact integer hundredths; equal to
    CAST(x AS DECIMAL(p,2)) for the 2-decimal values of the inputs."""
    return F.round(F.col(c) * 100).cast("long")


def _from_cents(c: F.Column, precision: int = 14) -> F.Column:
    return (c.cast(D(18, 0)) * F.lit(0.01).cast(D(2, 2))).cast(D(precision, 2))


def priced_lines(t: dict[str, DataFrame], dim_product: DataFrame,
                 orders: DataFrame | None = None, parts_first: bool = False) -> DataFrame:
    """lineitem x orders x part x product with the money columns of a fact row.

    With ``parts_first`` the second shuffle of lines, where parts are too many
    to broadcast, carries a brand instead of an order's columns; without it,
    facts and budget share the shuffle of lines by order.

    Money is computed in exact integer cents (non-negative inputs, HALF_UP by
    adding half a unit before the integer division) and converted to DECIMAL
    once, instead of chains of wide-decimal multiplications per row:
      revenue = ROUND(price * (1 - discount), 2)
      cogs    = ROUND(revenue * (cogs_pct_std + tax * 100) * 0.01, 2)
      margin  = 100 - cogs_pct_std - tax * 100
    """
    li = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                              "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                              "l_shipdate")
    pa = t["part"].select("p_partkey", "p_brand", "p_type")
    o = orders if orders is not None else _orders(t)
    prod = dim_product.select(
        "product_key", "cogs_pct_std", (F.col("cogs_pct_std") * 100).cast("long").alias("_std_bp"))
    of_part, of_order = F.col("l_partkey") == F.col("p_partkey"), F.col("l_orderkey") == F.col("o_orderkey")
    x = ((li.join(pa, of_part).join(o, of_order) if parts_first else li.join(o, of_order).join(pa, of_part))
         .withColumn("product_key", F.substring("p_brand", 7, 3).cast("int"))
         .join(prod, "product_key"))
    x = (x.withColumn("_price_c", _cents("l_extendedprice")).withColumn("_disc_c", _cents("l_discount"))
         .withColumn("_rev_c", F.expr("(_price_c * (100 - _disc_c) + 50) div 100"))
         .withColumn("_pct_bp", F.col("_std_bp") + _cents("l_tax") * 100))
    x = x.withColumn("_cogs_c", F.expr("(_rev_c * _pct_bp + 5000) div 10000"))
    return (x.withColumn("revenue_inr", _from_cents(F.col("_rev_c")))
            .withColumn("cogs_inr", _from_cents(F.col("_cogs_c")))
            .withColumn("gross_profit_inr", _from_cents(F.col("_rev_c") - F.col("_cogs_c")))
            .withColumn("gross_margin_pct", _from_cents(F.lit(10000) - F.col("_pct_bp"), 6))
            .drop("_rev_c", "_cogs_c", "_pct_bp", "_std_bp", "_price_c", "_disc_c"))


def lines_with_customers(t: dict[str, DataFrame], dim_product: DataFrame, cust: DataFrame,
                         named: bool = False, parts_first: bool = False) -> DataFrame:
    """Priced line-level rows of every order, with the customer attributes of
    the order (NULL when the customer is unknown).  Customer attributes are
    LEFT-joined to orders first, which are fewer than lines; transactions keep
    the rows with a customer (the inner join of the mapping).  Lines shuffle by order key and, where parts are
    too many to broadcast, again by part key.

    ``named`` gives the rows that joining these with ``cust`` by customer_key
    gives, with its customer_id: orders, already dealt by customer, are joined
    with the ids instead of lines."""
    c = cust.select("customer_key", "plan", "segment", "region")
    orders = _orders(t).join(c, F.col("o_custkey") == F.col("customer_key"), "left")
    if named:
        ids = cust.select(F.col("customer_key").alias("_named"), "customer_id")
        orders = orders.where(F.col("customer_key").isNotNull()).join(ids, F.col("o_custkey") == F.col("_named")).drop("_named")
    return priced_lines(t, dim_product, orders, parts_first=named or parts_first)


def _transactions(lines: DataFrame, *more: str) -> DataFrame:
    d = F.col("odate")
    x = lines.filter(F.col("customer_key").isNotNull())
    return x.select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                   "l_extendedprice").alias("transaction_key"),
        F.concat(F.lit("TXN-"), F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("transaction_id"),
        F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("invoice_id"),
        "customer_key", "product_key",
        date_key(d).alias("date_key"),
        F.year(d).cast("smallint").alias("fiscal_year"),
        F.concat(F.lit("Q"), F.quarter(d).cast("string")).alias("fiscal_quarter"),
        F.date_format(d, "MMM-yyyy").alias("fiscal_month"),
        "region", "segment", "plan",
        _map(F.col("o_orderstatus"), PAYMENT_OF_STATUS).alias("payment_status"),
        "revenue_inr", "cogs_inr", "gross_profit_inr", "gross_margin_pct", *more,
    )


def _churn(base: DataFrame) -> DataFrame:
    k = F.col("customer_key")
    churn_d = F.date_add("last_d", 90)
    return base.filter(F.col("is_active") == 0).select(
        k.cast("long").alias("churn_key"),
        "customer_key",
        date_key("first_d").alias("acquisition_date_key"),
        date_key(churn_d).alias("churn_date_key"),
        "plan", "segment", "region",
        F.element_at(F.array(*[F.lit(r) for r in CHURN_REASONS]), (k % 5 + 1)).alias("churn_reason"),
        F.when(k % 3 == 0, "Involuntary").otherwise("Voluntary").alias("churn_type"),
        (k % 2).cast("tinyint").alias("was_escalated"),
        F.when(k % 3 == 1, 1).otherwise(0).cast("tinyint").alias("exit_survey_completed"),
        F.when(k % 7 < 3, 1).otherwise(0).cast("tinyint").alias("win_back_eligible"),
        (F.datediff("last_d", "first_d") + 90).cast("smallint").alias("days_to_churn"),
        F.col("mrr_inr").alias("mrr_at_churn_inr"),
        F.col("arr_inr").alias("arr_at_churn_inr"),
        F.col("rec").alias("revenue_recognized_inr"),
        F.col("health_score").alias("last_health_score"),
        "support_tickets_90d",
    )


def _budget(lines: DataFrame) -> DataFrame:
    d = F.col("odate")
    m = F.month(d)
    factor = F.lit(0.88).cast(D(3, 2)) + F.lit(0.02).cast(D(3, 2)) * (m % 8)
    g = (lines.groupBy(F.year(d).alias("y"), m.alias("m"), F.col("p_type").alias("department"))
         .agg(F.sum("revenue_inr").alias("act_rev"),
              F.sum(F.round(F.col("revenue_inr") * factor, 2)).alias("bud_rev"),
              (F.sum(F.col("l_quantity").cast(D(12, 2))) * 100).alias("act_opex"),
              (F.count(F.lit(1)) * 2550).cast(D(20, 2)).alias("bud_opex"),
              F.sum("gross_profit_inr").alias("gp"),
              F.countDistinct("l_suppkey").alias("hc")))
    first = F.make_date("y", "m", F.lit(1))
    rev_var = F.col("act_rev") - F.col("bud_rev")
    opex_var = F.col("act_opex") - F.col("bud_opex")
    return g.select(
        F.xxhash64("y", "m", "department").alias("bva_key"),
        date_key(first).alias("date_key"),
        F.col("y").cast("smallint").alias("fiscal_year"),
        F.concat(F.lit("Q"), F.quarter(first).cast("string")).alias("fiscal_quarter"),
        F.date_format(first, "MMM-yyyy").alias("month_label"),
        "department",
        F.col("bud_rev").cast(D(20, 2)).alias("budgeted_revenue_inr"),
        F.col("act_rev").cast(D(20, 2)).alias("actual_revenue_inr"),
        rev_var.cast(D(20, 2)).alias("revenue_variance_inr"),
        pct(rev_var, "bud_rev").cast(D(7, 2)).alias("revenue_variance_pct"),
        F.col("bud_opex").cast(D(20, 2)).alias("budgeted_opex_inr"),
        F.col("act_opex").cast(D(20, 2)).alias("actual_opex_inr"),
        opex_var.cast(D(20, 2)).alias("opex_variance_inr"),
        pct(opex_var, "bud_opex").cast(D(7, 2)).alias("opex_variance_pct"),
        F.round(F.col("bud_rev") * F.lit(0.65).cast(D(2, 2)) - F.col("bud_opex"), 2)
         .cast(D(20, 2)).alias("budgeted_ebitda_inr"),
        (F.col("gp") - F.col("act_opex")).cast(D(20, 2)).alias("actual_ebitda_inr"),
        (F.col("hc") + F.col("m") % 3 - 1).cast("int").alias("headcount_budget"),
        F.col("hc").cast("int").alias("headcount_actual"),
    )


def plant_defects(star: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Deterministic defects so every data-quality rule has work to find."""
    c = star["dim_customers"]
    k = F.col("customer_key")
    c = (c.withColumn("mrr_inr", F.when(k % 97 == 0, F.lit(None)).otherwise(F.col("mrr_inr")))
          .withColumn("csm_owner", F.when(k % 97 == 0, F.lit(None)).otherwise(F.col("csm_owner")))
          .withColumn("arr_inr", F.when(k % 83 == 0, (F.col("arr_inr") + 5).cast(D(14, 2)))
                      .otherwise(F.col("arr_inr")))
          .withColumn("health_score", F.when(k % 79 == 0, F.lit(120).cast(D(5, 1)))
                      .otherwise(F.col("health_score")))
          .withColumn("nps_score", F.when(k % 73 == 0, F.lit(-150).cast("smallint"))
                      .otherwise(F.col("nps_score"))))
    c = c.unionByName(c.filter(k % 89 == 0))
    t = star["fact_transactions"]
    ok = F.split("transaction_id", "-").getItem(1).cast("long")
    rev = F.col("revenue_inr")
    t = (t.withColumn("revenue_inr", F.when(ok % 101 == 0, F.lit(None))
                      .when(ok % 103 == 0, -rev).otherwise(rev))
          .withColumn("cogs_inr", F.when(ok % 107 == 0, F.round(rev * F.lit(1.1).cast(D(2, 1)), 2)
                                         .cast(D(14, 2))).otherwise(F.col("cogs_inr")))
          .withColumn("gross_profit_inr",
                      F.when(ok % 109 == 0, F.col("gross_profit_inr") + F.lit(1.00).cast(D(3, 2)))
                      .when(ok % 113 == 0, F.col("gross_profit_inr") + F.lit(1.01).cast(D(3, 2)))
                      .otherwise(F.col("gross_profit_inr")).cast(D(14, 2))))
    ch = star["fact_churn"]
    kk = F.col("customer_key")
    ch = (ch.withColumn("churn_date_key", F.when(kk % 71 == 0, F.col("acquisition_date_key"))
                        .otherwise(F.col("churn_date_key")))
            .withColumn("days_to_churn", F.when(kk % 71 == 0, F.lit(0).cast("smallint"))
                        .otherwise(F.col("days_to_churn"))))
    ch = ch.unionByName(ch.filter(kk % 89 == 0))
    b = star["fact_budget_vs_actual"]
    b = b.unionByName(b.filter(F.col("date_key") % 89 == 0))
    # a calendar that ends too early, for the rules on orphan dates only
    dd = star["dim_date"].filter(F.col("full_date") <= F.lit(DEFECT_CALENDAR_END))
    out = dict(star)
    out.update(dim_customers=c, fact_transactions=t, fact_churn=ch,
               fact_budget_vs_actual=b, dim_date_loaded=dd)
    return out


def star_from_testdata(spark: SparkSession, sf_dir: str, defects: bool = False,
                       checkpoint_lines: bool = False, named: bool = False) -> dict[str, DataFrame]:
    """Lazy star schema over /root/testdata/sf*/ (FIXTURES.md section B/C).

    ``named`` adds ``NAMED`` to a star without defects: transactions joined
    with their customers' ids, for what renders them as text, and ``ALONE``:
    the rows of the transactions with parts joined first, for what reads no
    other fact (less is shuffled, but the budget cannot share it).

    ``checkpoint_lines`` cuts the shared line-level frame by writing it as a
    Parquet table to a fresh folder under the shared checkpoint folder, so
    writing both facts does the line-level joins once (used when the
    warehouse is materialized)."""
    t = read_tables(spark, sf_dir)
    dim_product = product_seed(spark)
    base = customer_base(t)
    cust = base.select(*DIM_CUSTOMER_COLS)
    lines = lines_with_customers(t, dim_product, cust)
    # the budget needs no customers; it shares the written lines where there are some
    budget_lines = priced_lines(t, dim_product)
    if checkpoint_lines:
        from finlake.session import scratch_dir
        path = scratch_dir(spark, "lines")
        lines.write.parquet(path)
        budget_lines = lines = spark.read.parquet(path)
    star = {
        "dim_date": calendar_spanning(t["orders"].select(F.col("o_orderdate").alias("d"))),
        "dim_product": dim_product,
        "dim_customers": cust,
        "fact_transactions": _transactions(lines),
        "fact_churn": _churn(base),
        "fact_budget_vs_actual": _budget(budget_lines),
    }
    if named and not defects:
        star[ALONE] = _transactions(lines_with_customers(t, dim_product, cust, parts_first=True))
        star[NAMED] = _transactions(lines_with_customers(t, dim_product, cust, named=True), "customer_id")
    return plant_defects(star) if defects else star
