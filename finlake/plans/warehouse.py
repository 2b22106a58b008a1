"""Warehouse load (ETL) and its checks.

* typed loaders turn all-string staging frames into the star schema
  (trim, tolerant date/number parsing, Yes/No flags, case-insensitive key
  lookups), with reject frames for rows whose lookups fail;
* ``render_*`` produce staging text from warehouse rows (the inverse, used
  to exercise the loaders on data derived from the inputs);
* calendar checks, row counts, table inventory and declared-constraint
  checks.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DecimalType, ShortType

from finlake.functions.parse import clean_text
from finlake.operators import cells
from finlake.operators.cells import Cell
from finlake.operators.keys import with_stored_keys, with_surrogate_key
from finlake.operators.quality import duplicate_key_count
from finlake.operators.spelling import collated, learn, unify
from finlake.schemas import (CHURN_TYPES, ENUM_DOMAINS, FOREIGN_KEYS, HEALTH_STATUSES, PAYMENT_STATUSES,
                             PLANS, PRIMARY_KEYS, REGIONS, SEGMENTS, TEXT_LENGTHS, UNIQUE_KEYS, WAREHOUSE)
from finlake.sources.testdata import NAMED

Star = dict

# table descriptions of the inventory, in this library's words
TABLE_DESCRIPTIONS = {
    "dim_date": "Calendar dimension",
    "dim_customers": "Customer master",
    "dim_product": "Product and revenue category dimension",
    "fact_transactions": "Revenue fact table",
    "fact_churn": "Churn event fact",
    "fact_budget_vs_actual": "Budget vs Actual fact - monthly department level",
}
TABLE_ORDER = ["dim_date", "dim_customers", "dim_product", "fact_transactions", "fact_churn",
               "fact_budget_vs_actual"]
SURROGATE_COLS = {"transaction_key", "churn_key", "bva_key"}


def present(df: DataFrame) -> DataFrame:
    """Output presentation: small integers as INT, decimals as DOUBLE."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (ByteType, ShortType)):
            cols.append(F.col(f.name).cast("int").alias(f.name))
        elif isinstance(f.dataType, DecimalType):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ------------------------------------------------------------------ calendar
def verify_calendar(star: Star) -> DataFrame:
    d = star["dim_date"]
    g = (d.groupBy(F.col("fiscal_year").cast("int").alias("fiscal_year"))
         .agg(F.count(F.lit(1)).alias("total_days"),
              F.count(F.when(F.col("is_weekend") == 1, 1)).alias("weekend_days"),
              F.count(F.when(F.col("is_month_end") == 1, 1)).alias("month_ends"),
              F.count(F.when(F.col("is_quarter_end") == 1, 1)).alias("quarter_ends")))
    return g.orderBy("fiscal_year")


def sample_calendar(star: Star, k: int = 5) -> DataFrame:
    """First k and last k days, tagged, in date order (two top-k + union)."""
    d = present(star["dim_date"])
    first = d.orderBy(F.col("date_key").asc()).limit(k).select(F.lit(f"FIRST {k}").alias("sample_set"), "*")
    last = d.orderBy(F.col("date_key").desc()).limit(k).select(F.lit(f"LAST {k}").alias("sample_set"), "*")
    return first.unionByName(last).orderBy("date_key")


def load_dim_date(star: Star) -> DataFrame:
    return present(star["dim_date"])


# ------------------------------------------------------------------ loaders
def _key(c) -> Column:
    """Lookup key with the reference's comparison rules: case, accents and
    surrounding spaces do not count."""
    return collated(c)


def staging_cells(table: str) -> list[Cell]:
    """How each column of a warehouse table is read from its staging text."""
    length = {"transactions": TEXT_LENGTHS["fact_transactions"], "customers": TEXT_LENGTHS["dim_customers"],
              "churn": TEXT_LENGTHS["fact_churn"], "budget": TEXT_LENGTHS["fact_budget_vs_actual"]}[table]

    def text(column, source):
        return cells.text(column, source, length.get(column))

    def label(column, source, domain):
        return cells.label(column, source, domain, length.get(column))

    if table == "customers":
        return [text("customer_id", "CustomerID"), text("company_name", "CompanyName"),
                cells.enum("plan", "Plan", PLANS), cells.enum("segment", "Segment", SEGMENTS),
                text("industry", "Industry"), cells.enum("region", "Region", REGIONS),
                cells.date("acquisition_date", "AcquisitionDate"), text("acquisition_channel", "AcquisitionChannel"),
                cells.decimal("mrr_inr", "MRR_INR", 12, 2), cells.decimal("arr_inr", "ARR_INR", 14, 2),
                cells.integer("contract_length_months", "ContractLength_Months", "tinyint"),
                cells.decimal("health_score", "HealthScore", 5, 1, commas=False),
                cells.enum("health_status", "HealthStatus", HEALTH_STATUSES), text("csm_owner", "CSM_Owner"),
                cells.integer("nps_score", "NPS_Score", "smallint"),
                cells.integer("last_login_days_ago", "LastLoginDaysAgo", "smallint"),
                cells.decimal("avg_monthly_logins", "AvgMonthlyLogins", 6, 1, commas=False),
                cells.integer("support_tickets_90d", "SupportTickets_Last90D", "tinyint"),
                cells.integer("expected_cltv_months", "ExpectedCLTV_Months", "tinyint"),
                cells.flag("is_active", "IsActive")]
    if table == "transactions":
        return [text("transaction_id", "TransactionID"), text("invoice_id", "InvoiceID"),
                cells.day_key("date_key", "TransactionDate"), cells.integer("fiscal_year", "FiscalYear", "smallint"),
                text("fiscal_quarter", "FiscalQuarter"), text("fiscal_month", "FiscalMonth"),
                label("region", "Region", REGIONS), label("segment", "Segment", SEGMENTS), label("plan", "Plan", PLANS),
                cells.enum("payment_status", "PaymentStatus", PAYMENT_STATUSES),
                cells.decimal("revenue_inr", "Revenue_INR", 14, 2), cells.decimal("cogs_inr", "COGS_INR", 14, 2),
                cells.decimal("gross_profit_inr", "GrossProfit_INR", 14, 2),
                cells.decimal("gross_margin_pct", "GrossMargin_Pct", 6, 2, commas=False)]
    if table == "churn":
        return [cells.day_key("acquisition_date_key", "AcquisitionDate"), cells.day_key("churn_date_key", "ChurnDate"),
                label("plan", "Plan", PLANS), label("segment", "Segment", SEGMENTS), label("region", "Region", REGIONS),
                text("churn_reason", "ChurnReason"), cells.enum("churn_type", "ChurnType", CHURN_TYPES),
                cells.flag("was_escalated", "WasEscalated"), cells.flag("exit_survey_completed", "ExitSurveyCompleted"),
                cells.flag("win_back_eligible", "WinBackEligible"), cells.integer("days_to_churn", "DaysToChurn", "smallint"),
                cells.decimal("mrr_at_churn_inr", "MRR_AtChurn_INR", 12, 2),
                cells.decimal("arr_at_churn_inr", "ARR_AtChurn_INR", 14, 2),
                cells.decimal("revenue_recognized_inr", "RevenueRecognized_INR", 14, 2),
                cells.decimal("last_health_score", "LastHealthScore", 5, 1, commas=False),
                cells.integer("support_tickets_90d", "SupportTickets_Last90D", "tinyint")]
    return [cells.day_key("date_key", "Period"), cells.integer("fiscal_year", "FiscalYear", "smallint"),
            text("fiscal_quarter", "FiscalQuarter"), text("month_label", "Month"), text("department", "Department"),
            *[cells.decimal(f"{c}_inr", f"{s}_INR", 20, 2) for c, s in BUDGET_REVENUE],
            cells.decimal("revenue_variance_pct", "RevenueVariance_Pct", 7, 2, commas=False),
            *[cells.decimal(f"{c}_inr", f"{s}_INR", 20, 2) for c, s in BUDGET_OPEX],
            cells.decimal("opex_variance_pct", "OpExVariance_Pct", 7, 2, commas=False),
            *[cells.decimal(f"{c}_inr", f"{s}_INR", 20, 2) for c, s in BUDGET_EBITDA],
            cells.integer("headcount_budget", "HeadCount_Budget"), cells.integer("headcount_actual", "HeadCount_Actual")]


BUDGET_REVENUE = [("budgeted_revenue", "BudgetedRevenue"), ("actual_revenue", "ActualRevenue"), ("revenue_variance", "RevenueVariance")]
BUDGET_OPEX = [("budgeted_opex", "BudgetedOpEx"), ("actual_opex", "ActualOpEx"), ("opex_variance", "OpExVariance")]
BUDGET_EBITDA = [("budgeted_ebitda", "BudgetedEBITDA"), ("actual_ebitda", "ActualEBITDA")]

# labels without a declared domain: (staging table, its column) -> (warehouse table, its column)
FREE_LABELS = {("customers", "Industry"): ("dim_customers", "industry"),
               ("customers", "AcquisitionChannel"): ("dim_customers", "acquisition_channel"),
               ("customers", "CSM_Owner"): ("dim_customers", "csm_owner"),
               ("churn", "ChurnReason"): ("fact_churn", "churn_reason"),
               ("budget", "Department"): ("fact_budget_vs_actual", "department")}


def parse_staging(stg: DataFrame, table: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed columns of a staging table and its faulty cells (``operators.cells``)."""
    return cells.parse_cells(stg, staging_cells(table), keep)


def _typed(df: DataFrame, table: str, target: str, *keys: str) -> DataFrame:
    """The loaded columns of `target`, keys included, in declared order."""
    value = {c.column: c.value for c in staging_cells(table)}
    order = [f.name for f in WAREHOUSE[target].fields]
    return df.select(*[F.col(n) if n in keys else value[n].alias(n) for n in order if n in keys or n in value])


def _spelled(df: DataFrame, target: str, spellings: DataFrame | None) -> DataFrame:
    return df if spellings is None else unify(df, spellings, *[c for t, c in FREE_LABELS.values() if t == target])


def learn_spellings(spark, path: str, stg: dict[str, DataFrame]) -> DataFrame:
    """Adds the free labels of staging tables to the dictionary at `path`."""
    return learn(spark, path, [(stg[t], source, column) for (t, source), (_, column) in FREE_LABELS.items() if t in stg])


def one_spelling(df: DataFrame, *cols: str) -> DataFrame:
    """Free labels that differ only in case or accents get one spelling (the
    smallest), so that grouping by them gives one group.  Distinct labels are
    few; each column costs one aggregation and a join with its result.  Within one
    frame only; ``operators.spelling`` keeps spellings across loads."""
    out = df
    for c in cols:
        key = F.collate(F.col(c), "UNICODE_CI_AI")
        names = (df.where(F.col(c).isNotNull()).select(c).distinct().groupBy(key.alias("_label_key"))
                 .agg(F.min(c).alias("_spelling"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
        out = (out.join(names, key == F.col("_label_key"), "left")
               .withColumn(c, F.coalesce("_spelling", c)).drop("_label_key", "_spelling"))
    return out


def load_dim_customers(stg: DataFrame, surrogate: bool = True, spellings: DataFrame | None = None) -> DataFrame:
    """Typed customers; rows without an id drop out.  ``spellings`` unifies the
    free labels (``learn_spellings``)."""
    cid = clean_text("CustomerID")
    out = _spelled(_typed(stg.filter(cid.isNotNull() & (cid != "")), "customers", "dim_customers"), "dim_customers", spellings)
    if surrogate:
        out = with_surrogate_key(out, "customer_key", ["customer_id"]).withColumn(
            "customer_key", F.col("customer_key").cast("int"))
    return out


def _customer_lookup(dim_customers: DataFrame) -> DataFrame:
    """Key of each id; where ids differ only in case or accents the smallest
    key is taken, so no fact row is repeated (see ``ambiguous_customers``).
    Ids are unique here, so a task's share of them is hashed: a sort would
    compute two collation keys per comparison of fact rows."""
    return (dim_customers.groupBy(_key("customer_id").alias("_cid")).agg(F.min("customer_key").alias("customer_key"))
            .hint("shuffle_hash"))


def ambiguous_customers(dim_customers: DataFrame) -> DataFrame:
    """Ids that the lookup cannot tell apart: customer_id, customer_key, and how
    many rows share its key."""
    shared = dim_customers.groupBy(_key("customer_id").alias("_cid")).agg(F.count(F.lit(1)).alias("sharing")).where("sharing > 1")
    named = dim_customers.select("customer_id", "customer_key", _key("customer_id").alias("_cid"))
    return named.join(shared, "_cid").select("customer_id", "customer_key", "sharing")


def _with_product(stg: DataFrame, dim_product: DataFrame) -> DataFrame:
    """Staging rows with the key of each product that their line and category
    name; rows that name none drop out.  Texts that are spelt as a product's
    are found by the text itself; collation keys, which the tasks of an
    executor compute one after another, are made for the other rows alone."""
    p = dim_product.select(F.trim("product_line").alias("_tl"), F.trim("category").alias("_tc"),
                           _key("product_line").alias("_pl"), _key("category").alias("_pc"), "product_key")
    by_key = p.select("_pl", "_pc", "product_key", F.lit(True).alias("_alike"))
    spelt = (p.select("_tl", "_tc", "_pl", "_pc").dropDuplicates(["_tl", "_tc"])
             .join(by_key.withColumnRenamed("product_key", "_spelt_key"), ["_pl", "_pc"])
             .select("_tl", "_tc", "_spelt_key", F.col("_alike").alias("_spelt")))
    s = (stg.withColumns({"_tl": clean_text("ProductLine"), "_tc": clean_text("Category")})
         .join(F.broadcast(spelt), ["_tl", "_tc"], "left"))
    other = F.col("_spelt").isNull()
    return (s.withColumns({"_pl": F.when(other, _key("ProductLine")), "_pc": F.when(other, _key("Category"))})
            .join(F.broadcast(by_key), ["_pl", "_pc"], "left").where("_spelt OR _alike")
            .withColumn("product_key", F.when(other, F.col("product_key")).otherwise(F.col("_spelt_key"))))


def load_fact_transactions(stg: DataFrame, dim_customers: DataFrame, dim_product: DataFrame,
                           surrogate: bool = False) -> DataFrame:
    """Typed transactions; rows whose customer or (line, category) lookup
    fails drop out (see ``reject_transactions``).

    Lookup keys are columns on both sides: Spark compares collated columns by
    their binary collation keys, but sorts both sides of a join by collated
    expressions, which puts a fact into as many tasks as there are products."""
    s = stg.filter(clean_text("TransactionID").isNotNull()).withColumn("_cid", _key("CustomerID"))
    j = _with_product(s, dim_product).join(_customer_lookup(dim_customers), "_cid")
    out = _typed(j, "transactions", "fact_transactions", "customer_key", "product_key")
    return with_stored_keys(out, "transaction_key") if surrogate else out


def reject_transactions(stg: DataFrame, dim_customers: DataFrame, dim_product: DataFrame) -> DataFrame:
    """Staging rows the transaction load drops (unknown customer or product)."""
    s = stg.filter(clean_text("TransactionID").isNotNull()).withColumn("_cid", _key("CustomerID"))
    p = dim_product.select(_key("product_line").alias("_pl"), _key("category").alias("_pc"))
    no_cust = s.join(_customer_lookup(dim_customers).select("_cid"), "_cid", "left_anti")
    has_cust = s.join(_customer_lookup(dim_customers).select("_cid"), "_cid", "left_semi")
    no_prod = has_cust.join(p, (_key("ProductLine") == F.col("_pl")) & (_key("Category") == F.col("_pc")),
                            "left_anti")
    return (no_cust.withColumn("reject_reason", F.lit("unknown customer"))
            .unionByName(no_prod.withColumn("reject_reason", F.lit("unknown product"))).drop("_cid"))


def reject_churn(stg: DataFrame, dim_customers: DataFrame) -> DataFrame:
    """Staging rows the churn load drops (unknown customer)."""
    s = stg.filter(clean_text("CustomerID").isNotNull()).withColumn("_cid", _key("CustomerID"))
    return (s.join(_customer_lookup(dim_customers).select("_cid"), "_cid", "left_anti")
            .withColumn("reject_reason", F.lit("unknown customer")).drop("_cid"))


def load_fact_churn(stg: DataFrame, dim_customers: DataFrame, surrogate: bool = False,
                    spellings: DataFrame | None = None) -> DataFrame:
    """Typed churn events; rows with an unknown customer drop out (see
    ``reject_churn``)."""
    s = stg.filter(clean_text("CustomerID").isNotNull()).withColumn("_cid", _key("CustomerID"))
    out = _typed(s.join(_customer_lookup(dim_customers), "_cid"), "churn", "fact_churn", "customer_key")
    out = _spelled(out, "fact_churn", spellings)
    return with_stored_keys(out, "churn_key") if surrogate else out


def load_fact_budget(stg: DataFrame, surrogate: bool = False, spellings: DataFrame | None = None) -> DataFrame:
    out = _typed(stg.filter(clean_text("Period").isNotNull()), "budget", "fact_budget_vs_actual")
    out = _spelled(out, "fact_budget_vs_actual", spellings)
    return with_stored_keys(out, "bva_key") if surrogate else out


# --------------------------------------------------------------- renderers
def _money(c: str) -> Column:
    return F.format_number(F.col(c), 2)


def _dmy(d: Column) -> Column:
    return F.date_format(d, "dd-MMM-yyyy")


def _from_key(c: str) -> Column:
    return F.to_date(F.col(c).cast("string"), "yyyyMMdd")


def _txt(c) -> Column:
    return (c if isinstance(c, Column) else F.col(c)).cast("string")


def _yes_no(c: str) -> Column:
    return F.when(F.col(c) == 1, "Yes").otherwise("No")


def render_customers(dim_customers: DataFrame) -> DataFrame:
    """Staging text for customers, with the variations an export produces:
    padded ids, ISO or upper-case dates, lower-case flags, thousands commas."""
    k = F.col("customer_key")
    acq = F.col("acquisition_date")
    date_txt = (F.when(k % 11 == 0, F.date_format(acq, "yyyy-MM-dd"))
                .when(k % 13 == 0, F.upper(F.date_format(acq, "d-MMM-yyyy")))
                .otherwise(_dmy(acq)))
    return dim_customers.select(
        F.when(k % 7 == 0, F.concat(F.lit(" "), "customer_id", F.lit(" "))).otherwise(F.col("customer_id"))
        .alias("CustomerID"),
        F.col("company_name").alias("CompanyName"), F.col("plan").alias("Plan"),
        F.col("segment").alias("Segment"), F.col("industry").alias("Industry"), F.col("region").alias("Region"),
        date_txt.alias("AcquisitionDate"), F.col("acquisition_channel").alias("AcquisitionChannel"),
        _money("mrr_inr").alias("MRR_INR"), _money("arr_inr").alias("ARR_INR"),
        _txt("contract_length_months").alias("ContractLength_Months"), _txt("health_score").alias("HealthScore"),
        F.col("health_status").alias("HealthStatus"), F.col("csm_owner").alias("CSM_Owner"),
        _txt("nps_score").alias("NPS_Score"), _txt("last_login_days_ago").alias("LastLoginDaysAgo"),
        _txt("avg_monthly_logins").alias("AvgMonthlyLogins"),
        _txt("support_tickets_90d").alias("SupportTickets_Last90D"),
        _txt("expected_cltv_months").alias("ExpectedCLTV_Months"),
        F.when(k % 17 == 0, F.lower(_yes_no("is_active"))).otherwise(_yes_no("is_active")).alias("IsActive"))


def render_transactions(fact: DataFrame, dim_customers: DataFrame, dim_product: DataFrame) -> DataFrame:
    return render_named(fact.join(dim_customers.select("customer_key", "customer_id"), "customer_key"), dim_product)


def transactions_text(star: Star) -> DataFrame:
    """Staging text of a star's transactions.  Where the star has them with
    their customers' ids (``sources.testdata.NAMED``), whole facts are not
    shuffled once more by customer; the rows are the same."""
    if NAMED in star:
        return render_named(star[NAMED], star["dim_product"])
    return render_transactions(star["fact_transactions"], star["dim_customers"], star["dim_product"])


def render_named(fact: DataFrame, dim_product: DataFrame) -> DataFrame:
    """Staging text of transactions that have their customer_id."""
    j = fact.join(dim_product.select("product_key", "product_line", "category"), "product_key")
    k = F.col("customer_key")
    return j.select(
        F.concat(F.lit(" "), "transaction_id").alias("TransactionID"),
        F.when(k % 5 == 0, F.lower("customer_id")).otherwise(F.col("customer_id")).alias("CustomerID"),
        _dmy(_from_key("date_key")).alias("TransactionDate"), _txt("fiscal_year").alias("FiscalYear"),
        F.col("fiscal_quarter").alias("FiscalQuarter"), F.col("fiscal_month").alias("FiscalMonth"),
        F.col("category").alias("Category"), F.concat("product_line", F.lit("  ")).alias("ProductLine"),
        F.col("region").alias("Region"), F.col("segment").alias("Segment"), F.col("plan").alias("Plan"),
        _money("revenue_inr").alias("Revenue_INR"), _money("cogs_inr").alias("COGS_INR"),
        _money("gross_profit_inr").alias("GrossProfit_INR"), _txt("gross_margin_pct").alias("GrossMargin_Pct"),
        F.col("payment_status").alias("PaymentStatus"), F.col("invoice_id").alias("InvoiceID"))


def render_churn(fact_churn: DataFrame, dim_customers: DataFrame) -> DataFrame:
    c = dim_customers.select("customer_key", "customer_id", "company_name")
    j = fact_churn.join(c, "customer_key")
    return j.select(
        F.col("customer_id").alias("CustomerID"), F.col("company_name").alias("CompanyName"),
        F.col("plan").alias("Plan"), F.col("segment").alias("Segment"), F.col("region").alias("Region"),
        _dmy(_from_key("acquisition_date_key")).alias("AcquisitionDate"),
        _dmy(_from_key("churn_date_key")).alias("ChurnDate"), _txt("days_to_churn").alias("DaysToChurn"),
        _money("mrr_at_churn_inr").alias("MRR_AtChurn_INR"), _money("arr_at_churn_inr").alias("ARR_AtChurn_INR"),
        _money("revenue_recognized_inr").alias("RevenueRecognized_INR"),
        F.col("churn_reason").alias("ChurnReason"), F.col("churn_type").alias("ChurnType"),
        _yes_no("was_escalated").alias("WasEscalated"),
        _yes_no("exit_survey_completed").alias("ExitSurveyCompleted"),
        _yes_no("win_back_eligible").alias("WinBackEligible"),
        _txt("last_health_score").alias("LastHealthScore"),
        _txt("support_tickets_90d").alias("SupportTickets_Last90D"))


def render_budget(fact_budget: DataFrame) -> DataFrame:
    return fact_budget.select(
        _dmy(_from_key("date_key")).alias("Period"), _txt("fiscal_year").alias("FiscalYear"),
        F.col("fiscal_quarter").alias("FiscalQuarter"), F.col("month_label").alias("Month"),
        F.col("department").alias("Department"),
        _money("budgeted_revenue_inr").alias("BudgetedRevenue_INR"),
        _money("actual_revenue_inr").alias("ActualRevenue_INR"),
        _money("revenue_variance_inr").alias("RevenueVariance_INR"),
        _txt("revenue_variance_pct").alias("RevenueVariance_Pct"),
        _money("budgeted_opex_inr").alias("BudgetedOpEx_INR"), _money("actual_opex_inr").alias("ActualOpEx_INR"),
        _money("opex_variance_inr").alias("OpExVariance_INR"), _txt("opex_variance_pct").alias("OpExVariance_Pct"),
        _money("budgeted_ebitda_inr").alias("BudgetedEBITDA_INR"),
        _money("actual_ebitda_inr").alias("ActualEBITDA_INR"),
        _txt("headcount_budget").alias("HeadCount_Budget"), _txt("headcount_actual").alias("HeadCount_Actual"))


def staging_from_star(star: Star) -> dict[str, DataFrame]:
    return {"customers": render_customers(star["dim_customers"]),
            "transactions": transactions_text(star),
            "churn": render_churn(star["fact_churn"], star["dim_customers"]),
            "budget": render_budget(star["fact_budget_vs_actual"])}


def load_rejects(stg: dict[str, DataFrame], dim_customers: DataFrame, dim_product: DataFrame) -> dict[str, DataFrame]:
    """What a load leaves out, by staging table."""
    return {"transactions": reject_transactions(stg["transactions"], dim_customers, dim_product),
            "churn": reject_churn(stg["churn"], dim_customers)}


def load_star(stg: dict[str, DataFrame], dim_date: DataFrame, dim_product: DataFrame,
              surrogate: bool = True, spelling_path: str | None = None) -> Star:
    """Staging frames -> star schema (customers, then facts); ``load_rejects``
    has the rows that find no customer or product.  With ``spelling_path``, a
    folder kept across loads, free labels get one spelling each."""
    spellings = learn_spellings(stg["customers"].sparkSession, spelling_path, stg) if spelling_path else None
    cust = load_dim_customers(stg["customers"], surrogate=True, spellings=spellings)
    return {"dim_date": dim_date, "dim_product": dim_product, "dim_customers": cust,
            "fact_transactions": load_fact_transactions(stg["transactions"], cust, dim_product, surrogate),
            "fact_churn": load_fact_churn(stg["churn"], cust, surrogate, spellings),
            "fact_budget_vs_actual": load_fact_budget(stg["budget"], surrogate, spellings)}


# ---------------------------------------------------- registered load checks
def staging_scan(star: Star, table: str) -> DataFrame:
    """Staging text derived from the inputs, written as CSV (header, quoted
    fields, spaces kept) to a fresh folder under the shared checkpoint folder
    and scanned back with the declared all-string schema."""
    from finlake.session import scratch_dir
    from finlake.sources.staging import read_staging, write_staging
    stg = staging_from_star(star)[table]
    path = scratch_dir(stg.sparkSession, f"stg-{table}")
    write_staging(stg, path)
    return read_staging(stg.sparkSession, path, table)


def load_stg_customers(star: Star) -> DataFrame:
    return staging_scan(star, "customers")


def load_stg_transactions(star: Star) -> DataFrame:
    return staging_scan(star, "transactions")


def load_stg_churn(star: Star) -> DataFrame:
    return staging_scan(star, "churn")


def load_stg_budget(star: Star) -> DataFrame:
    return staging_scan(star, "budget")


def _loaded_customers(star: Star) -> DataFrame:
    return load_dim_customers(render_customers(star["dim_customers"]))


def q_load_dim_customers(star: Star) -> DataFrame:
    return present(_loaded_customers(star))


def q_load_fact_transactions(star: Star) -> DataFrame:
    return present(load_fact_transactions(transactions_text(star), _loaded_customers(star), star["dim_product"]))


def q_load_fact_churn(star: Star) -> DataFrame:
    return present(load_fact_churn(render_churn(star["fact_churn"], star["dim_customers"]), _loaded_customers(star)))


def q_load_fact_budget(star: Star) -> DataFrame:
    """Needs no customers, so none are loaded; nothing runs before the action."""
    return present(load_fact_budget(render_budget(star["fact_budget_vs_actual"])))


def load_write_read_back(star: Star) -> DataFrame:
    """The budget fact written as a warehouse table (audit columns, partitioned
    by year) and read in full with its declared types."""
    from finlake.session import scratch_dir
    from finlake.sources.staging import read_table, write_table
    fact = star["fact_budget_vs_actual"]
    path = scratch_dir(fact.sparkSession, "budget")
    write_table(fact, path, "fact_budget_vs_actual")
    return present(read_table(fact.sparkSession, path, "fact_budget_vs_actual").drop("bva_key"))


def dirty_staging(star: Star) -> DataFrame:
    """Staging text of transactions with dirty cells, made from every
    transaction by its customer's number: accented and upper-case ids, empty and unknown ids, empty
    transaction ids, labels in other cases, integers with fractions or beyond their type,
    empty and unreadable money and dates."""
    from finlake.session import scratch_dir
    from finlake.sources.staging import read_staging, write_staging
    clean = transactions_text(star)
    n = F.regexp_extract("CustomerID", "([0-9]+)", 1).cast("long")

    def dirty(c: str, *cases) -> Column:
        out = F.col(c)
        for mod, rest, value in cases:
            out = F.when(n % mod == rest, value).otherwise(out)
        return out.alias(c)

    cells = {
        "TransactionID": [(29, 3, F.lit(""))],
        "CustomerID": [(7, 1, F.concat(F.lit("c\u00fcst-"), n.cast("string"))), (7, 2, F.concat(F.lit("  CUST-"), n.cast("string"))),
                       (31, 5, F.lit("")), (37, 6, F.lit("CUST-unknown"))],
        "TransactionDate": [(41, 7, F.lit("")), (43, 8, F.lit("soon"))],
        "FiscalYear": [(11, 1, F.concat("FiscalYear", F.lit(".99999"))), (11, 2, F.lit("70000")), (11, 3, F.lit(""))],
        "Region": [(5, 1, F.upper("Region")), (5, 2, F.concat(F.lit(" "), F.lower("Region")))],
        "Plan": [(5, 3, F.lower("Plan"))],
        "Revenue_INR": [(47, 9, F.lit("")), (53, 10, F.lit("n/a"))],
        "InvoiceID": [(59, 11, F.lit(""))],
    }
    stg = clean.select(*[dirty(c, *cells.get(c, [])) for c in clean.columns])
    path = scratch_dir(stg.sparkSession, "stg-dirty")
    write_staging(stg, path)
    return read_staging(stg.sparkSession, path, "transactions")


def load_dirty_staging(star: Star) -> DataFrame:
    """Transactions loaded from staging text with dirty cells."""
    customers = star["dim_customers"].select("customer_id", "customer_key")
    return present(load_fact_transactions(dirty_staging(star), customers, star["dim_product"]))


def _counts(frames: list[tuple[str, DataFrame]], out: str) -> DataFrame:
    rows = [df.agg(F.count(F.lit(1)).alias(out)).select(F.lit(name).alias("table_name"), out)
            for name, df in frames]
    return reduce(DataFrame.unionByName, rows)


def load_counts_staging(star: Star) -> DataFrame:
    """Rows of the staging files, counted by scanning the files."""
    return _counts([(f"stg_{n}", staging_scan(star, n)) for n in ["customers", "transactions", "churn", "budget"]],
                   "row_count")


def load_counts_warehouse(star: Star) -> DataFrame:
    return _counts([(n, star[n]) for n in TABLE_ORDER], "rows_loaded")


def load_counts_single(star: Star, table: str = "fact_transactions") -> DataFrame:
    return star[table].agg(F.count(F.lit(1)).alias(f"{table}_loaded"))


def table_inventory(star: Star) -> DataFrame:
    rows = [star[n].agg(F.count(F.lit(1)).alias("row_count"))
            .select(F.lit(n).alias("table_name"), F.lit(TABLE_DESCRIPTIONS[n]).alias("description"), "row_count")
            for n in TABLE_ORDER]
    return reduce(DataFrame.unionByName, rows).orderBy("table_name")


def not_null_columns(table: str, df: DataFrame) -> list[str]:
    return [f.name for f in WAREHOUSE[table].fields
            if not f.nullable and f.name in df.columns and f.name not in SURROGATE_COLS]


def _written(df: DataFrame, name: str) -> DataFrame:
    from finlake.session import scratch_dir
    path = scratch_dir(df.sparkSession, f"once-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def check_constraints(star: Star) -> DataFrame:
    """Declared constraints as jobs: NOT NULL, enum domains, text lengths,
    foreign keys (orphan rows) and the uniqueness of the natural and the
    primary key.

    The rules of a table are flags on its rows (referenced keys are left-joined
    once), counted by one aggregation without a key, so no row is shuffled for
    them.  Keys are read on their own and screened by a hash
    (``duplicate_key_count``).  Customers and facts are read several times, so
    they are written once instead of being joined again for each reading."""
    star = star | {t: _written(star[t], t) for t in TABLE_ORDER if t not in ("dim_date", "dim_product")}
    parts: list[DataFrame] = []
    for t in TABLE_ORDER:
        df = star[t]
        rules = {f"not_null:{c}": f"`{c}` IS NULL" for c in not_null_columns(t, df)}
        for c, dom in ENUM_DOMAINS.get(t, {}).items():
            rules[f"enum:{c}"] = f"`{c}` NOT IN ({', '.join(repr(v) for v in dom)})"
        rules |= {f"length:{c}": f"length(`{c}`) > {n}" for c, n in TEXT_LENGTHS[t].items()}
        j = df
        for i, ((tt, c), (dt, dc)) in enumerate(FOREIGN_KEYS.items()):
            if tt != t:
                continue
            dim = star.get("dim_date_loaded", star["dim_date"]) if dt == "dim_date" else star[dt]
            d = dim.select(F.col(dc).alias(f"__fk{i}")).distinct()
            j = j.join(d, j[c] == d[f"__fk{i}"], "left")
            rules[f"fk:{c}->{dt}.{dc}"] = f"__fk{i} IS NULL"
        natural, primary = UNIQUE_KEYS[t], PRIMARY_KEYS[t]
        total = j.selectExpr(*[f"count_if({p}) AS _r{i}" for i, p in enumerate(rules.values())])
        said = [(r, f"_r{i}") for i, r in enumerate(rules)]
        for keys, rule in ((natural, f"unique:{','.join(natural)}"), ([primary], f"primary:{primary}")):
            counted = f"_n{len(said)}"
            if keys == natural or natural != [primary]:
                total = total.crossJoin(duplicate_key_count(df, keys).withColumnRenamed("duplicates", counted))  # one row each
            else:
                counted = said[-1][1]
            said.append((rule, counted))
        rows = ", ".join(f"'{r}', {n}" for r, n in said)
        parts.append(total.selectExpr(f"stack({len(said)}, {rows}) AS (rule, violations)")
                     .selectExpr(f"'{t}' AS table_name", "rule", "violations"))
    return reduce(DataFrame.unionByName, parts)


def load_product_seed(spark, sf_dir: str) -> DataFrame:
    """All seeded products, with the number of parts of each one's brand
    (Brand#n is product n of the seed)."""
    from finlake.sources.seed import product_seed
    used = (spark.read.parquet(f"{sf_dir}/part.parquet")
            .groupBy(F.substring("p_brand", 7, 3).cast("int").alias("product_key")).agg(F.count(F.lit(1)).alias("parts")))
    return present(product_seed(spark).join(used, "product_key", "left").withColumn("parts", F.coalesce("parts", F.lit(0).cast("long"))))
