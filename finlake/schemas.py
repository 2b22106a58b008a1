"""Declared schemas of the star schema and of the all-string staging tables.

Nothing is inferred: staging files are read with these StructTypes and the
loaders cast to the warehouse types below.
"""
from __future__ import annotations

from pyspark.sql.types import (ByteType, DateType, DecimalType, IntegerType,
                               LongType, ShortType, StringType, StructField,
                               StructType)

# ---- fixed values: enum domains in declaration order (ENUM sorts by index) ----
PLANS = ["Starter", "Growth", "Business", "Enterprise"]
SEGMENTS = ["SMB", "Mid-Market", "Enterprise"]
REGIONS = ["North", "South", "East", "West", "Central"]
HEALTH_STATUSES = ["Healthy", "At Risk", "Critical"]
PAYMENT_STATUSES = ["Paid", "Pending", "Overdue"]
CHURN_TYPES = ["Voluntary", "Involuntary"]

ENUM_DOMAINS = {
    "dim_customers": {"plan": PLANS, "segment": SEGMENTS, "region": REGIONS,
                      "health_status": HEALTH_STATUSES},
    "fact_transactions": {"payment_status": PAYMENT_STATUSES},
    "fact_churn": {"churn_type": CHURN_TYPES},
}


def _s(names):
    return StructType([StructField(n, StringType(), True) for n in names])


# ---- fixed values: staging columns, every one a nullable string, in file order ----
STG_CUSTOMERS = _s([
    "CustomerID", "CompanyName", "Plan", "Segment", "Industry", "Region",
    "AcquisitionDate", "AcquisitionChannel", "MRR_INR", "ARR_INR",
    "ContractLength_Months", "HealthScore", "HealthStatus", "CSM_Owner",
    "NPS_Score", "LastLoginDaysAgo", "AvgMonthlyLogins",
    "SupportTickets_Last90D", "ExpectedCLTV_Months", "IsActive"])
STG_TRANSACTIONS = _s([
    "TransactionID", "CustomerID", "TransactionDate", "FiscalYear",
    "FiscalQuarter", "FiscalMonth", "Category", "ProductLine", "Region",
    "Segment", "Plan", "Revenue_INR", "COGS_INR", "GrossProfit_INR",
    "GrossMargin_Pct", "PaymentStatus", "InvoiceID"])
STG_CHURN = _s([
    "CustomerID", "CompanyName", "Plan", "Segment", "Region",
    "AcquisitionDate", "ChurnDate", "DaysToChurn", "MRR_AtChurn_INR",
    "ARR_AtChurn_INR", "RevenueRecognized_INR", "ChurnReason", "ChurnType",
    "WasEscalated", "ExitSurveyCompleted", "WinBackEligible",
    "LastHealthScore", "SupportTickets_Last90D"])
STG_BUDGET = _s([
    "Period", "FiscalYear", "FiscalQuarter", "Month", "Department",
    "BudgetedRevenue_INR", "ActualRevenue_INR", "RevenueVariance_INR",
    "RevenueVariance_Pct", "BudgetedOpEx_INR", "ActualOpEx_INR",
    "OpExVariance_INR", "OpExVariance_Pct", "BudgetedEBITDA_INR",
    "ActualEBITDA_INR", "HeadCount_Budget", "HeadCount_Actual"])

STAGING = {"customers": STG_CUSTOMERS, "transactions": STG_TRANSACTIONS,
           "churn": STG_CHURN, "budget": STG_BUDGET}


def _f(n, t):
    return StructField(n, t, False)


D = DecimalType
# ---- fixed values: declared columns and types of the warehouse tables ----
# (budget amounts and head counts are wider than declared: they are sums over a month)
DIM_DATE = StructType([
    _f("date_key", IntegerType()), _f("full_date", DateType()),
    _f("day_of_week", ByteType()), _f("day_name", StringType()),
    _f("day_of_month", ByteType()), _f("day_of_year", ShortType()),
    _f("week_of_year", ByteType()), _f("month_num", ByteType()),
    _f("month_name", StringType()), _f("month_short", StringType()),
    _f("fiscal_month_label", StringType()), _f("quarter_num", ByteType()),
    _f("quarter_label", StringType()), _f("fiscal_year", ShortType()),
    _f("fiscal_year_quarter", StringType()), _f("is_weekend", ByteType()),
    _f("is_month_end", ByteType()), _f("is_quarter_end", ByteType()),
    _f("is_year_end", ByteType())])

DIM_PRODUCT = StructType([
    _f("product_key", IntegerType()), _f("product_line", StringType()),
    _f("category", StringType()), _f("is_recurring", ByteType()),
    _f("cogs_pct_std", D(5, 2)), _f("product_group", StringType())])

DIM_CUSTOMERS = StructType([
    _f("customer_key", IntegerType()), _f("customer_id", StringType()),
    _f("company_name", StringType()), _f("plan", StringType()),
    _f("segment", StringType()), _f("industry", StringType()),
    _f("region", StringType()), _f("acquisition_date", DateType()),
    _f("acquisition_channel", StringType()), _f("mrr_inr", D(12, 2)),
    _f("arr_inr", D(14, 2)), _f("contract_length_months", ByteType()),
    _f("health_score", D(5, 1)), _f("health_status", StringType()),
    _f("csm_owner", StringType()), _f("nps_score", ShortType()),
    _f("last_login_days_ago", ShortType()), _f("avg_monthly_logins", D(6, 1)),
    _f("support_tickets_90d", ByteType()), _f("expected_cltv_months", ByteType()),
    _f("is_active", ByteType())])

FACT_TRANSACTIONS = StructType([
    _f("transaction_key", LongType()), _f("transaction_id", StringType()),
    _f("invoice_id", StringType()), _f("customer_key", IntegerType()),
    _f("product_key", IntegerType()), _f("date_key", IntegerType()),
    _f("fiscal_year", ShortType()), _f("fiscal_quarter", StringType()),
    _f("fiscal_month", StringType()), _f("region", StringType()),
    _f("segment", StringType()), _f("plan", StringType()),
    _f("payment_status", StringType()), _f("revenue_inr", D(14, 2)),
    _f("cogs_inr", D(14, 2)), _f("gross_profit_inr", D(14, 2)),
    _f("gross_margin_pct", D(6, 2))])

FACT_CHURN = StructType([
    _f("churn_key", LongType()), _f("customer_key", IntegerType()),
    _f("acquisition_date_key", IntegerType()), _f("churn_date_key", IntegerType()),
    _f("plan", StringType()), _f("segment", StringType()), _f("region", StringType()),
    _f("churn_reason", StringType()), _f("churn_type", StringType()),
    _f("was_escalated", ByteType()), _f("exit_survey_completed", ByteType()),
    _f("win_back_eligible", ByteType()), _f("days_to_churn", ShortType()),
    _f("mrr_at_churn_inr", D(12, 2)), _f("arr_at_churn_inr", D(14, 2)),
    _f("revenue_recognized_inr", D(14, 2)), _f("last_health_score", D(5, 1)),
    _f("support_tickets_90d", ByteType())])

FACT_BUDGET = StructType([
    _f("bva_key", LongType()), _f("date_key", IntegerType()),
    _f("fiscal_year", ShortType()), _f("fiscal_quarter", StringType()),
    _f("month_label", StringType()), _f("department", StringType()),
    _f("budgeted_revenue_inr", D(20, 2)), _f("actual_revenue_inr", D(20, 2)),
    _f("revenue_variance_inr", D(20, 2)), _f("revenue_variance_pct", D(7, 2)),
    _f("budgeted_opex_inr", D(20, 2)), _f("actual_opex_inr", D(20, 2)),
    _f("opex_variance_inr", D(20, 2)), _f("opex_variance_pct", D(7, 2)),
    _f("budgeted_ebitda_inr", D(20, 2)), _f("actual_ebitda_inr", D(20, 2)),
    _f("headcount_budget", IntegerType()), _f("headcount_actual", IntegerType())])

WAREHOUSE = {"dim_date": DIM_DATE, "dim_product": DIM_PRODUCT,
             "dim_customers": DIM_CUSTOMERS, "fact_transactions": FACT_TRANSACTIONS,
             "fact_churn": FACT_CHURN, "fact_budget_vs_actual": FACT_BUDGET}

# natural / unique keys declared on the warehouse tables
UNIQUE_KEYS = {
    "dim_date": ["date_key"],
    "dim_customers": ["customer_id"],
    "dim_product": ["product_line", "category"],
    "fact_transactions": ["transaction_id"],
    "fact_churn": ["customer_key"],
    "fact_budget_vs_actual": ["date_key", "department"],
}
PRIMARY_KEYS = {
    "dim_date": "date_key", "dim_customers": "customer_key", "dim_product": "product_key",
    "fact_transactions": "transaction_key", "fact_churn": "churn_key", "fact_budget_vs_actual": "bva_key",
}
# ---- fixed values: declared lengths of text columns ----
TEXT_LENGTHS = {
    "dim_date": {"day_name": 10, "month_name": 10, "month_short": 3, "fiscal_month_label": 10, "quarter_label": 2,
                 "fiscal_year_quarter": 7},
    "dim_customers": {"customer_id": 12, "company_name": 150, "industry": 50, "acquisition_channel": 30, "csm_owner": 100},
    "dim_product": {"product_line": 30, "category": 30, "product_group": 30},
    "fact_transactions": {"transaction_id": 12, "invoice_id": 12, "fiscal_quarter": 2, "fiscal_month": 10, "region": 10,
                          "segment": 15, "plan": 12},
    "fact_churn": {"plan": 12, "segment": 15, "region": 10, "churn_reason": 30},
    "fact_budget_vs_actual": {"fiscal_quarter": 2, "month_label": 10, "department": 30},
}
# (table, column) -> (dimension, dimension column)
FOREIGN_KEYS = {
    ("fact_transactions", "customer_key"): ("dim_customers", "customer_key"),
    ("fact_transactions", "product_key"): ("dim_product", "product_key"),
    ("fact_transactions", "date_key"): ("dim_date", "date_key"),
    ("fact_churn", "customer_key"): ("dim_customers", "customer_key"),
    ("fact_churn", "acquisition_date_key"): ("dim_date", "date_key"),
    ("fact_churn", "churn_date_key"): ("dim_date", "date_key"),
    ("fact_budget_vs_actual", "date_key"): ("dim_date", "date_key"),
}
