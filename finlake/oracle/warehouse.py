"""Oracle SQL: calendar, loads, counts, inventory, constraints.  Column lists,
domains, keys and lengths are stated here again, so that a wrong one in the
library's schemas does not pass."""
from __future__ import annotations

from finlake.oracle.prelude import sql

# ---- fixed values: columns in order, with the type that is shown (None: as it is) ----
_COLUMNS = {
    "dim_date": {
        "date_key": "INTEGER",
        "full_date": None,
        "day_of_week": "INTEGER",
        "day_name": None,
        "day_of_month": "INTEGER",
        "day_of_year": "INTEGER",
        "week_of_year": "INTEGER",
        "month_num": "INTEGER",
        "month_name": None,
        "month_short": None,
        "fiscal_month_label": None,
        "quarter_num": "INTEGER",
        "quarter_label": None,
        "fiscal_year": "INTEGER",
        "fiscal_year_quarter": None,
        "is_weekend": "INTEGER",
        "is_month_end": "INTEGER",
        "is_quarter_end": "INTEGER",
        "is_year_end": "INTEGER",
    },
    "dim_customers": {
        "customer_key": "INTEGER",
        "customer_id": None,
        "company_name": None,
        "plan": None,
        "segment": None,
        "industry": None,
        "region": None,
        "acquisition_date": None,
        "acquisition_channel": None,
        "mrr_inr": "DOUBLE",
        "arr_inr": "DOUBLE",
        "contract_length_months": "INTEGER",
        "health_score": "DOUBLE",
        "health_status": None,
        "csm_owner": None,
        "nps_score": "INTEGER",
        "last_login_days_ago": "INTEGER",
        "avg_monthly_logins": "DOUBLE",
        "support_tickets_90d": "INTEGER",
        "expected_cltv_months": "INTEGER",
        "is_active": "INTEGER",
    },
    "dim_product": {
        "product_key": "INTEGER",
        "product_line": None,
        "category": None,
        "is_recurring": "INTEGER",
        "cogs_pct_std": "DOUBLE",
        "product_group": None,
    },
    "fact_transactions": {
        "transaction_key": "BIGINT",
        "transaction_id": None,
        "invoice_id": None,
        "customer_key": "INTEGER",
        "product_key": "INTEGER",
        "date_key": "INTEGER",
        "fiscal_year": "INTEGER",
        "fiscal_quarter": None,
        "fiscal_month": None,
        "region": None,
        "segment": None,
        "plan": None,
        "payment_status": None,
        "revenue_inr": "DOUBLE",
        "cogs_inr": "DOUBLE",
        "gross_profit_inr": "DOUBLE",
        "gross_margin_pct": "DOUBLE",
    },
    "fact_churn": {
        "churn_key": "BIGINT",
        "customer_key": "INTEGER",
        "acquisition_date_key": "INTEGER",
        "churn_date_key": "INTEGER",
        "plan": None,
        "segment": None,
        "region": None,
        "churn_reason": None,
        "churn_type": None,
        "was_escalated": "INTEGER",
        "exit_survey_completed": "INTEGER",
        "win_back_eligible": "INTEGER",
        "days_to_churn": "INTEGER",
        "mrr_at_churn_inr": "DOUBLE",
        "arr_at_churn_inr": "DOUBLE",
        "revenue_recognized_inr": "DOUBLE",
        "last_health_score": "DOUBLE",
        "support_tickets_90d": "INTEGER",
    },
    "fact_budget_vs_actual": {
        "bva_key": "BIGINT",
        "date_key": "INTEGER",
        "fiscal_year": "INTEGER",
        "fiscal_quarter": None,
        "month_label": None,
        "department": None,
        "budgeted_revenue_inr": "DOUBLE",
        "actual_revenue_inr": "DOUBLE",
        "revenue_variance_inr": "DOUBLE",
        "revenue_variance_pct": "DOUBLE",
        "budgeted_opex_inr": "DOUBLE",
        "actual_opex_inr": "DOUBLE",
        "opex_variance_inr": "DOUBLE",
        "opex_variance_pct": "DOUBLE",
        "budgeted_ebitda_inr": "DOUBLE",
        "actual_ebitda_inr": "DOUBLE",
        "headcount_budget": "INTEGER",
        "headcount_actual": "INTEGER",
    },
}
_KEYS_ONLY = {"transaction_key", "churn_key", "bva_key"}  # surrogate keys, left out of loads

# ---- fixed values: words of the inventory, in table order ----
_DESCRIPTIONS = {
    "dim_date": "Calendar dimension",
    "dim_customers": "Customer master",
    "dim_product": "Product and revenue category dimension",
    "fact_transactions": "Revenue fact table",
    "fact_churn": "Churn event fact",
    "fact_budget_vs_actual": "Budget vs Actual fact - monthly department level",
}

# ---- fixed values: enum domains, lengths of texts, keys and references ----
_DOMAINS = {
    ("dim_customers", "plan"): ["Starter", "Growth", "Business", "Enterprise"],
    ("dim_customers", "segment"): ["SMB", "Mid-Market", "Enterprise"],
    ("dim_customers", "region"): ["North", "South", "East", "West", "Central"],
    ("dim_customers", "health_status"): ["Healthy", "At Risk", "Critical"],
    ("fact_transactions", "payment_status"): ["Paid", "Pending", "Overdue"],
    ("fact_churn", "churn_type"): ["Voluntary", "Involuntary"],
}
_LENGTHS = {
    "dim_date": {
        "day_name": 10,
        "month_name": 10,
        "month_short": 3,
        "fiscal_month_label": 10,
        "quarter_label": 2,
        "fiscal_year_quarter": 7,
    },
    "dim_customers": {
        "customer_id": 12,
        "company_name": 150,
        "industry": 50,
        "acquisition_channel": 30,
        "csm_owner": 100,
    },
    "dim_product": {
        "product_line": 30,
        "category": 30,
        "product_group": 30,
    },
    "fact_transactions": {
        "transaction_id": 12,
        "invoice_id": 12,
        "fiscal_quarter": 2,
        "fiscal_month": 10,
        "region": 10,
        "segment": 15,
        "plan": 12,
    },
    "fact_churn": {
        "plan": 12,
        "segment": 15,
        "region": 10,
        "churn_reason": 30,
    },
    "fact_budget_vs_actual": {
        "fiscal_quarter": 2,
        "month_label": 10,
        "department": 30,
    },
}
_NATURAL = {
    "dim_date": "date_key",
    "dim_customers": "customer_id",
    "dim_product": "product_line,category",
    "fact_transactions": "transaction_id",
    "fact_churn": "customer_key",
    "fact_budget_vs_actual": "date_key,department",
}
# primary key, and the columns that stand for it here: hashed keys follow from what they hash
_PRIMARY = {
    "dim_date": ("date_key", "date_key"),
    "dim_customers": ("customer_key", "customer_key"),
    "dim_product": ("product_key", "product_key"),
    "fact_transactions": ("transaction_key", "transaction_key"),
    "fact_churn": ("churn_key", "churn_key"),
    "fact_budget_vs_actual": ("bva_key", "date_key, department"),
}
_REFERENCES = [
    ("fact_transactions", "customer_key", "dim_customers", "customer_key"),
    ("fact_transactions", "product_key", "dim_product", "product_key"),
    ("fact_transactions", "date_key", "dim_date", "date_key"),
    ("fact_churn", "customer_key", "dim_customers", "customer_key"),
    ("fact_churn", "acquisition_date_key", "dim_date", "date_key"),
    ("fact_churn", "churn_date_key", "dim_date", "date_key"),
    ("fact_budget_vs_actual", "date_key", "dim_date", "date_key"),
]


def _present(table: str, alias: str = "", skip=(), override: dict | None = None) -> str:
    """Output types: small integers as INTEGER, decimals as DOUBLE."""
    said = {c: (override or {}).get(c, alias + c) for c in _COLUMNS[table] if c not in skip}
    kind = _COLUMNS[table]
    return ", ".join(f"CAST({x} AS {kind[c]}) AS {c}" if kind[c] else f"{x} AS {c}" for c, x in said.items())


Q = {}
Q["load_dim_date"] = sql(f"SELECT {_present('dim_date')} FROM dim_date")
Q["verify_calendar"] = sql("""
SELECT CAST(fiscal_year AS INTEGER) AS fiscal_year, COUNT(*) AS total_days,
       COUNT(CASE WHEN is_weekend = 1 THEN 1 END) AS weekend_days,
       COUNT(CASE WHEN is_month_end = 1 THEN 1 END) AS month_ends,
       COUNT(CASE WHEN is_quarter_end = 1 THEN 1 END) AS quarter_ends
FROM dim_date GROUP BY fiscal_year""")
Q["sample_calendar"] = sql(f"""
p AS (SELECT {_present('dim_date')} FROM dim_date),
f AS (SELECT 'FIRST 5' AS sample_set, * FROM p ORDER BY date_key ASC LIMIT 5),
l AS (SELECT 'LAST 5' AS sample_set, * FROM p ORDER BY date_key DESC LIMIT 5)
SELECT * FROM f UNION ALL SELECT * FROM l""")

_NEWKEY = "nk AS (SELECT customer_key AS old_key, ROW_NUMBER() OVER (ORDER BY customer_id) AS new_key FROM dim_customers)"
Q["load_dim_customers"] = sql(f"""{_NEWKEY}
SELECT {_present('dim_customers', 'c.', override={'customer_key': 'nk.new_key'})}
FROM dim_customers c JOIN nk ON c.customer_key = nk.old_key""")
Q["load_fact_transactions"] = sql(f"""{_NEWKEY}
SELECT {_present('fact_transactions', 't.', skip=_KEYS_ONLY, override={'customer_key': 'nk.new_key'})}
FROM fact_transactions t JOIN nk ON t.customer_key = nk.old_key""")
Q["load_fact_churn"] = sql(f"""{_NEWKEY}
SELECT {_present('fact_churn', 'ch.', skip=_KEYS_ONLY, override={'customer_key': 'nk.new_key'})}
FROM fact_churn ch JOIN nk ON ch.customer_key = nk.old_key""")
Q["load_fact_budget"] = sql(f"SELECT {_present('fact_budget_vs_actual', skip=_KEYS_ONLY)} "
                            "FROM fact_budget_vs_actual")


def _counts(pairs, out):
    return " UNION ALL ".join(f"SELECT '{n}' AS table_name, COUNT(*) AS {out} FROM {t}" for n, t in pairs)


Q["load_counts_staging"] = sql(_counts([("stg_customers", "dim_customers"),
                                        ("stg_transactions", "fact_transactions"),
                                        ("stg_churn", "fact_churn"),
                                        ("stg_budget", "fact_budget_vs_actual")], "row_count"))
Q["load_counts_warehouse"] = sql(_counts([(t, t) for t in _COLUMNS], "rows_loaded"))
Q["load_counts_single"] = sql("SELECT COUNT(*) AS fact_transactions_loaded FROM fact_transactions")
Q["table_inventory"] = sql(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{words}' AS description, COUNT(*) AS row_count FROM {t}"
    for t, words in _DESCRIPTIONS.items()))


def _rule(table: str, rule: str, counted: str) -> str:
    return f"SELECT '{table}' AS table_name, '{rule}' AS rule, CAST(({counted}) AS BIGINT) AS violations"


def _repeated(table: str, key: str) -> str:
    return f"SELECT COUNT(*) FROM (SELECT 1 FROM {table} GROUP BY {key} HAVING COUNT(*) > 1)"


def _constraints() -> str:
    parts = []
    for t, columns in _COLUMNS.items():
        for c in columns:
            if c not in _KEYS_ONLY:
                parts.append(_rule(t, f"not_null:{c}", f"SELECT COUNT(*) FROM {t} WHERE {c} IS NULL"))
        for c, n in _LENGTHS[t].items():
            parts.append(_rule(t, f"length:{c}", f"SELECT COUNT(*) FROM {t} WHERE length({c}) > {n}"))
        parts.append(_rule(t, f"unique:{_NATURAL[t]}", _repeated(t, _NATURAL[t])))
        name, columns = _PRIMARY[t]
        parts.append(_rule(t, f"primary:{name}", _repeated(t, columns)))
    for (t, c), names in _DOMAINS.items():
        parts.append(_rule(t, f"enum:{c}", f"SELECT COUNT(*) FROM {t} WHERE NOT list_contains({names}, {c})"))
    for t, c, dim, key in _REFERENCES:
        source = "dim_date_loaded" if dim == "dim_date" else dim
        parts.append(_rule(t, f"fk:{c}->{dim}.{key}", f"SELECT COUNT(*) FROM {t} f WHERE NOT EXISTS (FROM {source} d WHERE d.{key} = f.{c})"))
    return "\nUNION ALL ".join(parts)


Q["check_constraints"] = sql(_constraints(), defects=True)


def read_in_full(table: str) -> str:
    return sql(f"SELECT {_present(table, skip=_KEYS_ONLY)} FROM {table}")


Q["load_write_read_back"] = read_in_full("fact_budget_vs_actual")
Q["load_product_seed"] = sql("""
brand AS (SELECT CAST(substr(p_brand, 7, 3) AS INTEGER) AS product_key, COUNT(*) AS parts FROM part GROUP BY ALL)
SELECT CAST(p.product_key AS INTEGER) AS product_key, p.product_line, p.category,
       CAST(p.is_recurring AS INTEGER) AS is_recurring, CAST(p.cogs_pct_std AS DOUBLE) AS cogs_pct_std,
       p.product_group, COALESCE(brand.parts, 0) AS parts
FROM dim_product p LEFT JOIN brand ON brand.product_key = p.product_key""")

# what a loader must make of the dirty cells, stated cell by cell from the customer's number
Q["load_dirty_staging"] = sql("""
t AS (SELECT *, customer_key AS n FROM fact_transactions)
SELECT CASE WHEN n % 29 = 3 THEN '' ELSE transaction_id END AS transaction_id,
       CASE WHEN n % 59 = 11 THEN '' ELSE invoice_id END AS invoice_id,
       customer_key, product_key,
       CASE WHEN n % 41 = 7 OR n % 43 = 8 THEN NULL ELSE date_key END AS date_key,
       CASE WHEN n % 11 IN (2, 3) THEN NULL ELSE CAST(fiscal_year AS INTEGER) END AS fiscal_year,
       fiscal_quarter, fiscal_month, region, segment, plan, payment_status,
       CASE WHEN n % 47 = 9 OR n % 53 = 10 THEN NULL ELSE CAST(revenue_inr AS DOUBLE) END AS revenue_inr,
       CAST(cogs_inr AS DOUBLE) AS cogs_inr, CAST(gross_profit_inr AS DOUBLE) AS gross_profit_inr,
       CAST(gross_margin_pct AS DOUBLE) AS gross_margin_pct
FROM t
WHERE n % 31 <> 5 AND n % 37 <> 6""")


# ---- staging text, rendered as finlake.plans.warehouse.render_* does ----
def _money(c: str) -> str:
    return f"format('{{:,.2f}}', {c})"


def _txt(c: str) -> str:
    return f"CAST({c} AS VARCHAR)"


def _dmy_key(c: str) -> str:
    return f"strftime(strptime(CAST({c} AS VARCHAR), '%Y%m%d'), '%d-%b-%Y')"


def _yn(c: str) -> str:
    return f"CASE WHEN {c} = 1 THEN 'Yes' ELSE 'No' END"


Q["load_stg_customers"] = sql(f"""
SELECT CASE WHEN customer_key % 7 = 0 THEN ' ' || customer_id || ' ' ELSE customer_id END AS CustomerID,
       company_name AS CompanyName, plan AS Plan, segment AS Segment, industry AS Industry, region AS Region,
       CASE WHEN customer_key % 11 = 0 THEN strftime(acquisition_date, '%Y-%m-%d')
            WHEN customer_key % 13 = 0 THEN upper(strftime(acquisition_date, '%-d-%b-%Y'))
            ELSE strftime(acquisition_date, '%d-%b-%Y') END AS AcquisitionDate,
       acquisition_channel AS AcquisitionChannel, {_money('mrr_inr')} AS MRR_INR, {_money('arr_inr')} AS ARR_INR,
       {_txt('contract_length_months')} AS ContractLength_Months, {_txt('health_score')} AS HealthScore,
       health_status AS HealthStatus, csm_owner AS CSM_Owner, {_txt('nps_score')} AS NPS_Score,
       {_txt('last_login_days_ago')} AS LastLoginDaysAgo, {_txt('avg_monthly_logins')} AS AvgMonthlyLogins,
       {_txt('support_tickets_90d')} AS SupportTickets_Last90D, {_txt('expected_cltv_months')} AS ExpectedCLTV_Months,
       CASE WHEN customer_key % 17 = 0 THEN lower({_yn('is_active')}) ELSE {_yn('is_active')} END AS IsActive
FROM dim_customers""")

Q["load_stg_transactions"] = sql(f"""
SELECT ' ' || t.transaction_id AS TransactionID,
       CASE WHEN t.customer_key % 5 = 0 THEN lower(c.customer_id) ELSE c.customer_id END AS CustomerID,
       {_dmy_key('t.date_key')} AS TransactionDate, {_txt('t.fiscal_year')} AS FiscalYear,
       t.fiscal_quarter AS FiscalQuarter, t.fiscal_month AS FiscalMonth, p.category AS Category,
       p.product_line || '  ' AS ProductLine, t.region AS Region, t.segment AS Segment, t.plan AS Plan,
       {_money('t.revenue_inr')} AS Revenue_INR, {_money('t.cogs_inr')} AS COGS_INR,
       {_money('t.gross_profit_inr')} AS GrossProfit_INR, {_txt('t.gross_margin_pct')} AS GrossMargin_Pct,
       t.payment_status AS PaymentStatus, t.invoice_id AS InvoiceID
FROM fact_transactions t JOIN dim_customers c ON t.customer_key = c.customer_key
JOIN dim_product p ON t.product_key = p.product_key""")

Q["load_stg_churn"] = sql(f"""
SELECT c.customer_id AS CustomerID, c.company_name AS CompanyName, ch.plan AS Plan, ch.segment AS Segment,
       ch.region AS Region, {_dmy_key('ch.acquisition_date_key')} AS AcquisitionDate,
       {_dmy_key('ch.churn_date_key')} AS ChurnDate, {_txt('ch.days_to_churn')} AS DaysToChurn,
       {_money('ch.mrr_at_churn_inr')} AS MRR_AtChurn_INR, {_money('ch.arr_at_churn_inr')} AS ARR_AtChurn_INR,
       {_money('ch.revenue_recognized_inr')} AS RevenueRecognized_INR, ch.churn_reason AS ChurnReason,
       ch.churn_type AS ChurnType, {_yn('ch.was_escalated')} AS WasEscalated,
       {_yn('ch.exit_survey_completed')} AS ExitSurveyCompleted, {_yn('ch.win_back_eligible')} AS WinBackEligible,
       {_txt('ch.last_health_score')} AS LastHealthScore, {_txt('ch.support_tickets_90d')} AS SupportTickets_Last90D
FROM fact_churn ch JOIN dim_customers c ON ch.customer_key = c.customer_key""")

Q["load_stg_budget"] = sql(f"""
SELECT {_dmy_key('date_key')} AS Period, {_txt('fiscal_year')} AS FiscalYear, fiscal_quarter AS FiscalQuarter,
       month_label AS Month, department AS Department,
       {_money('budgeted_revenue_inr')} AS BudgetedRevenue_INR, {_money('actual_revenue_inr')} AS ActualRevenue_INR,
       {_money('revenue_variance_inr')} AS RevenueVariance_INR, {_txt('revenue_variance_pct')} AS RevenueVariance_Pct,
       {_money('budgeted_opex_inr')} AS BudgetedOpEx_INR, {_money('actual_opex_inr')} AS ActualOpEx_INR,
       {_money('opex_variance_inr')} AS OpExVariance_INR, {_txt('opex_variance_pct')} AS OpExVariance_Pct,
       {_money('budgeted_ebitda_inr')} AS BudgetedEBITDA_INR, {_money('actual_ebitda_inr')} AS ActualEBITDA_INR,
       {_txt('headcount_budget')} AS HeadCount_Budget, {_txt('headcount_actual')} AS HeadCount_Actual
FROM fact_budget_vs_actual""")
