"""Oracle SQL of repeated and faulty loads, stated from the customer's number."""
from __future__ import annotations

from finlake.oracle import profitability, revenue, warehouse
from finlake.oracle.prelude import sql

Q = {}
Q["load_keyed_appends"] = sql("""
t AS (SELECT *, 1 AS times FROM fact_transactions UNION ALL SELECT *, 2 FROM fact_transactions WHERE customer_key % 7 = 0),
loads AS (
  SELECT CASE WHEN fiscal_year % 2 = 1 THEN 1 ELSE 2 END AS load, COUNT(*) AS n, CAST(SUM(revenue_inr) AS DOUBLE) AS revenue_inr
  FROM t GROUP BY 1)
SELECT load, n AS rows_loaded, n AS distinct_keys,
       CAST(COALESCE(SUM(n) OVER w, 0) + 1 AS BIGINT) AS first_key, CAST(COALESCE(SUM(n) OVER w, 0) + n AS BIGINT) AS last_key, revenue_inr
FROM loads WINDOW w AS (ORDER BY load ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")

# the cells that load_dirty_staging spoils, the later case of a column first, and ids beyond 12 characters
_FAULTS = """
t AS (SELECT *, customer_key AS n, CASE WHEN customer_key % 29 = 3 THEN '' ELSE transaction_id END AS tid,
             CASE WHEN customer_key % 59 = 11 THEN '' ELSE invoice_id END AS iid FROM fact_transactions),
faults AS (
  SELECT tid, iid, 'date_key' AS column_name, 'unreadable date' AS reason, 'soon' AS text FROM t WHERE n % 43 = 8
  UNION ALL SELECT tid, iid, 'date_key', 'empty', '' FROM t WHERE n % 41 = 7 AND n % 43 <> 8
  UNION ALL SELECT tid, iid, 'fiscal_year', 'out of range', '70000' FROM t WHERE n % 11 = 2
  UNION ALL SELECT tid, iid, 'fiscal_year', 'empty', '' FROM t WHERE n % 11 = 3
  UNION ALL SELECT tid, iid, 'revenue_inr', 'not a number', 'n/a' FROM t WHERE n % 53 = 10
  UNION ALL SELECT tid, iid, 'revenue_inr', 'empty', '' FROM t WHERE n % 47 = 9 AND n % 53 <> 10
  UNION ALL SELECT tid, iid, 'transaction_id', 'too long', ' ' || tid FROM t WHERE length(tid) > 12
  UNION ALL SELECT tid, iid, 'invoice_id', 'too long', iid FROM t WHERE length(iid) > 12)"""
Q["load_quarantine"] = sql(f"""{_FAULTS}
SELECT tid AS transaction_id, iid AS invoice_id, column_name, reason, text FROM faults""")
Q["load_fault_counts"] = sql(f"""{_FAULTS}
SELECT column_name, reason, COUNT(*) AS cells FROM faults GROUP BY ALL""")
Q["load_whole_rows"] = sql("""
t AS (SELECT *, customer_key AS n FROM fact_transactions)
SELECT CAST(fiscal_year AS INTEGER) AS fiscal_year, COUNT(*) AS rows_taken, CAST(SUM(revenue_inr) AS DOUBLE) AS revenue_inr FROM t
WHERE n % 43 <> 8 AND n % 41 <> 7 AND n % 11 NOT IN (2, 3) AND n % 53 <> 10 AND n % 47 <> 9
  AND (length(transaction_id) <= 12 OR n % 29 = 3) AND (length(invoice_id) <= 12 OR n % 59 = 11)
GROUP BY fiscal_year""")

Q["load_reload_changes"] = sql("""
t AS (
  SELECT transaction_id, any_value(customer_key) % 10 AS n, any_value(payment_status) AS payment_status
  FROM fact_transactions GROUP BY transaction_id),
k AS (
  SELECT CASE n WHEN 3 THEN 'new' WHEN 4 THEN 'absent' WHEN 5 THEN 'changed' ELSE 'same' END AS kind, n,
         CASE WHEN n = 5 THEN payment_status <> 'Paid' ELSE payment_status = 'Paid' END AS is_paid FROM t)
SELECT kind, COUNT(*) AS keys, COUNT(*) AS distinct_keys, COUNT(*) FILTER (WHERE n <> 3) AS from_first_load,
       COUNT(*) FILTER (WHERE n = 5) AS changed_later, COUNT(*) FILTER (WHERE is_paid) AS paid
FROM k GROUP BY kind""")


def _labels(column: str, source: str, number: str) -> str:
    """A label keeps the spelling of the first load, which has it as it is; one
    that only comes later takes the smallest of its spellings."""
    return f"""
SELECT '{column}' AS column_name,
       CASE WHEN bool_or({number} % 4 = 3) THEN {column} ELSE min(CASE {number} % 4 WHEN 0 THEN upper({column}) WHEN 1 THEN lower({column})
         ELSE replace({column}, 'e', 'é') END) END AS label, COUNT(*) AS rows_loaded
FROM {source} GROUP BY {column}"""


Q["load_label_spelling"] = sql(" UNION ALL ".join([
    _labels("industry", "dim_customers", "customer_key"), _labels("acquisition_channel", "dim_customers", "customer_key"),
    _labels("csm_owner", "dim_customers", "customer_key"), _labels("churn_reason", "fact_churn", "customer_key"),
    _labels("department", "fact_budget_vs_actual", "((date_key // 100) % 100)")]).strip())

Q["rev_distinct_by_sketch"] = sql(" UNION ALL ".join(
    f"SELECT CAST(fiscal_year AS INTEGER) AS fiscal_year, '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_ids, 1 AS within_bound "
    "FROM fact_transactions GROUP BY fiscal_year" for c in ("transaction_id", "customer_key")))
# the same rows as the statements that read the tables themselves
Q["rev_monthly_from_rollup"] = revenue.Q["rev_monthly_ytd_mom"]
Q["catalog_inventory"] = warehouse.Q["table_inventory"]
Q["rev_by_industry_colocated"] = revenue.Q["rev_by_industry"]
Q["prf_clv_plan_colocated"] = profitability.Q["prf_clv_plan"]
Q["prf_clv_top20_colocated"] = profitability.Q["prf_clv_top20"]
for _t in ("dim_date", "dim_customers", "dim_product", "fact_transactions", "fact_churn"):
    Q[f"load_read_back_{_t}"] = warehouse.read_in_full(_t)
