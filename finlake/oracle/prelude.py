"""The star schema as DuckDB CTEs over the driver's tables (mirror of
``finlake.sources.testdata``)."""
from __future__ import annotations

from finlake.oracle.sqlfn import as_decimal, pct_units, units

_CLEAN = """
ord AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS odate
  FROM orders),
ho AS (
  SELECT o_custkey, MIN(odate) AS first_d, MAX(odate) AS last_d,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))) AS DECIMAL(14,2)) AS rec
  FROM ord GROUP BY o_custkey),
cust_raw AS (
  SELECT c.c_custkey AS k, c.c_name, c.c_mktsegment, c.c_acctbal, r.r_name, h.first_d, h.last_d, h.rec,
         CAST((c.c_custkey * 37) % 1001 AS DECIMAL(6,0)) * 0.1 AS hs,
         CAST(CAST(c.c_acctbal AS DECIMAL(12,2)) + 1000 AS DECIMAL(12,2)) AS mrr
  FROM customer c
  JOIN ho h ON c.c_custkey = h.o_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey),
cust_base AS (
  SELECT CAST(k AS INTEGER) AS customer_key,
         'CUST-' || CAST(k AS VARCHAR) AS customer_id,
         c_name AS company_name,
         (['Starter','Growth','Business','Enterprise'])[k % 4 + 1] AS plan,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'SMB' WHEN 'BUILDING' THEN 'SMB'
              WHEN 'FURNITURE' THEN 'Mid-Market' WHEN 'HOUSEHOLD' THEN 'Mid-Market'
              WHEN 'MACHINERY' THEN 'Enterprise' END AS segment,
         c_mktsegment AS industry,
         CASE r_name WHEN 'AFRICA' THEN 'South' WHEN 'AMERICA' THEN 'West' WHEN 'ASIA' THEN 'East'
              WHEN 'EUROPE' THEN 'North' WHEN 'MIDDLE EAST' THEN 'Central' END AS region,
         first_d AS acquisition_date,
         'CH-' || CAST(k % 5 AS VARCHAR) AS acquisition_channel,
         mrr AS mrr_inr,
         CAST(mrr * 12 AS DECIMAL(14,2)) AS arr_inr,
         CAST(12 * (1 + k % 3) AS TINYINT) AS contract_length_months,
         CAST(hs AS DECIMAL(5,1)) AS health_score,
         CASE WHEN hs >= 70 THEN 'Healthy' WHEN hs >= 40 THEN 'At Risk' ELSE 'Critical' END AS health_status,
         'CSM-' || CAST(k % 10 AS VARCHAR) AS csm_owner,
         CAST((k * 53) % 201 - 100 AS SMALLINT) AS nps_score,
         CAST((k * 29) % 120 AS SMALLINT) AS last_login_days_ago,
         CAST(CAST((k * 17) % 400 AS DECIMAL(6,0)) * 0.1 AS DECIMAL(6,1)) AS avg_monthly_logins,
         CAST((k * 13) % 15 AS TINYINT) AS support_tickets_90d,
         CAST(12 + k % 49 AS TINYINT) AS expected_cltv_months,
         CAST(CASE WHEN last_d < DATE '2001-02-01' THEN 0 ELSE 1 END AS TINYINT) AS is_active,
         first_d, last_d, rec
  FROM cust_raw),
dim_customers_clean AS (
  SELECT customer_key, customer_id, company_name, plan, segment, industry, region, acquisition_date,
         acquisition_channel, mrr_inr, arr_inr, contract_length_months, health_score, health_status,
         csm_owner, nps_score, last_login_days_ago, avg_monthly_logins, support_tickets_90d,
         expected_cltv_months, is_active
  FROM cust_base),
-- fixed values: the seed rows, in seed order
dim_product AS (
  SELECT * FROM (VALUES
    (1,'Core Platform','Subscription',1,22.00,'Revenue'),
    (2,'Analytics Add-on','Subscription',1,22.00,'Revenue'),
    (3,'API Suite','Subscription',1,22.00,'Revenue'),
    (4,'Mobile Module','Subscription',1,22.00,'Revenue'),
    (5,'Compliance Pack','Subscription',1,22.00,'Revenue'),
    (6,'Core Platform','Professional Services',0,55.00,'Services'),
    (7,'Analytics Add-on','Professional Services',0,55.00,'Services'),
    (8,'API Suite','Professional Services',0,55.00,'Services'),
    (9,'Mobile Module','Professional Services',0,55.00,'Services'),
    (10,'Compliance Pack','Professional Services',0,55.00,'Services'),
    (11,'Core Platform','Training',0,40.00,'Services'),
    (12,'Analytics Add-on','Training',0,40.00,'Services'),
    (13,'API Suite','Training',0,40.00,'Services'),
    (14,'Mobile Module','Training',0,40.00,'Services'),
    (15,'Compliance Pack','Training',0,40.00,'Services'),
    (16,'Core Platform','Support Premium',1,30.00,'Revenue'),
    (17,'Analytics Add-on','Support Premium',1,30.00,'Revenue'),
    (18,'API Suite','Support Premium',1,30.00,'Revenue'),
    (19,'Mobile Module','Support Premium',1,30.00,'Revenue'),
    (20,'Compliance Pack','Support Premium',1,30.00,'Revenue'),
    (21,'Core Platform','Overage Charges',0,10.00,'Revenue'),
    (22,'Analytics Add-on','Overage Charges',0,10.00,'Revenue'),
    (23,'API Suite','Overage Charges',0,10.00,'Revenue'),
    (24,'Mobile Module','Overage Charges',0,10.00,'Revenue'),
    (25,'Compliance Pack','Overage Charges',0,10.00,'Revenue')
  ) v(product_key, product_line, category, is_recurring, cogs_pct_std, product_group)),
lines AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_quantity, l.l_partkey, l.l_shipdate, l.l_extendedprice, o.o_orderkey, o.o_custkey,
         o.o_orderstatus, o.odate, p.p_type, dp.product_key, dp.cogs_pct_std,
         CAST(l.l_tax AS DECIMAL(4,2)) AS tax,
         CAST(ROUND(CAST(l.l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))), 2)
              AS DECIMAL(14,2)) AS revenue_inr
  FROM lineitem l
  JOIN ord o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN dim_product dp ON dp.product_key = CAST(substr(p.p_brand, 7, 3) AS INTEGER)),
priced AS (
  SELECT *, CAST(ROUND(revenue_inr * (cogs_pct_std + tax * 100) * 0.01, 2) AS DECIMAL(14,2)) AS cogs_inr
  FROM lines),
priced2 AS (
  SELECT *, CAST(revenue_inr - cogs_inr AS DECIMAL(14,2)) AS gross_profit_inr,
         CAST(100 - cogs_pct_std - tax * 100 AS DECIMAL(6,2)) AS gross_margin_pct
  FROM priced),
fact_transactions_clean AS (
  SELECT 'TXN-' || CAST(x.l_orderkey AS VARCHAR) || '-' || CAST(x.l_linenumber AS VARCHAR) AS transaction_id,
         'INV-' || CAST(x.o_orderkey AS VARCHAR) AS invoice_id,
         c.customer_key, x.product_key,
         CAST(year(x.odate) * 10000 + month(x.odate) * 100 + day(x.odate) AS INTEGER) AS date_key,
         CAST(year(x.odate) AS SMALLINT) AS fiscal_year,
         'Q' || CAST(quarter(x.odate) AS VARCHAR) AS fiscal_quarter,
         strftime(x.odate, '%b-%Y') AS fiscal_month,
         c.region, c.segment, c.plan,
         CASE x.o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Pending' WHEN 'P' THEN 'Overdue' END
           AS payment_status,
         x.revenue_inr, x.cogs_inr, x.gross_profit_inr, x.gross_margin_pct,
         concat_ws('/', x.l_orderkey, x.l_linenumber, x.l_partkey, x.l_suppkey, x.l_shipdate, x.l_extendedprice)
           AS transaction_key,
         x.l_orderkey AS _ok
  FROM priced2 x JOIN dim_customers_clean c ON x.o_custkey = c.customer_key),
fact_churn_clean AS (
  SELECT CAST(customer_key AS BIGINT) AS churn_key, customer_key,
         CAST(year(first_d) * 10000 + month(first_d) * 100 + day(first_d) AS INTEGER) AS acquisition_date_key,
         CAST(year(last_d + 90) * 10000 + month(last_d + 90) * 100 + day(last_d + 90) AS INTEGER)
           AS churn_date_key,
         plan, segment, region,
         (['Price','Competition','Product Gap','Support','Other'])[customer_key % 5 + 1] AS churn_reason,
         CASE WHEN customer_key % 3 = 0 THEN 'Involuntary' ELSE 'Voluntary' END AS churn_type,
         CAST(customer_key % 2 AS TINYINT) AS was_escalated,
         CAST(CASE WHEN customer_key % 3 = 1 THEN 1 ELSE 0 END AS TINYINT) AS exit_survey_completed,
         CAST(CASE WHEN customer_key % 7 < 3 THEN 1 ELSE 0 END AS TINYINT) AS win_back_eligible,
         CAST(date_diff('day', first_d, last_d) + 90 AS SMALLINT) AS days_to_churn,
         mrr_inr AS mrr_at_churn_inr, arr_inr AS arr_at_churn_inr, rec AS revenue_recognized_inr,
         health_score AS last_health_score, support_tickets_90d
  FROM cust_base WHERE is_active = 0),
bva_g AS (
  SELECT year(odate) AS y, month(odate) AS m, p_type AS department,
         SUM(revenue_inr) AS act_rev,
         SUM(ROUND(revenue_inr * (0.88 + 0.02 * (month(odate) % 8)), 2)) AS bud_rev,
         SUM(CAST(l_quantity AS DECIMAL(12,2))) * 100 AS act_opex,
         CAST(COUNT(*) * 2550 AS DECIMAL(20,2)) AS bud_opex,
         SUM(gross_profit_inr) AS gp,
         COUNT(DISTINCT l_suppkey) AS hc
  FROM priced2 GROUP BY 1, 2, 3),
fact_budget_vs_actual_clean AS (
  SELECT CAST(y * 10000 + m * 100 + 1 AS INTEGER) AS date_key,
         CAST(y AS SMALLINT) AS fiscal_year,
         'Q' || CAST(quarter(make_date(y, m, 1)) AS VARCHAR) AS fiscal_quarter,
         strftime(make_date(y, m, 1), '%b-%Y') AS month_label,
         department,
         CAST(bud_rev AS DECIMAL(20,2)) AS budgeted_revenue_inr,
         CAST(act_rev AS DECIMAL(20,2)) AS actual_revenue_inr,
         CAST(act_rev - bud_rev AS DECIMAL(20,2)) AS revenue_variance_inr,
         CAST(__REVPCT__ AS DECIMAL(7,2)) AS revenue_variance_pct,
         CAST(bud_opex AS DECIMAL(20,2)) AS budgeted_opex_inr,
         CAST(act_opex AS DECIMAL(20,2)) AS actual_opex_inr,
         CAST(act_opex - bud_opex AS DECIMAL(20,2)) AS opex_variance_inr,
         CAST(__OPEXPCT__ AS DECIMAL(7,2)) AS opex_variance_pct,
         CAST(ROUND(bud_rev * 0.65 - bud_opex, 2) AS DECIMAL(20,2)) AS budgeted_ebitda_inr,
         CAST(gp - act_opex AS DECIMAL(20,2)) AS actual_ebitda_inr,
         CAST(hc + m % 3 - 1 AS INTEGER) AS headcount_budget,
         CAST(hc AS INTEGER) AS headcount_actual
  FROM bva_g),
cal_bounds AS (
  SELECT make_date(CAST(year(MIN(odate)) AS INTEGER), 1, 1) AS s,
         make_date(CAST(year(MAX(odate)) AS INTEGER), 12, 31) AS e FROM ord),
cal_days AS (
  SELECT CAST(UNNEST(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS d FROM cal_bounds),
dim_date_clean AS (
  SELECT CAST(year(d) * 10000 + month(d) * 100 + day(d) AS INTEGER) AS date_key,
         d AS full_date,
         CAST(isodow(d) AS TINYINT) AS day_of_week,
         dayname(d) AS day_name,
         CAST(day(d) AS TINYINT) AS day_of_month,
         CAST(dayofyear(d) AS SMALLINT) AS day_of_year,
         CAST(weekofyear(d) AS TINYINT) AS week_of_year,
         CAST(month(d) AS TINYINT) AS month_num,
         monthname(d) AS month_name,
         strftime(d, '%b') AS month_short,
         strftime(d, '%b-%Y') AS fiscal_month_label,
         CAST(quarter(d) AS TINYINT) AS quarter_num,
         'Q' || CAST(quarter(d) AS VARCHAR) AS quarter_label,
         CAST(year(d) AS SMALLINT) AS fiscal_year,
         CAST(year(d) AS VARCHAR) || '-Q' || CAST(quarter(d) AS VARCHAR) AS fiscal_year_quarter,
         CAST(CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS TINYINT) AS is_weekend,
         CAST(CASE WHEN month(d + 1) <> month(d) THEN 1 ELSE 0 END AS TINYINT) AS is_month_end,
         CAST(CASE WHEN quarter(d + 1) <> quarter(d) THEN 1 ELSE 0 END AS TINYINT) AS is_quarter_end,
         CAST(CASE WHEN month(d) = 12 AND day(d) = 31 THEN 1 ELSE 0 END AS TINYINT) AS is_year_end
  FROM cal_days)"""

_REVPCT = as_decimal(pct_units(units("act_rev - bud_rev", 2), units("bud_rev", 2)), 2)
_OPEXPCT = as_decimal(pct_units(units("act_opex - bud_opex", 2), units("bud_opex", 2)), 2)
CLEAN_CTES = _CLEAN.replace("__REVPCT__", _REVPCT).replace("__OPEXPCT__", _OPEXPCT)

# clean star: plain aliases
_STAR_CLEAN = """,
dim_customers AS (SELECT * FROM dim_customers_clean),
fact_transactions AS (SELECT * EXCLUDE (_ok) FROM fact_transactions_clean),
fact_churn AS (SELECT * FROM fact_churn_clean),
fact_budget_vs_actual AS (SELECT * FROM fact_budget_vs_actual_clean),
dim_date AS (SELECT * FROM dim_date_clean)"""

# planted-defect star (mirror of testdata._plant_defects)
_STAR_DEFECTS = """,
cust_d AS (
  SELECT * REPLACE (
    CASE WHEN customer_key % 97 = 0 THEN NULL ELSE mrr_inr END AS mrr_inr,
    CASE WHEN customer_key % 97 = 0 THEN NULL ELSE csm_owner END AS csm_owner,
    CASE WHEN customer_key % 83 = 0 THEN CAST(arr_inr + 5 AS DECIMAL(14,2)) ELSE arr_inr END AS arr_inr,
    CASE WHEN customer_key % 79 = 0 THEN CAST(120 AS DECIMAL(5,1)) ELSE health_score END AS health_score,
    CASE WHEN customer_key % 73 = 0 THEN CAST(-150 AS SMALLINT) ELSE nps_score END AS nps_score)
  FROM dim_customers_clean),
dim_customers AS (SELECT * FROM cust_d UNION ALL SELECT * FROM cust_d WHERE customer_key % 89 = 0),
fact_transactions AS (
  SELECT * EXCLUDE (_ok) REPLACE (
    CASE WHEN _ok % 101 = 0 THEN NULL WHEN _ok % 103 = 0 THEN -revenue_inr ELSE revenue_inr END AS revenue_inr,
    CASE WHEN _ok % 107 = 0 THEN CAST(ROUND(
        CASE WHEN _ok % 101 = 0 THEN NULL WHEN _ok % 103 = 0 THEN -revenue_inr ELSE revenue_inr END * 1.1, 2)
        AS DECIMAL(14,2)) ELSE cogs_inr END AS cogs_inr,
    CAST(CASE WHEN _ok % 109 = 0 THEN gross_profit_inr + 1.00
              WHEN _ok % 113 = 0 THEN gross_profit_inr + 1.01
              ELSE gross_profit_inr END AS DECIMAL(14,2)) AS gross_profit_inr)
  FROM fact_transactions_clean),
churn_d AS (
  SELECT * REPLACE (
    CASE WHEN customer_key % 71 = 0 THEN acquisition_date_key ELSE churn_date_key END AS churn_date_key,
    CASE WHEN customer_key % 71 = 0 THEN CAST(0 AS SMALLINT) ELSE days_to_churn END AS days_to_churn)
  FROM fact_churn_clean),
fact_churn AS (SELECT * FROM churn_d UNION ALL SELECT * FROM churn_d WHERE customer_key % 89 = 0),
fact_budget_vs_actual AS (
  SELECT * FROM fact_budget_vs_actual_clean
  UNION ALL SELECT * FROM fact_budget_vs_actual_clean WHERE date_key % 89 = 0),
dim_date AS (SELECT * FROM dim_date_clean),
dim_date_loaded AS (SELECT * FROM dim_date_clean WHERE full_date <= DATE '2000-12-31')"""


def with_star(defects: bool = False) -> str:
    """``WITH`` clause defining dim_date, dim_product, dim_customers,
    fact_transactions, fact_churn, fact_budget_vs_actual (+ cust_base)."""
    return "WITH " + CLEAN_CTES.strip() + (_STAR_DEFECTS if defects else _STAR_CLEAN)


def sql(body: str, defects: bool = False) -> str:
    """Full oracle statement: star prelude + ``, name AS (...) ... SELECT``.

    ``body`` either starts with ``SELECT`` (the final statement) or with
    further CTE definitions (``x AS (...), ... SELECT``)."""
    b = body.strip()
    sep = "\n" if b.upper().startswith("SELECT") else ",\n"
    return with_star(defects) + sep + b
