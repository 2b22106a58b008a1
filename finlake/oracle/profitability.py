"""Oracle SQL: profitability."""
from __future__ import annotations

from finlake.oracle.prelude import sql
from finlake.oracle.sqlfn import as_double, avg_r, avg_units, hu, hu2, pct_r, q6, sum_r, units

Q = {}

_M = f"""{sum_r('t.revenue_inr')} AS total_revenue, {sum_r('t.cogs_inr')} AS total_cogs,
         {sum_r('t.gross_profit_inr')} AS gross_profit, {hu(avg_units('t.gross_margin_pct', 2), 10000)} AS m2"""

Q["prf_margin_line_year"] = sql(f"""
g AS (SELECT p.product_line, CAST(t.fiscal_year AS INTEGER) AS fiscal_year, {_M}
      FROM fact_transactions t JOIN dim_product p ON t.product_key = p.product_key GROUP BY 1, 2)
SELECT product_line, fiscal_year, total_revenue, total_cogs, gross_profit,
       {as_double('m2', 2)} AS avg_gross_margin_pct,
       CAST(RANK() OVER (PARTITION BY fiscal_year ORDER BY m2 DESC) AS INTEGER) AS margin_rank
FROM g""")

Q["prf_margin_category"] = sql(f"""
g AS (SELECT p.category, p.is_recurring, p.cogs_pct_std, {_M}
      FROM fact_transactions t JOIN dim_product p ON t.product_key = p.product_key GROUP BY 1, 2, 3)
SELECT category, CAST(is_recurring AS INTEGER) AS is_recurring, total_revenue, total_cogs, gross_profit,
       {as_double('m2', 2)} AS avg_gross_margin_pct,
       {as_double(f"m2 - {units('100 - cogs_pct_std', 2)}", 2)} AS margin_vs_standard_pct
FROM g""")

Q["prf_margin_quarterly"] = sql(f"""
g AS (SELECT CAST(fiscal_year AS INTEGER) AS fiscal_year, fiscal_quarter, {sum_r('revenue_inr')} AS revenue,
             {sum_r('gross_profit_inr')} AS gross_profit, {avg_units('gross_margin_pct', 2)} AS m6
      FROM fact_transactions GROUP BY 1, 2)
SELECT fiscal_year, fiscal_quarter, revenue, gross_profit, {as_double(hu('m6', 10000), 2)} AS avg_gross_margin_pct,
       {as_double(hu('m6 - LAG(m6) OVER (ORDER BY fiscal_year, fiscal_quarter)', 10000), 2)} AS qoq_margin_change_pp
FROM g""")


def _clv(keys: str, total: bool) -> str:
    g = f"""
j AS (SELECT c.*, t.gross_margin_pct FROM dim_customers c JOIN fact_transactions t ON c.customer_key = t.customer_key
      WHERE c.is_active = 1),
g AS (SELECT {keys}, COUNT(DISTINCT customer_key) AS customer_count,
             {avg_units('mrr_inr', 2)} AS a_mrr6, {avg_units('gross_margin_pct', 2)} AS a_m6,
             {avg_units('expected_cltv_months', 0)} AS a_l4, SUM({units('mrr_inr', 2)}) AS mrr_sum_u
      FROM j GROUP BY {keys})
SELECT {keys}, customer_count, {as_double(hu('a_mrr6', 10 ** 6), 0)} AS avg_mrr,
       {as_double(hu('a_m6', 10 ** 4), 2)} AS avg_gross_margin_pct,
       {as_double(hu('a_l4', 10 ** 4), 0)} AS avg_lifetime_months,
       {as_double(hu('a_mrr6 * a_m6 * a_l4', 10 ** 18), 0)} AS avg_clv_inr"""
    if total:
        g += f""",
       {as_double(hu('mrr_sum_u * a_m6 * a_l4', 10 ** 14), 0)} AS total_clv_potential_inr"""
    return sql(g + "\nFROM g")


Q["prf_clv_plan"] = _clv("plan", True)
Q["prf_clv_segment_region"] = _clv("segment, region", False)

Q["prf_clv_top20"] = sql(f"""
g AS (SELECT c.customer_key, c.customer_id, c.company_name, c.plan, c.segment, c.industry, c.region,
             c.mrr_inr, c.arr_inr, c.expected_cltv_months, c.health_status,
             {avg_units('t.gross_margin_pct', 2)} AS a_m6
      FROM dim_customers c JOIN fact_transactions t ON c.customer_key = t.customer_key
      WHERE c.is_active = 1
      GROUP BY c.customer_key, c.customer_id, c.company_name, c.plan, c.segment, c.industry, c.region,
               c.mrr_inr, c.arr_inr, c.expected_cltv_months, c.health_status),
r AS (SELECT customer_id, company_name, plan, segment, industry, region,
             CAST(ROUND(mrr_inr, 0) AS DOUBLE) AS mrr_inr, CAST(ROUND(arr_inr, 0) AS DOUBLE) AS arr_inr,
             CAST(expected_cltv_months AS INTEGER) AS expected_cltv_months,
             {as_double(hu('a_m6', 10 ** 4), 2)} AS avg_gross_margin_pct,
             {as_double(hu(f"{units('mrr_inr', 2)} * a_m6 * expected_cltv_months", 10 ** 10), 0)} AS estimated_clv_inr,
             health_status
      FROM g)
SELECT * FROM r ORDER BY estimated_clv_inr DESC NULLS LAST, customer_id LIMIT 20""")

Q["prf_annual_pnl"] = sql(f"""
g AS (SELECT CAST(fiscal_year AS INTEGER) AS fiscal_year,
             {sum_r('budgeted_revenue_inr')} AS total_budgeted_revenue,
             {sum_r('actual_revenue_inr')} AS total_actual_revenue,
             {sum_r('revenue_variance_inr')} AS total_revenue_variance,
             {avg_r('revenue_variance_pct', 2, 2)} AS avg_revenue_variance_pct,
             {sum_r('budgeted_opex_inr')} AS total_budgeted_opex, {sum_r('actual_opex_inr')} AS total_actual_opex,
             {sum_r('opex_variance_inr')} AS total_opex_variance,
             SUM(budgeted_ebitda_inr) AS be, SUM(actual_ebitda_inr) AS ae
      FROM fact_budget_vs_actual GROUP BY 1)
SELECT fiscal_year, total_budgeted_revenue, total_actual_revenue, total_revenue_variance,
       avg_revenue_variance_pct, total_budgeted_opex, total_actual_opex, total_opex_variance,
       CAST(ROUND(be, 0) AS DOUBLE) AS total_budgeted_ebitda, CAST(ROUND(ae, 0) AS DOUBLE) AS total_actual_ebitda,
       {pct_r(units('ae - be', 2), units('ABS(be)', 2))} AS ebitda_variance_pct
FROM g""")

Q["prf_department_pnl"] = sql(f"""
g AS (SELECT department, SUM(budgeted_revenue_inr) AS br, SUM(actual_revenue_inr) AS ar,
             {sum_r('revenue_variance_inr')} AS total_revenue_variance,
             {avg_r('revenue_variance_pct', 2, 2)} AS avg_revenue_variance_pct,
             {sum_r('actual_opex_inr')} AS total_actual_opex, SUM(actual_ebitda_inr) AS ae
      FROM fact_budget_vs_actual GROUP BY department)
SELECT department, CAST(ROUND(br, 0) AS DOUBLE) AS total_budgeted_revenue,
       CAST(ROUND(ar, 0) AS DOUBLE) AS total_actual_revenue, total_revenue_variance, avg_revenue_variance_pct,
       total_actual_opex, CAST(ROUND(ae, 0) AS DOUBLE) AS total_actual_ebitda,
       {pct_r(units('ae', 2), units('ar', 2))} AS ebitda_margin_pct,
       {pct_r(units('ar', 2), units('br', 2))} AS budget_attainment_pct
FROM g""")

Q["prf_monthly_variance"] = sql(f"""
g AS (SELECT CAST(fiscal_year AS INTEGER) AS fiscal_year, fiscal_quarter, month_label, date_key,
             {sum_r('budgeted_revenue_inr')} AS budgeted_revenue, {sum_r('actual_revenue_inr')} AS actual_revenue,
             {sum_r('revenue_variance_inr')} AS revenue_variance, {avg_units('revenue_variance_pct', 2)} AS v6,
             {sum_r('actual_ebitda_inr')} AS actual_ebitda
      FROM fact_budget_vs_actual GROUP BY fiscal_year, fiscal_quarter, month_label, date_key)
SELECT fiscal_year, fiscal_quarter, month_label, budgeted_revenue, actual_revenue, revenue_variance,
       {as_double(hu('v6', 10000), 2)} AS variance_pct, actual_ebitda,
       CASE WHEN v6 < -5000000 THEN 'MISSED TARGET' WHEN v6 < 0 THEN 'SLIGHTLY BELOW'
            WHEN v6 < 5000000 THEN 'ON TARGET' ELSE 'EXCEEDED TARGET' END AS performance_flag
FROM g""")

Q["prf_missed_budget"] = sql(f"""
g AS (SELECT department, COUNT(*) AS total_months,
             CAST(SUM(CASE WHEN revenue_variance_pct < 0 THEN 1 ELSE 0 END) AS BIGINT) AS months_below_budget,
             CAST(SUM(CASE WHEN revenue_variance_pct >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS months_above_budget,
             {avg_r('revenue_variance_pct', 2, 2)} AS avg_variance_pct,
             CAST(MIN(revenue_variance_pct) AS DOUBLE) AS worst_month_pct,
             CAST(MAX(revenue_variance_pct) AS DOUBLE) AS best_month_pct
      FROM fact_budget_vs_actual GROUP BY department)
SELECT department, total_months, months_below_budget, months_above_budget,
       {pct_r('months_below_budget', 'total_months', 1)} AS pct_months_missed,
       avg_variance_pct, worst_month_pct, best_month_pct
FROM g""")

Q["prf_headcount"] = sql(f"""
g AS (SELECT department, CAST(fiscal_year AS INTEGER) AS fiscal_year,
             {avg_units('headcount_budget', 0)} AS hb4, {avg_units('headcount_actual', 0)} AS ha4,
             SUM(actual_revenue_inr) AS rev
      FROM fact_budget_vs_actual GROUP BY 1, 2)
SELECT department, fiscal_year, {as_double(hu('hb4', 10000), 0)} AS avg_budgeted_headcount,
       {as_double(hu('ha4', 10000), 0)} AS avg_actual_headcount,
       {as_double(hu('ha4 - hb4', 1000), 1)} AS headcount_variance,
       CAST(ROUND(rev, 0) AS DOUBLE) AS total_revenue,
       {as_double(hu(q6(units('rev', 4), 'ha4'), 10 ** 6), 0)} AS revenue_per_head_inr
FROM g""")

Q["prf_scorecard"] = sql(f"""
t AS (SELECT SUM(revenue_inr) AS rev, SUM(gross_profit_inr) AS gp,
             {hu(avg_units('gross_margin_pct', 2), 10000)} AS m2 FROM fact_transactions),
c AS (SELECT SUM(mrr_inr) FILTER (WHERE is_active = 1) AS mrr, SUM(arr_inr) FILTER (WHERE is_active = 1) AS arr,
             COUNT(*) FILTER (WHERE is_active = 1) AS active_customers,
             {hu(hu2(f"SUM({units('mrr_inr', 2)}) FILTER (WHERE is_active = 1) * 10000", 'COUNT(mrr_inr) FILTER (WHERE is_active = 1)'), 10 ** 6)} AS amrr,
             COUNT(*) AS n_all,
             COUNT(*) FILTER (WHERE is_active = 1 AND health_status = 'Critical') AS critical_health_customers,
             COUNT(*) FILTER (WHERE is_active = 1 AND health_status = 'At Risk') AS at_risk_customers
      FROM dim_customers),
ch AS (SELECT COUNT(*) AS n_ch, SUM(mrr_at_churn_inr) AS lost,
              {hu(avg_units('days_to_churn', 0), 10000)} AS days_u FROM fact_churn),
b AS (SELECT {hu(avg_units('revenue_variance_pct', 2), 10000)} AS bv2 FROM fact_budget_vs_actual)
SELECT CAST(ROUND(rev, 0) AS DOUBLE) AS total_revenue_inr, CAST(ROUND(gp, 0) AS DOUBLE) AS total_gross_profit_inr,
       {as_double('m2', 2)} AS avg_gross_margin_pct, CAST(ROUND(mrr, 0) AS DOUBLE) AS current_total_mrr,
       CAST(ROUND(arr, 0) AS DOUBLE) AS current_total_arr, active_customers,
       CAST(amrr AS DOUBLE) AS avg_mrr_per_customer,
       {pct_r('n_ch', 'n_all')} AS overall_churn_rate_pct,
       CAST(ROUND(lost, 0) AS DOUBLE) AS total_mrr_lost_to_churn, CAST(days_u AS DOUBLE) AS avg_days_to_churn,
       critical_health_customers, at_risk_customers, {as_double('bv2', 2)} AS avg_budget_variance_pct
FROM t CROSS JOIN c CROSS JOIN ch CROSS JOIN b""")
