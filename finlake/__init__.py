"""finlake: finance-operations analytics (revenue, churn, profitability,
data quality) expressed as Spark DataFrame plans over a star schema."""

__version__ = "0.1.0"
