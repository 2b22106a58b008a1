"""Shared pieces of the analytic plans."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlake.functions.exact import out_double, round_avg, round_sum

Star = dict  # name -> DataFrame


def dbl_sum(c, alias: str, digits: int = 0) -> Column:
    """ROUND(SUM(c), digits) presented as DOUBLE."""
    return out_double(round_sum(c, digits)).alias(alias)


def dbl_avg(c, alias: str, digits: int, int_input: bool = False) -> Column:
    return out_double(round_avg(c, digits, int_input)).alias(alias)


def n_rows(alias: str) -> Column:
    return F.count(F.lit(1)).alias(alias)


def n_distinct(c, alias: str, exact: bool = True, rsd: float = 0.01) -> Column:
    """COUNT(DISTINCT c).  ``exact=False`` uses a HyperLogLog++ sketch (about
    ``rsd`` relative error) that merges map-side instead of shuffling every
    distinct value -- an opt-in for very large fact tables."""
    return (F.countDistinct(c) if exact else F.approx_count_distinct(c, rsd)).alias(alias)


def dates(star: Star, *cols: str) -> DataFrame:
    """dim_date columns for a join; statistics and AQE choose the join."""
    return star["dim_date"].select("date_key", *cols)


def products(star: Star, *cols: str) -> DataFrame:
    """dim_product columns for a join; statistics and AQE choose the join."""
    return star["dim_product"].select("product_key", *cols)
