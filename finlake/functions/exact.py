"""Exact decimal arithmetic with the reference's SQL semantics.

* money stays DECIMAL end to end; SUM is exact;
* AVG of DECIMAL(p,s) keeps s+4 digits (HALF_UP), integers are averaged as
  DECIMAL(p,0) so they also get 4 digits instead of a binary double;
* a/b is exact decimal division rounded HALF_UP to 6 digits, and a zero
  denominator gives NULL (``try_divide``) instead of an ANSI error;
* ROUND is HALF_UP (``F.round`` on decimals).

Operands of a quotient are cast to DECIMAL(38, s) so that Spark's result type
is always DECIMAL(38,6): the precision rules then never drop digits.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dec(c, scale: int = 2, precision: int = 38) -> Column:
    return col_(c).cast(DecimalType(precision, scale))


def quotient(num, den, scale: int = 2) -> Column:
    """num / den as DECIMAL(38,6), HALF_UP; NULL when den is 0 or NULL."""
    return F.try_divide(dec(num, scale), dec(den, scale))


def pct(num, den, digits: int = 2, scale: int = 2) -> Column:
    """ROUND(num / den * 100, digits) with exact decimal division."""
    return F.round(quotient(num, den, scale) * F.lit(100), digits)


def avg_dec(c, int_input: bool = False) -> Column:
    """AVG with decimal semantics; integer inputs are averaged as DECIMAL(p,0)."""
    c = col_(c)
    if int_input:
        c = c.cast(DecimalType(20, 0))
    return F.avg(c)


def round_sum(c, digits: int = 0) -> Column:
    return F.round(F.sum(col_(c)), digits)


def round_avg(c, digits: int, int_input: bool = False) -> Column:
    return F.round(avg_dec(c, int_input), digits)


def money_round(c, digits: int = 2) -> Column:
    return F.round(col_(c), digits)


def out_double(c) -> Column:
    """Presentation type of every money/ratio output column."""
    return col_(c).cast("double")
