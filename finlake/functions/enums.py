"""ENUM ordering: an ENUM column sorts by declaration index, not by text."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from finlake.functions.exact import col_


def enum_rank(c, domain: list[str]) -> Column:
    """1-based index of the value in its domain (0 when unknown)."""
    return F.array_position(F.array(*[F.lit(v) for v in domain]), col_(c))


def order_by_enum(c, domain: list[str]) -> Column:
    return enum_rank(c, domain).asc()


def canonical_enum(c, domain: list[str]) -> Column:
    """Trimmed text mapped case-insensitively onto the declared spelling of
    the domain ('overdue ' -> 'Overdue'), as an ENUM column stores it;
    values outside the domain stay as they are (a constraint check reports
    them)."""
    t = F.trim(col_(c))
    e = None
    for v in domain:
        cond = F.lower(t) == F.lit(v.lower())
        e = F.when(cond, F.lit(v)) if e is None else e.when(cond, F.lit(v))
    return e.otherwise(t)
