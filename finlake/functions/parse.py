"""Parsing of staging text columns (loader semantics)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from finlake.functions.exact import col_


def clean_text(s) -> Column:
    """TRIM strips spaces only (a tab survives), like the reference."""
    return F.trim(col_(s))


def parse_decimal(s, precision: int, scale: int, strip_commas: bool = True) -> Column:
    """'1,234.567' -> DECIMAL(p,s) rounded HALF_UP; unparsable -> NULL."""
    t = F.trim(col_(s))
    if strip_commas:
        t = F.replace(t, F.lit(","), F.lit(""))
    return t.try_cast(DecimalType(precision, scale))


def parse_int(s, type_: str = "int") -> Column:
    """CAST AS UNSIGNED/SIGNED: '12.7' -> 12 and '12.99999' -> 12 (truncates toward
    zero); garbage and values beyond the target type -> NULL."""
    d = F.trim(col_(s)).try_cast(DecimalType(38, 18))
    return F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)).try_cast(type_)


def parse_flag(s) -> Column:
    """'Yes' (any case, surrounding spaces) -> 1, everything else incl. NULL -> 0."""
    return F.when(F.lower(F.trim(col_(s))) == F.lit("yes"), 1).otherwise(0).cast("tinyint")
