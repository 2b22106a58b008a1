"""Date helpers: calendar attributes and tolerant date parsing."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from finlake.functions.exact import col_


def date_key(d) -> Column:
    """yyyymmdd as INT, computed arithmetically (no string formatting)."""
    d = col_(d)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def parse_date(s) -> Column:
    """Text date -> DATE.  Accepts d-MMM-yyyy (5-Jan-2022, 05-JAN-2022) and
    yyyy-MM-dd; anything else becomes NULL instead of failing the job."""
    t = F.trim(col_(s))
    return F.coalesce(F.try_to_date(t, "d-MMM-yyyy"),
                      F.try_to_date(t, "yyyy-MM-dd"))


def calendar_columns(d, fiscal_start_month: int = 1) -> list[Column]:
    """The 19 dim_date attributes of a DATE column.

    Day of week is ISO (Monday=1..Sunday=7), week is the ISO week, names are
    full English names.  With ``fiscal_start_month=1`` fiscal = calendar.
    """
    d = col_(d)
    nxt = F.date_add(d, 1)
    if fiscal_start_month == 1:
        fy, fq = F.year(d), F.quarter(d)
    else:
        shifted = F.add_months(d, 13 - fiscal_start_month)
        fy, fq = F.year(shifted), F.quarter(shifted)
    dow = (F.weekday(d) + 1)
    return [
        date_key(d).alias("date_key"),
        d.alias("full_date"),
        dow.cast("tinyint").alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.dayofmonth(d).cast("tinyint").alias("day_of_month"),
        F.dayofyear(d).cast("smallint").alias("day_of_year"),
        F.weekofyear(d).cast("tinyint").alias("week_of_year"),
        F.month(d).cast("tinyint").alias("month_num"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.date_format(d, "MMM").alias("month_short"),
        F.date_format(d, "MMM-yyyy").alias("fiscal_month_label"),
        fq.cast("tinyint").alias("quarter_num"),
        F.concat(F.lit("Q"), fq.cast("string")).alias("quarter_label"),
        fy.cast("smallint").alias("fiscal_year"),
        F.concat(fy.cast("string"), F.lit("-Q"), fq.cast("string")).alias("fiscal_year_quarter"),
        F.when(dow >= 6, 1).otherwise(0).cast("tinyint").alias("is_weekend"),
        F.when(F.month(nxt) != F.month(d), 1).otherwise(0).cast("tinyint").alias("is_month_end"),
        F.when(F.quarter(nxt) != F.quarter(d), 1).otherwise(0).cast("tinyint").alias("is_quarter_end"),
        F.when((F.month(d) == 12) & (F.dayofmonth(d) == 31), 1).otherwise(0)
         .cast("tinyint").alias("is_year_end"),
    ]
