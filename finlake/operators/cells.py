"""Cell-level parsing of staging text: each cell gives its value, as the loader
stores it, and the reason where the text does not say such a value.

One pass parses a staging row into typed columns and an array of its faulty
cells (column, reason, text); ``quarantine`` lists them one by one.  Reasons:

* ``missing``: NULL; ``empty``: an empty text where a value is needed;
* ``unreadable date``, ``not a number``, ``not yes or no``;
* ``out of range``: a number that the column's type cannot hold;
* ``not in the domain``: a label without a declared spelling;
* ``too long``: a text beyond its declared length (it is stored as it is).
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlake.functions.dates import date_key, parse_date
from finlake.functions.enums import canonical_enum
from finlake.functions.parse import clean_text, parse_decimal, parse_flag, parse_int

FAULTS = "_faults"


class Cell(NamedTuple):
    column: str   # of the warehouse
    source: str   # of the staging table
    value: Column
    reason: Column  # NULL for a good cell


def _needed(source: str, bad: list[tuple[Column, str]]) -> Column:
    """Reason of a cell that must say something: the first that holds."""
    t = clean_text(source)
    out = F.when(F.col(source).isNull(), "missing").when(t == "", "empty")
    for holds, reason in bad:
        out = out.when(holds, reason)
    return out


def text(column: str, source: str, length: int | None = None) -> Cell:
    value = clean_text(source)
    out = F.when(F.col(source).isNull(), "missing")
    return Cell(column, source, value, out.when(F.length(value) > length, "too long") if length else out)


def date(column: str, source: str) -> Cell:
    value = parse_date(source)
    return Cell(column, source, value, _needed(source, [(value.isNull(), "unreadable date")]))


def day_key(column: str, source: str) -> Cell:
    value = parse_date(source)
    return Cell(column, source, date_key(value), _needed(source, [(value.isNull(), "unreadable date")]))


def decimal(column: str, source: str, precision: int, scale: int, commas: bool = True) -> Cell:
    value = parse_decimal(source, precision, scale, commas)
    number = parse_decimal(source, 38, scale, commas)
    return Cell(column, source, value, _needed(source, [(number.isNull(), "not a number"), (value.isNull(), "out of range")]))


def integer(column: str, source: str, type_: str = "int") -> Cell:
    value = parse_int(source, type_)
    number = parse_decimal(source, 38, 18, strip_commas=False)
    return Cell(column, source, value, _needed(source, [(number.isNull(), "not a number"), (value.isNull(), "out of range")]))


def flag(column: str, source: str) -> Cell:
    said = F.lower(clean_text(source))
    return Cell(column, source, parse_flag(source), _needed(source, [(~said.isin("yes", "no"), "not yes or no")]))


def enum(column: str, source: str, domain: list[str]) -> Cell:
    value = canonical_enum(source, domain)
    return Cell(column, source, value, _needed(source, [(~value.isin(domain), "not in the domain")]))


def label(column: str, source: str, domain: list[str], length: int | None = None) -> Cell:
    """A text that takes the declared spelling where it has one in any case."""
    cell = text(column, source, length)
    return cell._replace(value=F.coalesce(canonical_enum(source, domain), cell.value))


def parse_cells(stg: DataFrame, cells: list[Cell], keep: tuple[str, ...] = ()) -> DataFrame:
    """The typed columns, the kept staging columns, and ``FAULTS``, the faulty
    cells as an array of structs."""
    faults = F.array(*[F.struct(F.lit(c.column).alias("column_name"), c.reason.alias("reason"), F.col(c.source).alias("text"))
                       for c in cells])
    return stg.select(*keep, *[c.value.alias(c.column) for c in cells],
                      F.filter(faults, lambda f: f["reason"].isNotNull()).alias(FAULTS))


def quarantine(parsed: DataFrame, *by: str) -> DataFrame:
    """One row per faulty cell: the columns `by`, column_name, reason, text."""
    return parsed.select(*by, F.explode(FAULTS).alias("f")).select(*by, "f.column_name", "f.reason", "f.text")


def whole_rows(parsed: DataFrame) -> DataFrame:
    """Rows without a faulty cell, for loads that refuse the others."""
    return parsed.where(F.size(FAULTS) == 0).drop(FAULTS)


def fault_counts(parsed: DataFrame) -> DataFrame:
    """Faulty cells by column and reason."""
    return quarantine(parsed).groupBy("column_name", "reason").agg(F.count(F.lit(1)).alias("cells"))
