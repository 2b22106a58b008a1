"""Data-quality operators.

* ``rule_counts`` evaluates any number of row-level rules in ONE pass over a
  table (conditional counts, partial aggregation per task);
* ``null_counts`` counts NULLs per column, also in one pass;
* ``duplicate_keys`` lists keys occurring more than once (map-side combine
  keeps a hot key to one row per task before the shuffle);
* ``orphans`` counts rows whose foreign key has no dimension row with a
  LEFT ANTI join (the LEFT JOIN ... IS NULL idiom is not rewritten to an
  anti join by the optimizer).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: for each rule name, the number of rows where the predicate is
    TRUE (NULL counts as not violated, like a WHERE clause)."""
    return df.agg(*[F.count_if(F.coalesce(p, F.lit(False))).alias(n) for n, p in rules.items()])


def null_counts(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """One row: SUM(CASE WHEN col IS NULL THEN 1 ELSE 0 END) per output name
    (NULL on an empty table, like SQL SUM)."""
    return df.agg(*[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("long").alias(n)
                    for n, c in cols.items()])


def duplicate_keys(df: DataFrame, keys: list[str], out: str = "occurrences") -> DataFrame:
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
            .filter(F.col(out) > 1))


def duplicate_key_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row, ``duplicates``: how many keys occur more than once.

    Keys that are one number are counted as they are.  Others are screened by
    a 64-bit hash: 16 bytes a key go through the shuffle, combined by task, and
    only rows whose hash occurs more than once are counted by the key itself."""
    if len(keys) == 1 and df.schema[keys[0]].dataType.typeName() in ("byte", "short", "integer", "long"):
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(F.count_if(F.col("__n") > 1).alias("duplicates"))
    hashed = df.select(*keys, F.xxhash64(*keys).alias("__h"))
    twice = hashed.groupBy("__h").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__h")
    exact = hashed.join(twice, "__h", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return exact.agg(F.count_if(F.col("__n") > 1).alias("duplicates"))


def orphans(fact: DataFrame, fk: str, dim: DataFrame, dk: str, out: str) -> DataFrame:
    """One row: rows of ``fact`` whose ``fk`` matches no ``dim.dk``."""
    d = dim.select(F.col(dk).alias("__dk")).distinct()
    a = fact.join(d, fact[fk] == d["__dk"], "left_anti")
    return a.agg(F.count(F.lit(1)).alias(out))


def domain_violations(df: DataFrame, col: str, domain: list[str]) -> Column:
    """Predicate: a non-NULL value outside the enum domain."""
    return F.col(col).isNotNull() & ~F.col(col).isin(*domain)
