"""Every registered query equals its independent DuckDB SQL (sf0.001)."""
import math

import pytest

import __spark_entry__ as E
from finlake import registry
from tests.conftest import SF_SMALL

QUERIES = registry.queries()
ORACLE = registry.oracle_sql()
SPARK_TO_DUCK = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "DateType()": "DATE"}


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if hasattr(v, "isoformat"):
        return str(v)[:10] if type(v).__name__ == "date" else v.isoformat()
    return repr(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def test_every_query_has_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())
    assert len(QUERIES) >= 84


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["fiscal_year", "fiscal_month", "month_num"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    s_cols, s_rows = _canon(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(ORACLE[name])
    d_types = dict(zip(rel.columns, map(str, rel.types)))
    assert {f.name: SPARK_TO_DUCK.get(str(f.dataType), str(f.dataType)) for f in df.schema.fields} == d_types
    cur = duck.execute(ORACLE[name])
    d_cols, d_rows = _canon([d[0] for d in cur.description], cur.fetchall())
    assert s_cols == d_cols
    assert len(s_rows) == len(d_rows)
    assert s_rows == d_rows
