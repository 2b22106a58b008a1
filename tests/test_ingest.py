"""Stored keys, faulty cells, reloads by key and label spellings on hand frames."""
import glob
import os
import tempfile

import pytest

from finlake.operators import cells
from finlake.operators.keys import with_stored_keys
from finlake.operators.reload import reload_table
from finlake.operators.spelling import learn, unify
from finlake.plans.warehouse import load_star, staging_cells, staging_from_star
from finlake.schemas import STAGING, WAREHOUSE, UNIQUE_KEYS
from finlake.sources.seed import product_seed
from finlake.sources.staging import append_keyed, read_table
from finlake.sources.testdata import star_from_testdata
from tests.conftest import SF_SMALL


@pytest.fixture
def folder(spark):
    return tempfile.mkdtemp(dir=spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))


def test_stored_keys_of_repeated_rows(spark):
    df = spark.createDataFrame([(i % 3,) for i in range(1000)], "a int").repartition(7)
    out = with_stored_keys(df, "k", after=50)
    assert sorted(r.k for r in out.collect()) == list(range(51, 1051))
    assert sorted(r.k for r in out.where("a = 1").collect()) == sorted(r.k for r in out.collect() if r.a == 1)  # read again
    assert with_stored_keys(df.limit(0), "k").collect() == []


def test_appends_continue(spark, folder):
    schema = "transaction_id string, fiscal_year smallint"
    for n in (5, 0, 3):
        append_keyed(spark.createDataFrame([("x", 2000 + i % 2) for i in range(n)], schema), f"{folder}/t", "fact_transactions", "transaction_key")
    assert sorted(r.transaction_key for r in read_table(spark, f"{folder}/t").collect()) == list(range(1, 9))


def test_loaded_facts_have_primary_keys(spark):
    star = star_from_testdata(spark, SF_SMALL)
    stg = {k: v.unionByName(v) if k == "transactions" else v for k, v in staging_from_star(star).items()}
    out = load_star(stg, star["dim_date"], product_seed(spark))
    for table, key in (("fact_transactions", "transaction_key"), ("fact_churn", "churn_key"), ("fact_budget_vs_actual", "bva_key")):
        n = out[table].count()
        assert n and out[table].select(key).distinct().count() == n
        assert out[table].columns[-1] == key


@pytest.mark.parametrize("table", sorted(STAGING))
def test_every_staging_column_is_read(table):
    target = {"customers": "dim_customers", "transactions": "fact_transactions", "churn": "fact_churn", "budget": "fact_budget_vs_actual"}[table]
    looked_up = {"customer_key", "product_key", "transaction_key", "churn_key", "bva_key"}
    assert {c.column for c in staging_cells(table)} == {f.name for f in WAREHOUSE[target].fields} - looked_up


def test_reason_of_each_kind_of_cell(spark):
    made = [cells.text("t", "s", 3), cells.date("d", "s"), cells.decimal("m", "s", 5, 2), cells.integer("i", "s", "tinyint"),
            cells.flag("f", "s"), cells.enum("e", "s", ["Paid"]), cells.label("l", "s", ["Paid"])]

    def reasons(value):
        parsed = cells.parse_cells(spark.createDataFrame([(value, "id")], "s string, id string"), made, keep=("id",))
        return {(r.column_name): r.reason for r in cells.quarantine(parsed, "id").collect()}
    assert reasons(None) == dict.fromkeys("tdmifel", "missing")
    assert reasons("") == dict.fromkeys("dmife", "empty")
    assert reasons(" 12.9") == {"t": "too long", "d": "unreadable date", "f": "not yes or no", "e": "not in the domain"}
    assert reasons("1,234") == {"t": "too long", "d": "unreadable date", "m": "out of range", "i": "not a number",
                                "f": "not yes or no", "e": "not in the domain"}
    assert reasons("300")["i"] == "out of range" and "m" not in reasons("300")
    assert reasons("paid ") == {"t": "too long", "d": "unreadable date", "m": "not a number", "i": "not a number", "f": "not yes or no"}
    assert "f" not in reasons("YES") and "d" not in reasons("5-jan-2022") and "d" not in reasons("2022-01-05")


def test_whole_rows_and_counts(spark):
    made = [cells.integer("i", "s"), cells.decimal("m", "u", 6, 2)]
    df = spark.createDataFrame([("1", "2"), ("x", "y"), ("3", ""), ("4", None)], "s string, u string")
    parsed = cells.parse_cells(df, made)
    assert [(r.i, str(r.m)) for r in cells.whole_rows(parsed).collect()] == [(1, "2.00")]
    assert {(r.column_name, r.reason): r.cells for r in cells.fault_counts(parsed).collect()} == {
        ("i", "not a number"): 1, ("m", "not a number"): 1, ("m", "empty"): 1, ("m", "missing"): 1}


BUDGET = WAREHOUSE["fact_budget_vs_actual"]


def budget(spark, rows):
    """Rows of (date_key, department, year, revenue, variance)."""
    full = [{f.name: None for f in BUDGET.fields} | dict(date_key=d, department=p, fiscal_year=y, actual_revenue_inr=r, revenue_variance_inr=v)
            for d, p, y, r, v in rows]
    from pyspark.sql.types import StructField, StructType
    loose = StructType([StructField(f.name, f.dataType, True) for f in BUDGET.fields])
    from decimal import Decimal
    for x in full:
        for c in ("actual_revenue_inr", "revenue_variance_inr"):
            x[c] = None if x[c] is None else Decimal(x[c])
    return spark.createDataFrame([tuple(x[f.name] for f in BUDGET.fields) for x in full], loose).drop("bva_key")


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet") + glob.glob(f"{path}/*.parquet")}


def test_reload_by_key(spark, folder):
    how = dict(keys=UNIQUE_KEYS["fact_budget_vs_actual"], schema=BUDGET, surrogate="bva_key", partition="fiscal_year")
    path = f"{folder}/b"
    first = [(1, "A", 2000, 10, None), (1, "B", 2000, 11, 1), (2, "A", 2001, 12, 2), (3, None, 2001, 13, 3), (4, "A", 2002, 14, 4)]
    kinds = reload_table(budget(spark, first), path, **how)
    assert [r.kind for r in kinds.collect()] == ["new"] * 5

    def table():
        return {(r.date_key, r.department): r for r in spark.read.parquet(path).collect()}
    one = table()
    assert sorted(r.bva_key for r in one.values()) == [1, 2, 3, 4, 5] and all(r.created_at == r.updated_at for r in one.values())

    before = files(path)
    assert {r.kind for r in reload_table(budget(spark, first), path, **how).collect()} == {"same"}
    assert files(path) == before  # nothing changed, nothing written

    # a NULL that moves between columns, a key with NULL, a repeated key, a year emptied, a new year, an absent row
    second = [(1, "A", 2000, None, 10), (2, "A", 2001, 12, 2), (3, None, 2001, 99, 3), (4, "A", 2003, 14, 4), (5, "C", 2003, 1, 1), (5, "C", 2003, 2, 1)]
    kinds = {(r.date_key, r.department): r.kind for r in reload_table(budget(spark, second), path, **how).collect()}
    assert kinds == {(1, "A"): "changed", (1, "B"): "absent", (2, "A"): "same", (3, None): "changed", (4, "A"): "changed", (5, "C"): "new"}
    two = table()
    assert set(two) == set(one) | {(5, "C")} and spark.read.parquet(path).count() == 6
    assert two[(5, "C")].bva_key == 6 and two[(4, "A")].fiscal_year == 2003 and two[(3, None)].actual_revenue_inr == 99
    assert two[(1, "A")].actual_revenue_inr is None and two[(1, "B")].actual_revenue_inr == 11
    for key, was in one.items():
        assert two[key].bva_key == was.bva_key and two[key].created_at == was.created_at
        assert (two[key].updated_at > was.updated_at) == (kinds[key] == "changed")
    assert not glob.glob(f"{path}/fiscal_year=2002/*.parquet")


def test_reload_touches_only_years_that_change(spark, folder):
    how = dict(keys=["date_key", "department"], schema=BUDGET, surrogate="bva_key", partition="fiscal_year")
    path = f"{folder}/b"
    rows = [(i, "A", 2000 + i % 3, i, 0) for i in range(30)]
    reload_table(budget(spark, rows), path, **how)
    before = files(path)
    reload_table(budget(spark, [(i, d, y, r + (i == 4), v) for i, d, y, r, v in rows]), path, **how)
    after = files(path)
    assert {f.split("fiscal_year=")[1][:4] for f in set(after) - set(before)} == {"2001"}
    assert all(after[f] == t for f, t in before.items() if "=2001" not in f)


def test_reload_without_partitions(spark, folder):
    schema = WAREHOUSE["dim_product"]
    seed = product_seed(spark)
    how = dict(keys=["product_line", "category"], schema=schema)
    reload_table(seed, f"{folder}/p", **how)
    moved = seed.withColumn("cogs_pct_std", seed["cogs_pct_std"] + (seed["product_key"] == 3).cast("int"))
    kinds = [r.kind for r in reload_table(moved, f"{folder}/p", **how).collect()]
    assert sorted(kinds) == ["changed"] + ["same"] * 24
    rows = spark.read.parquet(f"{folder}/p").collect()
    assert len(rows) == 25 and [r.product_key for r in rows if r.updated_at > r.created_at] == [3]


def test_spellings_are_kept(spark, folder):
    path = f"{folder}/d"

    def load(*labels):
        return spark.createDataFrame([(x,) for x in labels], "reason string")
    known = learn(spark, path, [(load("price", "Price", " PRICÉ", None, ""), "reason", "reason"), (load("x"), "reason", "other")])
    assert {(r.column_name, r.spelling) for r in known.collect()} == {("reason", "PRICÉ"), ("other", "x")}
    known = learn(spark, path, [(load("AAA", "aaa", "PRICE", "Other"), "reason", "reason")])
    assert {(r.column_name, r.spelling) for r in known.collect()} == {("reason", "PRICÉ"), ("other", "x"), ("reason", "AAA"), ("reason", "Other")}
    df = load("price", "Aaa ", "new", None, "").selectExpr("reason", "'k' as spelling", "reason as other")
    out = unify(df, known, "reason")
    assert out.columns == df.columns
    assert sorted(str(r.reason) for r in out.collect()) == ["", "AAA", "None", "PRICÉ", "new"]


def test_load_star_unifies_labels(spark, folder):
    star = star_from_testdata(spark, SF_SMALL)
    stg = staging_from_star(star)
    from pyspark.sql import functions as F
    odd = F.crc32("CustomerID") % 2 == 1
    stg["churn"] = stg["churn"].withColumn("ChurnReason", F.when(odd, F.upper("ChurnReason")).otherwise(F.col("ChurnReason")))
    plain = load_star(stg, star["dim_date"], star["dim_product"], surrogate=False)
    once = load_star(stg, star["dim_date"], star["dim_product"], surrogate=False, spelling_path=f"{folder}/d")
    want = {r[0].lower() for r in star["fact_churn"].select("churn_reason").distinct().collect()}
    assert plain["fact_churn"].select("churn_reason").distinct().count() > len(want)
    assert {r[0].lower() for r in once["fact_churn"].select("churn_reason").distinct().collect()} == want
    assert once["fact_churn"].select("churn_reason").distinct().count() == len(want)


LOAD = "a string, b int, y int, v string"  # keyed by a and b
TABLE = "k long not null, a string, b int, y int, v string"


def _load(n, v, years=4):
    """Keys with nulls, each third one up to three times, once with equal rows."""
    out = []
    for i in range(n):
        a, b = None if i % 17 == 0 else f"key {i // 3}", None if i % 19 == 0 else i % 3
        out += [(a, b, None if i % 23 == 0 else 2000 + i % years, f"{v(i)} {c if i % 2 else 0}") for c in range(1 + (i % 9 in (3, 6)) * 2)]
    return out


@pytest.mark.parametrize("bits, in_files", [(28, False), (28, True), (15, False)])
def test_reload_gives_the_rows_of_a_plain_merge(spark, folder, monkeypatch, bits, in_files):
    """Against a dict: nulls and repeated rows in keys, moved years, absent keys; also where all bits are set."""
    from pyspark.sql.types import StructType

    from finlake.operators import keybits
    from finlake.operators.reload import row_hash
    monkeypatch.setattr(keybits, "MAX_BITS", bits)
    if bits == 15:  # every row may be any key
        monkeypatch.setattr(keybits, "_place", lambda n: (keybits.F.lit(0).cast("bigint"), keybits.F.lit(5).cast("bigint")))
    schema, path = StructType.fromDDL(TABLE), f"{folder}/plain"
    loads = [_load(400, lambda i: "x"), _load(500, lambda i: "z" if i % 10 == 4 else "x")[40:], _load(300, lambda i: "x", years=3)]
    table, last = {}, 0
    for number, rows in enumerate(loads):
        df = spark.createDataFrame(rows, LOAD).repartition(5)
        if in_files:
            df.write.parquet(f"{folder}/load{number}")
            df = spark.read.schema(LOAD).parquet(f"{folder}/load{number}")
        said = reload_table(df, path, ["a", "b"], schema, "k", "y", in_files=in_files)
        one = {}
        for r in df.withColumn("h", row_hash(["a", "b", "y", "v"])).collect():
            one[r.a, r.b] = min(one.get((r.a, r.b), (r.h, r.y, r.v)), (r.h, r.y, r.v), key=lambda x: x[0])
        kinds = {k: ("absent" if k not in one else "new" if k not in table else "same" if table[k][:3] == one[k] else "changed") for k in {*one, *table}}
        assert {(r.a, r.b): r.kind for r in said.collect()} == kinds and said.count() == len(kinds)
        years = {k: [x[k][1] for x in (one, table) if k in x and x[k][1] is not None] for k in kinds}
        assert {(r.a, r.b): r.y for r in said.collect()} == {k: v[0] if v else None for k, v in years.items()}
        got = spark.read.parquet(path).collect()
        keys = {(r.a, r.b): r.k for r in got}
        assert sorted(keys[k] for k in kinds if kinds[k] == "new") == list(range(last + 1, last + 1 + sum(v == "new" for v in kinds.values())))
        last += sum(v == "new" for v in kinds.values())
        was, table = table, {k: (*(one.get(k) or table[k][:3]), table[k][3] if k in table else keys[k], kinds[k]) for k in kinds}
        assert len(got) == len(table)
        assert {(r.a, r.b): (r.row_hash, r.y, r.v, r.k) for r in got} == {k: v[:4] for k, v in table.items()}
        latest = max(r.updated_at for r in got)
        assert {(r.a, r.b) for r in got if r.updated_at == latest} == {k for k in kinds if kinds[k] in ("new", "changed")}
        assert {(r.a, r.b) for r in got if r.created_at == latest} == {k for k in kinds if kinds[k] == "new"}
        assert number == 0 or {"same", "changed", "absent"} <= set(kinds.values())
