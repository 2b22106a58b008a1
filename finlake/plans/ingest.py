"""Registered checks of repeated and faulty loads (appended keys, quarantined
cells, reloads by key, labels of several spellings) and of what is kept beside
the tables: distinct sketches, partial sums, the catalog, a layout by customer."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlake.operators import cells
from finlake.operators.reload import CREATED, UPDATED, reload_table
from finlake.operators.rollup import read_rollup, refresh_rollup
from finlake.operators.sketches import exact_counts, merged_estimates, period_sketches
from finlake.plans.profitability import prf_clv_plan, prf_clv_top20
from finlake.plans.revenue import rev_by_industry, rev_monthly_ytd_mom
from finlake.plans.warehouse import (TABLE_DESCRIPTIONS, dirty_staging, learn_spellings, load_dim_customers, load_fact_budget, load_fact_churn,
                                     load_fact_transactions, parse_staging, present, render_budget, render_churn,
                                     render_customers, transactions_text)
from finlake.schemas import FACT_TRANSACTIONS, WAREHOUSE
from finlake.session import WRITES_IN_A_ROW, scratch_dir, unless_set
from finlake.sources.catalog import inventory, register_star
from finlake.sources.colocated import read_colocated, write_colocated
from finlake.sources.staging import append_keyed, read_star, read_table, write_staging, write_star
from finlake.sources.testdata import ALONE

Star = dict


def load_keyed_appends(star: Star) -> DataFrame:
    """Transactions loaded in two parts (odd years, then even years), the lines
    of every seventh customer twice, each load's keys following the last one's:
    per load its rows, its distinct keys, its first and last key, its revenue."""
    customers = star["dim_customers"].select("customer_id", "customer_key")
    lines = transactions_text(star)
    number = F.regexp_extract("CustomerID", "([0-9]+)", 1).cast("long")
    times = F.when(number % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    spark = lines.sparkSession
    path, text = scratch_dir(spark, "keyed-transactions"), scratch_dir(spark, "keyed-staging")
    # the text is made once, by load, so that each load reads its own lines alone
    (lines.select(*lines.columns, F.explode(times).alias("_time"), (F.col("FiscalYear").cast("int") % 2).alias("_odd")).drop("_time")
     .write.partitionBy("_odd").parquet(text))
    staged = spark.read.schema(", ".join(f"`{c}` string" for c in lines.columns) + ", _odd int").parquet(text)
    for odd in (1, 0):
        part = load_fact_transactions(staged.where(F.col("_odd") == odd).drop("_odd"), customers, star["dim_product"])
        append_keyed(part, path, "fact_transactions", "transaction_key")
    rows = read_table(spark, path, "fact_transactions")
    load = F.when(F.col("fiscal_year") % 2 == 1, 1).otherwise(2).alias("load")
    return present(rows.groupBy(load).agg(
        F.count(F.lit(1)).alias("rows_loaded"), F.countDistinct("transaction_key").alias("distinct_keys"),
        F.min("transaction_key").alias("first_key"), F.max("transaction_key").alias("last_key"),
        F.sum("revenue_inr").alias("revenue_inr")))


def load_quarantine(star: Star) -> DataFrame:
    """Every faulty cell of the dirty staging text, by transaction, column and reason."""
    parsed = parse_staging(dirty_staging(star), "transactions", keep=("TransactionID", "InvoiceID"))
    out = cells.quarantine(parsed, "TransactionID", "InvoiceID")
    return out.select(F.trim("TransactionID").alias("transaction_id"), F.trim("InvoiceID").alias("invoice_id"),
                      "column_name", "reason", "text")


def load_fault_counts(star: Star) -> DataFrame:
    """Faulty cells of the dirty staging text by column and reason."""
    return cells.fault_counts(parse_staging(dirty_staging(star), "transactions"))


def load_whole_rows(star: Star) -> DataFrame:
    """What a load that refuses rows with a faulty cell takes, by year."""
    rows = cells.whole_rows(parse_staging(dirty_staging(star), "transactions"))
    return present(rows.groupBy("fiscal_year").agg(F.count(F.lit(1)).alias("rows_taken"), F.sum("revenue_inr").alias("revenue_inr")))


def load_reload_changes(star: Star) -> DataFrame:
    """Transactions loaded twice by transaction id.  The second load lacks every
    tenth customer, brings others for the first time, and has a further tenth's
    payment status moved on: per kind the keys, and how many rows of the table
    keep their time of creation and show a later change."""
    fact = star.get(ALONE, star["fact_transactions"]).drop("transaction_key")
    n = F.col("customer_key") % 10
    spark = fact.sparkSession
    path, once = scratch_dir(spark, "reloaded"), scratch_dir(spark, "reload-source")
    with unless_set(spark, WRITES_IN_A_ROW):
        fact.write.option("compression", "zstd").parquet(once)  # both loads read it: the joins behind it run once
    fact = spark.read.schema(fact.schema).parquet(once)
    settled = F.when(n == 5, F.when(F.col("payment_status") == "Paid", "Overdue").otherwise("Paid")).otherwise(F.col("payment_status"))
    how = dict(keys=["transaction_id"], schema=FACT_TRANSACTIONS, surrogate="transaction_key", partition="fiscal_year", in_files=True)
    reload_table(fact.where(n != 3), path, **how)
    seen = reload_table(fact.where(n != 4).withColumn("payment_status", settled), path, **how)
    rows = spark.read.parquet(path)
    first = rows.agg(F.min(CREATED).alias("first"))
    both = seen.select("transaction_id", "kind").join(rows, "transaction_id").crossJoin(first)  # one row
    return both.groupBy("kind").agg(
        F.count(F.lit(1)).alias("keys"), F.countDistinct("transaction_key").alias("distinct_keys"),
        F.count_if(F.col(CREATED) == F.col("first")).alias("from_first_load"),
        F.count_if(F.col(UPDATED) > F.col(CREATED)).alias("changed_later"),
        F.count_if(F.col("payment_status") == "Paid").alias("paid"))


def _spelt(c: str, n: Column) -> Column:
    """Four spellings of one label: as it is, upper and lower case, accented."""
    return (F.when(n % 4 == 0, F.upper(c)).when(n % 4 == 1, F.concat(F.lit(" "), F.lower(c)))
            .when(n % 4 == 2, F.concat(F.translate(c, "e", "é"), F.lit("  "))).otherwise(F.col(c)))


def load_label_spelling(star: Star) -> DataFrame:
    """Customers, churn events and budgets loaded twice from text whose free
    labels come in four spellings, a dictionary kept between the loads: rows of
    the second load by column and label."""
    spark = star["dim_customers"].sparkSession
    number = F.regexp_extract("CustomerID", "([0-9]+)", 1).cast("long")
    day = F.month(F.to_date("Period", "dd-MMM-yyyy"))
    text = {"customers": (render_customers(star["dim_customers"]), number, ["Industry", "AcquisitionChannel", "CSM_Owner"]),
            "churn": (render_churn(star["fact_churn"], star["dim_customers"]), number, ["ChurnReason"]),
            "budget": (render_budget(star["fact_budget_vs_actual"]), day, ["Department"])}
    base, stg = scratch_dir(spark, "spelling"), {}
    for name, (df, n, labels) in text.items():
        write_staging(df.select(*[_spelt(c, n).alias(c) if c in labels else F.col(c) for c in df.columns], (n % 4).alias("_n")),
                      f"{base}/{name}")
        stg[name] = spark.read.option("header", True).csv(f"{base}/{name}")
    stg = {name: (spark.read.schema(", ".join(f"`{c}` string" for c in df.columns)).option("header", True).option("escape", '"')
                  .csv(f"{base}/{name}")) for name, df in stg.items()}
    learn_spellings(spark, f"{base}/dictionary", {name: df.where("_n = 3") for name, df in stg.items()})
    spellings = learn_spellings(spark, f"{base}/dictionary", stg)
    customers = star["dim_customers"].select("customer_id", "customer_key")
    loaded = [(load_dim_customers(stg["customers"], surrogate=False, spellings=spellings), ["industry", "acquisition_channel", "csm_owner"]),
              (load_fact_churn(stg["churn"], customers, spellings=spellings), ["churn_reason"]),
              (load_fact_budget(stg["budget"], spellings=spellings), ["department"])]
    out = None
    for df, columns in loaded:
        for c in columns:
            one = df.groupBy(F.col(c).alias("label")).agg(F.count(F.lit(1)).alias("rows_loaded")).select(F.lit(c).alias("column_name"), "label", "rows_loaded")
            out = one if out is None else out.unionByName(one)
    return out


def rev_distinct_by_sketch(star: Star, bound: float = 0.03) -> DataFrame:
    """Distinct transactions and customers per year from monthly sketches that
    were stored and merged: the exact count, and whether the estimate is within
    `bound` of it (one more is allowed for small counts)."""
    fact = star["fact_transactions"].withColumn("month", F.floor(F.col("date_key") / 100))
    spark, ids = fact.sparkSession, ["transaction_id", "customer_key"]
    path = scratch_dir(spark, "sketches")
    period_sketches(fact, ["fiscal_year", "month"], ids).write.parquet(path)
    merged = merged_estimates(spark.read.parquet(path), "fiscal_year")
    both = exact_counts(fact, ids, "fiscal_year").join(merged, ["fiscal_year", "column_name"])
    near = F.abs(F.col("estimate") - F.col("exact")) <= F.col("exact") * bound + 1
    return both.select(F.col("fiscal_year").cast("int").alias("fiscal_year"), "column_name",
                       F.col("exact").alias("distinct_ids"), near.cast("int").alias("within_bound"))


def rev_monthly_from_rollup(star: Star) -> DataFrame:
    """The monthly revenue report from stored partial sums: odd years are rolled
    up first, even years appended, and one of the odd years refreshed again."""
    fact = star["fact_transactions"]
    spark = fact.sparkSession
    path = scratch_dir(spark, "rollup")
    years = [r[0] for r in star["dim_date"].select("fiscal_year").distinct().orderBy("fiscal_year").collect()]  # calendar years
    odd = [y for y in years if y % 2]
    for some in (odd, [y for y in years if y % 2 == 0], odd[:1]):
        refresh_rollup(fact, path, some)
    return rev_monthly_ytd_mom({**star, "fact_transactions": read_rollup(spark, path)})


def catalog_inventory(star: Star) -> DataFrame:
    """The warehouse written, registered in the session catalog and listed from it."""
    spark = star["dim_date"].sparkSession
    root = scratch_dir(spark, "registered")
    write_star({n: star[n] for n in TABLE_DESCRIPTIONS}, root, files_per_partition=None)
    database = "finlake_" + root.rsplit("-", 1)[1]
    register_star(spark, root, database, TABLE_DESCRIPTIONS)
    return inventory(spark, database)


def _by_customer(star: Star) -> Star:
    """The star with customers and transactions written bucketed by customer,
    as many buckets as the session has shuffle partitions."""
    spark = star["dim_customers"].sparkSession
    root = scratch_dir(spark, "colocated")
    database = "finlake_" + root.rsplit("-", 1)[1]
    write_colocated(star, root, database, int(spark.conf.get("spark.sql.shuffle.partitions")), names=("fact_transactions",))
    return {**star, **read_colocated(spark, database)}


def rev_by_industry_colocated(star: Star) -> DataFrame:
    """Revenue by industry from tables laid out by customer."""
    return rev_by_industry(_by_customer(star))


def prf_clv_plan_colocated(star: Star) -> DataFrame:
    """Lifetime value by plan from tables laid out by customer."""
    return prf_clv_plan(_by_customer(star))


def prf_clv_top20_colocated(star: Star) -> DataFrame:
    """The largest lifetime values from tables laid out by customer."""
    return prf_clv_top20(_by_customer(star))


def _written_and_read(name: str, drop: tuple[str, ...] = ()):
    def read_back(star: Star) -> DataFrame:
        spark = star[name].sparkSession
        root = scratch_dir(spark, "read-back")
        write_star({name: star[name]}, root, files_per_partition=None)
        return present(read_star(spark, root, [name])[name].drop(*drop))
    read_back.__doc__ = f"{name} written with audit columns and read in full with its declared types."
    return read_back


# the tables read in full besides the budget (load_write_read_back)
READ_BACK = {f"load_read_back_{n}": _written_and_read(n, tuple(c for c in ("transaction_key", "churn_key") if c in WAREHOUSE[n].names))
             for n in ("dim_date", "dim_customers", "dim_product", "fact_transactions", "fact_churn")}
