"""Staging CSV scans and warehouse table writers/readers."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from finlake.schemas import STAGING

# fact tables are partitioned by their fiscal year (partition pruning on the
# most common filter/group key); dimensions are written unpartitioned.
NULL_TEXT = "\\N"
STAGING_FILE_ROWS = 1_000_000
AUDIT_COLS = ["created_at", "updated_at"]
PARTITION_COLS = {"fact_transactions": ["fiscal_year"],
                  "fact_budget_vs_actual": ["fiscal_year"]}


def read_staging(spark: SparkSession, path: str, table: str, keep_corrupt: bool = False,
                 multi_line: bool = False) -> DataFrame:
    """All-string staging scan of a comma-separated file with a header row and
    optional double quotes.  Malformed lines are kept (PERMISSIVE) with NULLs,
    as a lenient bulk loader would; an empty field is an empty text and only
    ``\\N`` is NULL; a quoted line break splits a row unless ``multi_line`` (which reads
    each file in one task) is set; ``keep_corrupt=True`` adds the raw text
    of lines whose field count does not match the schema as
    ``_corrupt_record`` (NULL for well-formed lines).  Plain (uncompressed or
    splittable-codec) files are split across tasks."""
    schema = STAGING[table]
    r = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
         .option("mode", "PERMISSIVE").option("multiLine", multi_line))
    if keep_corrupt:
        schema = StructType(schema.fields + [StructField("_corrupt_record", StringType(), True)])
        r = r.option("columnNameOfCorruptRecord", "_corrupt_record")
    # the scan gives NULL for an empty field; only the NULL mark is one
    return r.schema(schema).csv(path).withColumns({
        f.name: F.when(F.col(f.name) == NULL_TEXT, F.lit(None)).otherwise(F.coalesce(F.col(f.name), F.lit("")))
        for f in STAGING[table].fields})


def write_staging(df: DataFrame, path: str) -> None:
    """Staging text as CSV (header, quoted fields, spaces kept) that
    ``read_staging`` reads back as it was.  Files are compressed and, as each
    is then read by one task, hold at most ``STAGING_FILE_ROWS`` rows."""
    (df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("compression", "gzip").option("maxRecordsPerFile", STAGING_FILE_ROWS)
     .option("nullValue", NULL_TEXT).option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_table(df: DataFrame, path: str, name: str | None = None,
                mode: str = "overwrite", files_per_partition: int | None = None,
                spread_cols: list[str] | None = None) -> None:
    """INSERT ... SELECT into a warehouse table: Parquet, facts partitioned by
    fiscal_year, with the audit columns created_at and updated_at.

    ``files_per_partition`` shuffles rows by (partition value, hash bucket of
    ``spread_cols``) first, so each task writes one file of one year and a
    year holding most rows is still spread over that many tasks; buckets come
    from a hash, so a retried task rewrites exactly the same rows."""
    out = df.withColumns({c: F.current_timestamp() for c in AUDIT_COLS})
    parts = PARTITION_COLS.get(name or "", [])
    if parts and files_per_partition:
        spread = spread_cols or [c for c in df.columns if c not in parts][:1]
        bucket = F.pmod(F.xxhash64(*spread), F.lit(files_per_partition))
        out = out.repartition(*[F.col(p) for p in parts], bucket)
    w = out.write.mode(mode)
    if parts:
        w = w.partitionBy(*parts)
    w.parquet(path)


def append_keyed(df: DataFrame, path: str, name: str, key: str, **how) -> None:
    """Appends rows to a warehouse table, each with a key of its own that
    follows the largest one there; one load runs at a time."""
    from finlake.operators.keys import with_stored_keys
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    last = None
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        last = spark.read.parquet(path).agg(F.max(key)).first()[0]  # reads one column
    write_table(with_stored_keys(df, key, last or 0), path, name, mode="append", **how)


def read_table(spark: SparkSession, path: str, name: str | None = None, audit: bool = False) -> DataFrame:
    """A warehouse table in full.  With its name, the columns have their
    declared types (a partition column is not guessed from folder names);
    ``audit`` keeps created_at and updated_at."""
    from finlake.schemas import WAREHOUSE
    df = spark.read.parquet(path)
    if name in WAREHOUSE:
        df = df.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in WAREHOUSE[name].fields if f.name in df.columns})
    return df if audit else df.drop(*AUDIT_COLS)


def write_star(star: dict, root: str, files_per_partition: int | None = 4) -> dict[str, str]:
    """Materialize a star schema under ``root`` (one Parquet table each); facts
    get at most ``files_per_partition`` files per year, or with None, one per
    year from each task that computes them: no shuffle, and no task that holds
    a whole year."""
    paths = {}
    for name, df in star.items():
        p = f"{root}/{name}"
        write_table(df, p, name, files_per_partition=files_per_partition)
        paths[name] = p
    return paths


def read_star(spark: SparkSession, root: str, names=None) -> dict[str, DataFrame]:
    from finlake.schemas import WAREHOUSE
    return {n: read_table(spark, f"{root}/{n}", n) for n in (names or WAREHOUSE)}
