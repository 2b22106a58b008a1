"""One spelling for free labels that differ only in case, accents or spaces
around them, kept across loads.

The dictionary is a Parquet table (column_name, spelling) with one row per
label.  ``learn`` adds the labels that it cannot yet tell, each in its smallest
spelling; a spelling once stored stays.  ``unify`` replaces the labels of a
frame.  Labels are compared as the reference's collation does, so grouping by a
unified column gives its groups.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "column_name string, spelling string"


def collated(c) -> Column:
    return F.collate(F.trim(F.col(c) if isinstance(c, str) else c), "UNICODE_CI_AI")


def read_spellings(spark: SparkSession, path: str) -> DataFrame:
    """The stored dictionary; an empty one before the first load."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def learn(spark: SparkSession, path: str, labels: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Adds new labels, given as (frame, its column, column_name), to the
    dictionary and returns it.  NULL and empty labels are not stored.  Map-side
    distinct leaves one row per label and task to shuffle."""
    known = read_spellings(spark, path)
    said = None
    for df, source, column in labels:
        one = df.select(F.lit(column).alias("column_name"), F.trim(source).alias("label")).where("label <> ''").distinct()
        said = one if said is None else said.unionByName(one)
    if said is not None:
        k = known.select(F.col("column_name").alias("_column"), collated("spelling").alias("_key"))
        new = said.join(k, (said["column_name"] == k["_column"]) & (collated(said["label"]) == k["_key"]), "left_anti")
        (new.groupBy("column_name", collated("label").alias("_key")).agg(F.min("label").alias("spelling"))
         .select("column_name", "spelling").coalesce(1).write.mode("append").parquet(path))
    return read_spellings(spark, path)


def unify(df: DataFrame, spellings: DataFrame, *columns: str) -> DataFrame:
    """Each column's labels in their stored spelling; labels that the
    dictionary lacks are trimmed only.  One row per label is joined; whether
    it is broadcast is left to its measured size."""
    out = df
    for c in columns:
        one = spellings.where(F.col("column_name") == c).select(F.col("spelling").alias("__spelling"), collated("spelling").alias("__key"))
        out = (out.join(one, collated(out[c]) == one["__key"], "left")
               .withColumn(c, F.coalesce("__spelling", F.trim(c))).drop("__spelling", "__key"))
    return out.select(*df.columns)
