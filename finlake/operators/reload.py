"""Loading a table again by its key: only what changed is written.

A table kept by ``reload_table`` has, beside its columns, a row hash,
created_at and updated_at.  A further load is compared with the stored keys and
hashes alone (a few narrow columns of the table are read).  Then the year
partitions that have a new or a changed row are rewritten; the others are not
touched.  created_at stays, updated_at moves only where the row changed.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from finlake.operators.keybits import key_hash, split_by_keys
from finlake.operators.keys import with_stored_keys
from finlake.session import WRITES_IN_A_ROW, scratch_dir, unless_set

HASH, CREATED, UPDATED = "row_hash", "created_at", "updated_at"


def row_hash(columns: list[str]) -> Column:
    """64-bit hash of a row; which columns are NULL counts too."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])


def _packed(columns: list[str], keys: list[str]) -> Column:
    """A row without its key, its hash first."""
    return F.struct(HASH, *[c for c in columns if c not in keys])


def _unpacked(columns: list[str], keys: list[str]) -> list[Column]:
    """The row again; its hash is made anew where it is wanted."""
    return [F.col(c) if c in keys else F.col(f"_r.`{c}`").alias(c) for c in columns]


def _null(like: Column, of: DataFrame) -> Column:
    return F.lit(None).cast(of.select(like.alias("x")).schema["x"].dataType)


def _together(a: DataFrame | None, b: DataFrame | None) -> DataFrame:
    return a.unionByName(b) if a is not None and b is not None else b if a is None else a


def reload_table(load: DataFrame, path: str, keys: list[str], schema: StructType, surrogate: str | None = None,
                 partition: str | None = None, in_files: bool = False) -> DataFrame:
    """Brings the table at `path` up to a load and returns what each key was, a
    written frame: the key columns, kind (new, changed, same, or absent where
    the load lacks a stored key; such rows stay) and its partition.

    `schema` has the table's declared columns; with `surrogate`, a new row gets
    the next stored key and an old row keeps its own.  Keys are compared null
    for null.  Of rows of a load with the same key the smallest by hash, then
    by columns, is taken.  One load runs at a time; the first makes the table.
    A load that changes nothing writes nothing.  A row hash is 64 bits: a change
    that keeps it goes unnoticed with a chance of 2^-64.

    Keys and hashes alone tell what a key is.  Whole rows are shuffled only
    where their key repeats (first load) or is new or changed (further ones),
    or where bits of bounded size cannot tell; rows with one key are combined
    before that, so a key with very many rows is no large group.  The load is
    read several times: once written here, or where it stands if it reads only
    files that stay as they are (`in_files`).  What is written on the way is
    deleted when the table stands."""
    spark = load.sparkSession
    columns = [f.name for f in schema.fields if f.name != surrogate]
    names = [f.name for f in schema.fields] + [HASH, CREATED, UPDATED]
    part = [partition] if partition else []
    base = scratch_dir(spark, "reload")
    codec = spark.conf.get("spark.sql.parquet.compression.codec", None) or "zstd"
    p, fs = _fs(spark, path)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    def done() -> DataFrame:
        for name in ("load", "repeated", "moved", "keyed", "rows"):
            there, its_fs = _fs(spark, f"{base}/{name}")
            its_fs.delete(there, True)
        return kinds.select(*keys, "kind", *[F.coalesce("_to", "_from").alias(c) for c in part])

    def numbered(df: DataFrame, after: int) -> DataFrame:
        """New rows, written once, with the next keys."""
        return with_stored_keys(df, surrogate, after, f"{base}/keyed") if surrogate else kept(df, "keyed")

    with unless_set(spark, WRITES_IN_A_ROW):
        new = load.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields if f.name != surrogate])
        new = (new if in_files else kept(new, "load")).withColumn(HASH, row_hash(columns))
        now = F.lit(spark.sql("select current_timestamp()").first()[0])
        stored = None
        if fs.exists(p):
            stored = spark.read.parquet(path)
            stored = stored.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields], HASH, CREATED, UPDATED)

        if stored is None:
            # rows of keys that come once are taken as they are
            repeated = kept(new.groupBy(key_hash(keys)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_h"), "repeated")
            some, others = split_by_keys(new, repeated, keys, repeated.count())
            if some is not None:
                some = some.groupBy(*keys).agg(F.min(_packed(columns, keys)).alias("_r")).select(*_unpacked(columns, keys))
            fresh = numbered(_together(some, others.select(*columns) if others is not None else None), 0)
            kinds = kept(fresh.select(*keys, F.lit("new").alias("kind"), *[F.col(c).alias("_to") for c in part],
                                      *[F.lit(None).cast(schema[c].dataType).alias("_from") for c in part]), "kinds")
            if kinds.limit(1).count():
                out = fresh.withColumns({HASH: row_hash(columns), CREATED: now, UPDATED: now}).select(*names)
                (out.write.partitionBy(*part) if part else out.write).option("compression", codec).parquet(path)
            return done()

        # what each key is: its least hash in the load meets the stored one
        n = F.struct(HASH, *[F.col(c).alias("to") for c in part])
        o = F.struct(HASH, *[F.col(c).alias("from") for c in part], *([surrogate] if surrogate else []), CREATED)
        met = (new.select(*keys, n.alias("_n"), _null(o, stored).alias("_o"))
               .unionByName(stored.select(*keys, _null(n, new).alias("_n"), o.alias("_o")))
               .groupBy(*keys).agg(F.min("_n").alias("_n"), F.min("_o").alias("_o")))
        kind = (F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "absent")
                .when(F.col(f"_o.{HASH}") == F.col(f"_n.{HASH}"), "same").otherwise("changed"))
        old = [*([surrogate] if surrogate else []), CREATED]  # of changed rows alone
        kinds = kept(met.withColumn("kind", kind).select(
            *keys, "kind", *[F.col("_n.to").alias("_to") for _ in part], *[F.col("_o.from").alias("_from") for _ in part],
            *[F.when(F.col("kind") == "changed", F.col(f"_o.`{c}`")).alias(f"_{c}") for c in old]), "kinds")
        moved = kinds.where("kind in ('new', 'changed')")
        changed = kinds.where("kind = 'changed'").select(*keys)
        n_moved, n_changed = kinds.agg(F.count_if(F.col("kind").isin("new", "changed")), F.count_if(F.col("kind") == "changed")).first()
        if not n_moved:
            return done()

        # rows of new and changed keys meet what is stored for them
        some, _ = split_by_keys(new, moved.select(key_hash(keys)), keys, n_moved)
        said = F.struct("kind", *[f"_{c}" for c in old])
        moved = kept(some.select(*keys, _packed(columns, keys).alias("_r"), _null(said, moved).alias("_k"))
                     .unionByName(moved.select(*keys, _null(_packed(columns, keys), new).alias("_r"), said.alias("_k")))
                     .groupBy(*keys).agg(F.min("_r").alias("_r"), F.min("_k").alias("_k")).where(F.col("_k").isNotNull())
                     .select(*_unpacked(columns, keys), "_k.kind", *[F.col(f"_k.`_{c}`") for c in old]), "moved")
        fresh = numbered(moved.where("kind = 'new'").select(*columns), (stored.agg(F.max(surrogate)).first()[0] or 0) if surrogate else 0)
        fresh = fresh.withColumn(CREATED, now)
        row = moved.where("kind = 'changed'").select(*columns, *[F.col(f"_{c}").alias(c) for c in old])

        # partitions with a new or changed row, before or after: a list of partition values
        touched, there = None, stored
        if part:
            to, was = moved.select(partition), kinds.where("kind = 'changed'").select(F.col("_from").alias(partition))
            touched = [r[0] for r in to.unionByName(was).distinct().collect()]
            there = stored.where(F.col(partition).isin([t for t in touched if t is not None]) | (
                F.col(partition).isNull() if None in touched else F.lit(False)))
        may, stay = split_by_keys(there, changed.select(key_hash(keys)), keys, n_changed)
        if may is not None:
            stay = _together(may.join(changed, _same(may, changed, keys), "left_anti"), stay)
        out = fresh.unionByName(row).withColumns({HASH: row_hash(columns), UPDATED: now}).select(*names).unionByName(stay.select(*names))
        if not part:  # nothing that is read is overwritten
            kept(out, "rows").write.mode("overwrite").option("compression", codec).parquet(path)
            return done()
        # the new files are staged beside the old ones, which go when all are written
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", codec).partitionBy(partition).parquet(path)
        stays = kinds.where("kind in ('same', 'absent')").select(F.col("_from").alias(partition))
        left = {r[0] for r in stays.unionByName(to).distinct().collect()}
        for y in touched:  # a partition whose last row moved elsewhere
            if y not in left:
                gone, fs = _fs(spark, f"{path}/{partition}={'__HIVE_DEFAULT_PARTITION__' if y is None else y}")
                fs.delete(gone, True)
        return done()
