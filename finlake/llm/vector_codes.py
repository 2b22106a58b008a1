"""Short codes for vectors: each vector is cut into parts, and each part becomes
the index of the nearest entry of its position's codebook.

Codebooks are fitted by Lloyd rounds whose members stay where they are.  Parts
lie in a table partitioned by (position, entry, salt), the salt spreading an
entry that holds most parts.  A round sums the resident members task by task
(only sums leave a task), replaces the entries, and assigns the members again
in place; the parts whose entry changed, and no others, go through the next
shuffle to their new owners.  The codebooks, positions x entries x width
integers whatever the number of vectors, are all that the driver sees.
"""
from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlake.session import scratch_dir

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: owners of one (position, entry): parts are dealt to them by their row's number
SALTS = 16
_ROWS = 2048  # vectors handled at once in a task
_MEMBER = "pos int, entry int, salt int, x array<bigint>"
_LONG = (1 << 63) - 1


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (lowest index among equals) and its squared
    distance for each row of integers, exactly: in doubles while every sum
    stays below 2^53, else in Python integers."""
    top = max(int(np.abs(a.astype(float)).max(initial=0)) for a in (x, book))
    if 4 * x.shape[1] * (top + 1) ** 2 < 1 << 53:
        a, b = x.astype(float), book.astype(float)
        score = (b * b).sum(1) - 2 * (a @ b.T)
        at = score.argmin(1)
        return at, ((a * a).sum(1) + score[np.arange(len(a)), at]).astype(np.int64)
    away = ((x.astype(object)[:, None, :] - book.astype(object)[None]) ** 2).sum(2)
    at = np.array([int(r.argmin()) for r in away], np.int64)
    return at, np.array([min(int(r[i]), _LONG) for r, i in zip(away, at)], object)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """List column as rows of `width` integers, short lists followed by zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _slices(batches):
    for b in batches:
        for lo in range(0, b.num_rows, _ROWS):
            yield b.slice(lo, _ROWS)


def _members(pos, entry, salt, x: np.ndarray, moved=None) -> pa.RecordBatch:
    off = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
    cols = [pa.array(a, pa.int32()) for a in (pos, entry, salt)]
    cols.append(pa.ListArray.from_arrays(off, pa.array(x.ravel(), pa.int64())))
    names = ["pos", "entry", "salt", "x"]
    if moved is not None:
        cols.append(pa.array(moved, pa.int32()))
        names.append("moved")
    return pa.RecordBatch.from_arrays(cols, names)


def _first_owners(books, width: int):
    """Whole vectors to the members of the first codebooks' owners."""
    def run(batches):
        for b in _slices(batches):
            parts = len(books.value)
            x = _matrix(b.column("x"), parts * width)
            salt = b.column("row").to_numpy() % SALTS
            for p, book in enumerate(books.value):
                part = np.ascontiguousarray(x[:, p * width:(p + 1) * width])
                yield _members(np.full(len(x), p), nearest(part, book)[0], salt, part)
    return run


def _by_position(b: pa.RecordBatch):
    pos = b.column("pos").to_numpy()
    for p in np.unique(pos).tolist():
        yield p, np.flatnonzero(pos == p)


def _assigned_again(books, width: int):
    """Members in place, with the entry they have now and whether it changed."""
    def run(batches):
        for b in _slices(batches):
            x, old, salt = _matrix(b.column("x"), width), b.column("entry").to_numpy(), b.column("salt").to_numpy()
            for p, here in _by_position(b):
                now = nearest(x[here], books.value[p])[0]
                yield _members(np.full(len(here), p), now, salt[here], x[here], (now != old[here]).astype(np.int32))
    return run


def _owner_sums(parts: int, entries: int, width: int):
    """Per task the count and the component sums of each owner's members."""
    def run(batches):
        n = np.zeros(parts * entries, np.int64)
        total = np.zeros((parts * entries, width), object)
        for b in _slices(batches):
            key = b.column("pos").to_numpy() * entries + b.column("entry").to_numpy()
            x = _matrix(b.column("x"), width)
            if np.abs(x.astype(float)).max(initial=0) >= 1 << 50:
                x = x.astype(object)  # _ROWS of them could pass 64 bits
            order = np.argsort(key, kind="stable")
            found, first = np.unique(key[order], return_index=True)
            total[found] += np.add.reduceat(x[order], first, axis=0).astype(object)
            n += np.bincount(key, minlength=len(n))
        for k in np.flatnonzero(n).tolist():
            yield pa.RecordBatch.from_arrays(
                [pa.array([v] * width, t) for v, t in ((k // entries, pa.int32()), (k % entries, pa.int32()))]
                + [pa.array(range(width), pa.int32()), pa.array([Decimal(int(v)) for v in total[k]], pa.decimal128(38, 0)),
                   pa.array([int(n[k])] * width, pa.int64())], ["pos", "entry", "at", "total", "n"])
    return run


def _encode(books, width: int, digits: int):
    name = np.array([b"%0*x" % (digits, i) for i in range(max(len(b) for b in books.value))])

    def run(batches):
        for b in _slices(batches):
            parts = len(books.value)
            x = _matrix(b.column("x"), parts * width)
            code, error = np.zeros((len(x), parts), np.int64), np.zeros(len(x), object)
            for p, book in enumerate(books.value):
                code[:, p], away = nearest(np.ascontiguousarray(x[:, p * width:(p + 1) * width]), book)
                error = error + away.astype(object)
            said = np.ascontiguousarray(name[code]).view(f"S{digits * parts}").ravel().astype(str)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(said.tolist(), pa.string()),
                                              pa.array([min(e, _LONG) for e in error], pa.int64())], ["id", "code", "error"])
    return run


def quantized(vectors: DataFrame, id_col: str, vector_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """id (a struct of the id and the kept columns) and x, the vector as the
    integers floor(SCALE * component), for vectors without NULL or non-finite
    components.  Integers beyond 64 bits become the nearest 64-bit integer."""
    v = F.col(f"`{vector_col}`")
    broken = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    whole = vectors.where(v.isNotNull() & ~F.coalesce(broken, F.lit(False)))
    return whole.select(F.struct(*[F.col(f"`{c}`") for c in (id_col, *keep)]).alias("id"),
                        F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("x"))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (),
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows, codebooks): id, kept columns, code (an index per part, two or
    more hex digits each) and error (summed squared distances) of each vector,
    and per part position the entries as integers.

    A position's codebook starts as that part of the `entries` vectors with the
    smallest ids (NULL ids last, equal ids by their vector); there are fewer
    entries where there are fewer vectors.  Ties go to the lower index, entries
    without parts stay.  Vectors that are NULL or hold a NULL or non-finite
    component are left out; repeated rows count each.  Vectors whose length is
    not a multiple of `parts`, or that are shorter than the longest, count as
    followed by zeros.  No vectors give no rows and no codebooks.  Errors
    beyond 64 bits become the largest 64-bit integer.  Other columns are left
    out; `keep` must not name code or error.  Tables are written under
    ``spark.checkpoint.dir``.
    """
    spark = vectors.sparkSession
    base = scratch_dir(spark, "vectors")
    (quantized(vectors, id_col, vector_col, keep).withColumn("row", F.monotonically_increasing_id())
     .write.parquet(f"{base}/kept"))
    kept = spark.read.parquet(f"{base}/kept")
    longest = kept.agg(F.max(F.size("x"))).first()[0]
    names = [F.col(f"id.`{c}`").alias(c) for c in (id_col, *keep)]
    if longest is None:
        return kept.select(*names, F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    width = max(1, -(-longest // parts))
    first = kept.orderBy(F.col(f"id.`{id_col}`").asc_nulls_last(), "x").limit(entries).select("x").collect()
    start = np.zeros((len(first), parts * width), np.int64)
    for i, r in enumerate(first):
        start[i, :len(r["x"])] = r["x"]
    books = [start[:, p * width:(p + 1) * width].copy() for p in range(parts)]

    for k in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        if k == 0:
            placed = kept.mapInArrow(_first_owners(shared, width), _MEMBER)
            placed.repartition("pos", "entry", "salt").write.parquet(f"{base}/owned-0")
            members = spark.read.parquet(f"{base}/owned-0")
        else:
            members.mapInArrow(_assigned_again(shared, width), f"{_MEMBER}, moved int").write.partitionBy("moved").parquet(f"{base}/seen-{k}")
            seen = spark.read.schema(f"{_MEMBER}, moved int").parquet(f"{base}/seen-{k}")
            seen.where("moved = 1").drop("moved").repartition("pos", "entry", "salt").write.parquet(f"{base}/moved-{k}")
            members = seen.where("moved = 0").drop("moved").unionByName(spark.read.schema(_MEMBER).parquet(f"{base}/moved-{k}"))
        sums = (members.mapInArrow(_owner_sums(parts, len(first), width), "pos int, entry int, at int, total decimal(38,0), n long")
                .groupBy("pos", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))
        books = [b.copy() for b in books]
        for r in sums.collect():  # positions x entries x width rows at most
            books[r["pos"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    shared = spark.sparkContext.broadcast(books)
    digits = max(2, len(f"{max(0, len(first) - 1):x}"))
    coded = kept.mapInArrow(_encode(shared, width, digits), f"id {kept.schema['id'].dataType.simpleString()}, code string, error long")
    coded.write.parquet(f"{base}/coded")
    return spark.read.parquet(f"{base}/coded").select(*names, "code", "error"), books
