"""Removal of long repeated byte strings by distributed prefix doubling.

Every byte that a string of `length` bytes covers goes, if that string also
starts anywhere else, in the same text or another.  Sorting all suffixes would
move each byte many times, so positions are thinned first: the *anchor* of a window of `length`
bytes is the position of the smallest hash of `GRAM` bytes among its first
`SPREAD` positions.  Equal windows have equal anchors at equal distances, and
neighbouring windows share theirs, so each run of windows with one anchor is a row.

1. Prefix doubling over the anchors.  A rank names the text that starts at an
   anchor; ranks of half the prefix come from rolling hashes, and each round
   sorts positions by the pair of their rank and the rank at the offset, counts
   them, and drops those that are unique: no window of theirs repeats.  The last
   round is past length - SPREAD bytes, which all windows of an anchor share.
2. Runs whose whole extent (first to last window) is equal to another's repeat as a
   whole.  What is left are the edges of repeats; one run stands for each extent.
3. These runs are split by distance from the anchor into finer and finer parts
   (`STEPS`), and each part is decided the same way, down to one window.

Results are exact but for hash collisions: prefixes are named by 64 bits, and what is
removed is decided by 128.  Rows never gather by key except in aggregations and
joins, which Spark combines before the shuffle or splits, so a passage in a
third of all texts is no group in one task.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlake.llm import bloom
from finlake.llm import text as T
from finlake.session import scratch_dir

LENGTH = 400
SPREAD = 200
GRAM = 16
STEPS = (40, 8, 1)

_ROW = ["lo", "hi", "p"]


def _runs(data: np.ndarray, off: np.ndarray, rolling: T.Rolling, length: int, spread: int):
    """Runs of windows with one anchor: text, first and last window, anchor,
    as places in `data`."""
    n = len(data) - GRAM + 1
    long = np.flatnonzero(np.diff(off) >= length)
    if n <= 0 or not len(long):
        return (np.zeros(0, np.int64),) * 4
    at = np.arange(n)
    low = (rolling.span(at, at + GRAM) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    size = 1
    while size < spread:  # smallest of the next `size` hashes; the low half is its place
        more = min(size, spread - size)
        low = np.minimum(low[:-more], low[more:])
        size += more
    change = np.zeros(len(low) + 1, np.int8)
    change[off[long]] += 1
    change[off[long + 1] - length + 1] -= 1
    window = np.flatnonzero(np.cumsum(change[:-1], dtype=np.int8))
    p = (low[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    last = np.append(new[1:], len(p)) - 1
    return np.searchsorted(off, window[new], "right") - 1, window[new], window[last], p[new]


def _extent(rolling, second, lo, hi, p, length):
    """128 bits of a run's whole extent and its distances from the anchor."""
    where = T.mix((p - lo).astype(np.uint64) * np.uint64(T._BASE_2) + (hi - lo).astype(np.uint64))
    return rolling.span(lo, hi + length) ^ where, second.span(lo, hi + length)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchor_rows(length: int, spread: int):
    half = (length - spread + 2) // 2
    shared = length - spread + 1

    def run(batches):
        for chunk in T.chunks(batches):
            data, off = T.utf8(chunk.column("text"))
            rolling, second = T.Rolling(data), T.Rolling(data, T._BASE_2)
            doc, lo, hi, p = _runs(data, off, rolling, length, spread)
            s1, s2 = _extent(rolling, second, lo, hi, p, length)
            a, b = rolling.span(p, p + half), rolling.span(p + shared - half, p + shared)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("id").take(take), chunk.column("th").take(take)]
                + [pa.array(x - off[doc]) for x in (lo, hi, p)] + [_signed(x) for x in (a, b, s1, s2)],
                ["id", "th", *_ROW, "k1", "k2", "s1", "s2"])
    return run


def _place_key(th: np.ndarray, p: np.ndarray) -> np.ndarray:
    return T.mix(th.astype(np.int64).view(np.uint64) + T.mix(p.astype(np.uint64))).view(np.int64)


def _snippets(length: int, spread: int, wanted):
    def run(batches):
        for chunk in T.chunks(batches):
            data, off = T.utf8(chunk.column("text"))
            doc, lo, hi, p = _runs(data, off, T.Rolling(data), length, spread)
            th = chunk.column("th").to_numpy(zero_copy_only=False)
            pick = np.flatnonzero(bloom.contains(wanted.value, _place_key(th[doc], p - off[doc])))
            raw, take = data.tobytes(), pa.array(doc[pick])
            yield pa.RecordBatch.from_arrays(
                [chunk.column("id").take(take), chunk.column("th").take(take), pa.array((p - off[doc])[pick]),
                 pa.array((lo - off[doc])[pick]), pa.array([raw[lo[i]:hi[i] + length] for i in pick.tolist()], pa.binary())],
                ["id", "th", "p", "base", "snippet"])
    return run


def _split(length: int, step: int):
    """Parts of runs by distance from the anchor, `step` distances each."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                if not b.num_rows:
                    continue
                snippet = b.column("snippet")
                raw = b"".join(snippet.to_pylist())
                size = np.array([len(x) for x in snippet.to_pylist()], np.int64)
                start = np.cumsum(size) - size
                data = np.frombuffer(raw, np.uint8)
                base, lo, hi, p = (b.column(c).to_numpy(zero_copy_only=False) for c in ("base", *_ROW))
                first, last = (p - hi) // step, (p - lo) // step
                n = last - first + 1
                row = np.repeat(np.arange(len(n)), n)
                q = first[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                lo, hi = np.maximum(lo[row], p[row] - (q + 1) * step + 1), np.minimum(hi[row], p[row] - q * step)
                shift = (start - base)[row]
                rolling, second = T.Rolling(data), T.Rolling(data, T._BASE_2)
                s1, s2 = _extent(rolling, second, lo + shift, hi + shift, p[row] + shift, length)
                # what all windows of a part share, whether or not the run has them all
                c, d = p[row] - q * step + shift, p[row] - (q + 1) * step + 1 + length + shift
                k1, k2 = rolling.span(c, d) + T.mix(q.astype(np.uint64)), second.span(c, d)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(take), b.column("th").take(take), pa.array(lo), pa.array(hi), pa.array(p[row]),
                     _signed(k1), _signed(k2), _signed(s1), _signed(s2), b.column("known").take(take)],
                    ["id", "th", *_ROW, "k1", "k2", "s1", "s2", "known"])
    return run


def _cover(length: int, with_kept: bool):
    def run(batches):
        for chunk in T.chunks(batches):
            data, off = T.utf8(chunk.column("text"))
            raw = data.tobytes()
            spans, kept, sha = [], [], []
            for i, ranges in enumerate(chunk.column("ranges").to_pylist()):
                text, out, at, rest = raw[off[i]:off[i + 1]], [], 0, []
                for s, e in sorted((x["lo"], x["hi"] + length) for x in ranges or ()):
                    if out and s <= out[-1]["end"]:
                        out[-1]["end"] = max(e, out[-1]["end"])
                    else:
                        out.append({"start": s, "end": e})
                for x in out:
                    rest.append(text[at:x["start"]])
                    at = x["end"]
                rest = b"".join(rest) + text[at:]
                spans.append(out)
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_kept else None)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("id"), pa.array(np.diff(off)),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["id", "n_bytes", "removed", "kept_sha256", "kept"])
    return run


class _Tables:
    """Tables of one run under the shared folder, each written once.  A table
    that nothing reads any more makes room: its successor is written down, so no
    lost executor needs it."""

    def __init__(self, spark):
        self.spark, self.base, self.n = spark, scratch_dir(spark, "repeats"), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.base}/{self.n}")
        return self.spark.read.parquet(f"{self.base}/{self.n}")

    def drop(self, df: DataFrame) -> None:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _not_unique(rows: DataFrame, rank: list[str]) -> DataFrame:
    twice = rows.groupBy(*rank).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(twice, rank, "leftsemi")


def _decide(rows: DataFrame, tables: _Tables) -> tuple[DataFrame, DataFrame]:
    """(windows that repeat: id, th, lo, hi; runs that are still open).

    Runs with equal extents repeat.  Where a shared core (k1, k2) has several
    extents, one run of each stays open, for the finer parts; `known` tells
    that its windows are already known to repeat."""
    extent = ["k1", "k2", "s1", "s2"]
    classes = rows.groupBy(*extent).agg(F.count(F.lit(1)).alias("n"), F.max("known").alias("known"),
                                        F.min(F.struct("id", "th", *_ROW)).alias("one"))
    cores = rows.groupBy("k1", "k2").agg(F.min("s1").alias("a"), F.max("s1").alias("b"), F.min("s2").alias("c"), F.max("s2").alias("d"))
    mixed = cores.where("a != b or c != d").select("k1", "k2", F.lit(True).alias("mixed"))
    classes = tables.keep(classes.join(mixed, ["k1", "k2"], "left").withColumn("known", (F.col("n") > 1) | F.col("known"))
                          .where("known or mixed"))
    found = tables.keep(rows.where("not known").join(classes.where("known").select(*extent), extent, "leftsemi")
                        .select("id", "th", "lo", "hi"))
    return found, classes.where("mixed").select("one.*", "known")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   spread: int = SPREAD, steps: tuple[int, ...] = STEPS, with_kept: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, removed (array of byte ranges start,
    end; disjoint, maximal, sorted), kept_sha256 and kept (the remaining
    bytes, which may cut a character; NULL unless `with_kept`).

    NULL texts are empty; texts shorter than `length` bytes keep everything.
    Repeated rows are two texts and so remove each other.  Other columns are left out.  `spread`
    is at most half of `length`; the last step must be 1.
    """
    spark = docs.sparkSession
    tables = _Tables(spark)
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("th", F.xxhash64("text"))
    kind = d.schema["id"].dataType.simpleString()
    head = f"id {kind}, th long, "
    spans = "lo long, hi long, p long, k1 long, k2 long, s1 long, s2 long"
    rows = tables.keep(d.where(F.octet_length("text") >= length).mapInArrow(_anchor_rows(length, spread), head + spans))

    # prefix doubling: ranks of the first half, then pairs of ranks at an offset
    half = tables.keep(_not_unique(rows, ["k1"]))
    tables.drop(rows)
    rows = tables.keep(_not_unique(half, ["k1", "k2"]).withColumn("known", F.lit(False)))
    tables.drop(half)
    found, open_ = _decide(rows, tables)
    found, open_ = [found], tables.keep(open_)
    tables.drop(rows)

    def place(batches):
        for b in batches:
            th, p = (b.column(c).to_numpy(zero_copy_only=False) for c in ("th", "p"))
            yield pa.RecordBatch.from_arrays([pa.array(_place_key(th, p))], ["place"])

    places = tables.keep(open_.select("th", "p").mapInArrow(place, "place long"))
    wanted = spark.sparkContext.broadcast(bloom.build(places, "place"))
    texts = d.where(F.octet_length("text") >= length)
    snippets = texts.mapInArrow(_snippets(length, spread, wanted), head + "p long, base long, snippet binary")
    # the filter lets too much through: only places of open runs are kept
    at = open_.select("id", "th", "p").distinct()
    same = [snippets["id"].eqNullSafe(at["id"]), snippets["th"] == at["th"], snippets["p"] == at["p"]]
    snippets = tables.keep(snippets.join(at, same, "leftsemi").dropDuplicates(["id", "th", "p"]))
    for step in steps:
        o = open_
        same = [snippets["id"].eqNullSafe(o["id"]), snippets["th"] == o["th"], snippets["p"] == o["p"]]
        parts = snippets.join(o, same).select(snippets["id"], snippets["th"], "lo", "hi", snippets["p"], "base", "snippet", "known")
        rows = tables.keep(parts.mapInArrow(_split(length, step), head + spans + ", known boolean"))
        more, left = _decide(rows, tables)
        found.append(more)
        left = tables.keep(left)
        tables.drop(rows)
        tables.drop(open_)
        open_ = left
    tables.drop(snippets)

    ranges = found[0]
    for f in found[1:]:
        ranges = ranges.union(f)
    ranges = ranges.groupBy("id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    joined = d.join(ranges, [d["id"].eqNullSafe(ranges["id"]), d["th"] == ranges["th"]], "left").select(d["id"], "text", "ranges")
    out = joined.mapInArrow(_cover(length, with_kept), f"id {kind}, n_bytes long, removed array<struct<start:bigint,end:bigint>>, kept_sha256 string, kept binary")
    return out.withColumnRenamed("id", id_col)
