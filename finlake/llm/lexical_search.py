"""Ranked lexical search with Block-Max MaxScore.

Documents are cut into shards, runs of documents of a task, and each shard
becomes an index row: for every term asked for a posting list in blocks of 128
documents, as differences of document numbers and term counts in few bytes,
and beside each block the least document length for each count in it.  Those
give the block's largest score exactly once the corpus statistics are known,
so one pass over the texts is enough.

A shard answers a query by windows of documents.  The lists are put in order
of their largest score; those whose sum stays below the 50th best score found
so far are non-essential: they cannot bring a document in on their own.
Candidates come from the essential lists.  A candidate is then checked against
the non-essential lists from the strongest to the weakest, by the largest score
of the block that it would stand in, and only blocks that still hold a
candidate are decompressed.  Spark merges the shards' best by a window with a
rank limit, which every task applies before the shuffle.

Queries are taken in blocks of 4 MB of text, so what is broadcast is bounded:
a block's vocabulary and its weights.  All documents pass for each block.
"""
from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finlake.llm import text as T
from finlake.session import scratch_dir

BEST = 50
BLOCK = 128
WINDOW = 2048  # documents looked at between two updates of the threshold
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 16
QUERY_BYTES = 4 << 20

_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_IN_TERM = np.ones(256, bool)
_IN_TERM[:128] = T.byte_table(r"[0-9A-Za-z]")[:128]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ARRAYS = ["length", "first", "gap", "count", "block_at", "list_at", "edge_at", "edge_count", "edge_length"]
_INDEX = ("shard long, docs long, tokens long, terms array<int>, df array<int>, ids array<{}>, "
          + ", ".join(f"{a} binary" for a in _ARRAYS))


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order, only A-Z lower-cased; none for None."""
    return _TERM.findall((text or "").encode().translate(bytes(_LOWER)))


def _hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every term of a chunk, and the first term of each text."""
    start, end, first = T.runs(_IN_TERM[data], off)
    return T.Rolling(_LOWER[data]).span(start, end), first


def _vocabulary(words: list[bytes]) -> np.ndarray:
    """Hash of each word, by the position in the list."""
    off = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=off[1:])
    return T.Rolling(np.frombuffer(b"".join(words), np.uint8)).span(off[:-1], off[1:])


# ---------------------------------------------------------------- index
def _narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers in one, two or four bytes each."""
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def _packed(a: np.ndarray) -> bytes:
    a = _narrow(a)
    return bytes([a.itemsize]) + a.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[raw[0]], offset=1)


def build_shard(term: np.ndarray, doc: np.ndarray, count: np.ndarray, length: np.ndarray) -> dict:
    """Posting lists of one shard from postings in any order: arrays by name."""
    order = np.lexsort((doc, term))
    term, doc, count = term[order], doc[order], count[order]
    found, list_start, df = np.unique(term, return_index=True, return_counts=True)
    inside = np.arange(len(doc)) - np.repeat(list_start, df)
    block_at = np.flatnonzero(inside % BLOCK == 0)
    gap = np.diff(doc, prepend=0)
    gap[list_start] = 0  # a list's first number stands in `first`
    block = np.repeat(np.arange(len(block_at)), np.diff(np.append(block_at, len(doc))))
    # least length for each count of a block
    by = np.lexsort((length[doc], count, block))
    b, c = block[by], count[by]
    edge = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (c[1:] != c[:-1]))[:len(b)])
    return {"terms": found, "df": df, "length": length, "first": doc[block_at], "gap": gap, "count": count,
            "block_at": np.append(block_at, len(doc)), "list_at": np.append(block[list_start], len(block_at)),
            "edge_at": np.append(np.searchsorted(b[edge], np.arange(len(block_at))), len(edge)),
            "edge_count": c[edge], "edge_length": length[doc][by][edge]}


def _index(vocabulary, id_type: pa.DataType):
    def run(batches):
        hashes, number = vocabulary.value
        shard = TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # ids, lengths, term, doc, count
        docs = size = 0

        def row():
            every = pa.concat_arrays([p[0].cast(id_type) for p in held])
            length, term, doc, count = (np.concatenate([p[i] for p in held]) for i in range(1, 5))
            order = pc.sort_indices(every, null_placement="at_end")  # documents of equal score go by their id
            rank = np.zeros(len(every), np.int64)
            rank[order.to_numpy()] = np.arange(len(every))
            every, length = every.take(order), length[order.to_numpy()]
            made = build_shard(term, rank[doc], count, length)
            cols = [pa.array([shard]), pa.array([int((length > 0).sum())]), pa.array([int(length.sum())])]
            for name in ("terms", "df"):
                cols.append(pa.array([made[name].astype(np.int32)], pa.list_(pa.int32())))
            cols.append(pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every))
            cols += [pa.array([_packed(made[a])], pa.binary()) for a in _ARRAYS]
            return pa.RecordBatch.from_arrays(cols, ["shard", "docs", "tokens", "terms", "df", "ids", *_ARRAYS])

        for chunk in T.chunks(batches):
            data, off = T.utf8(chunk.column("text"))
            h, first = _hashes(data, off)
            at = np.searchsorted(hashes, h)
            at[at == len(hashes)] = 0
            asked = hashes[at] == h
            key, count = np.unique(T.owner(first)[asked] * len(hashes) + number[at[asked]], return_counts=True)
            held.append((chunk.column("id"), np.diff(first), key % len(hashes), key // len(hashes) + docs, count))
            docs, size = docs + chunk.num_rows, size + len(data)
            if size >= SHARD_BYTES or docs >= SHARD_DOCS:
                yield row()
                held, docs, size, shard = [], 0, 0, shard + 1
        if held:
            yield row()
    return run


# ---------------------------------------------------------------- search
def impact(count: np.ndarray, length_part: np.ndarray) -> np.ndarray:
    """What a term's weight is multiplied by, from its count and a document's m."""
    return (1_000_000_000 * count) // (1000 * count + 20 * length_part)


def _length_part(length: np.ndarray, docs: int, tokens: int) -> np.ndarray:
    n = length.astype(np.int64)
    if 50 * int(n.max(initial=0)) * docs >= 1 << 63:
        return np.array([50 + 50 * x * docs // tokens for x in n.tolist()], np.int64)
    return 50 + (50 * n * docs) // tokens


class Shard:
    """One index row with the corpus statistics applied."""

    def __init__(self, row: dict, weight: np.ndarray, docs: int, tokens: int):
        self.terms = row["terms"]
        a = {k: _unpacked(row[k]).astype(np.int64) for k in _ARRAYS if k not in ("gap", "count")}
        self.gap, self.count = _unpacked(row["gap"]), _unpacked(row["count"])
        self.first, self.block_at, self.list_at = a["first"], a["block_at"], a["list_at"]
        self.m = _length_part(a["length"], docs, tokens)
        self.weight = weight[self.terms]
        self.size = len(self.m)
        self.skipped = 0  # blocks that a candidate was rejected for without decompression
        if len(self.terms):
            edge = impact(a["edge_count"], _length_part(a["edge_length"], docs, tokens))
            self.block_max = np.maximum.reduceat(edge, a["edge_at"][:-1]) * np.repeat(self.weight, np.diff(self.list_at))
            self.list_max = np.maximum.reduceat(self.block_max, self.list_at[:-1])

    def scores(self, i: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents, ascending, and their scores in some blocks of list i."""
        lo, size = self.block_at[blocks], self.block_at[blocks + 1] - self.block_at[blocks]
        at = np.cumsum(size) - size
        where = np.arange(int(size.sum())) + np.repeat(lo - at, size)
        gap = self.gap[where].astype(np.int64)
        gap[at] = 0
        run = np.cumsum(gap)
        doc = run + np.repeat(self.first[blocks] - run[at], size)
        return doc, self.weight[i] * impact(self.count[where].astype(np.int64), self.m[doc])

    def best(self, asked: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with their scores that may be among the k best for the
        terms `asked`; only scores of `least` or more count.  Documents of equal
        score go by their number."""
        lists = np.flatnonzero(np.isin(self.terms, asked))
        lists = lists[np.argsort(self.list_max[lists], kind="stable")] if len(lists) else lists
        together = np.cumsum(self.list_max[lists]) if len(lists) else np.zeros(0, np.int64)
        doc, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a in range(0, self.size if len(lists) else 0, WINDOW):
            b = min(self.size, a + WINDOW)
            essential = int(np.searchsorted(together, least, "left"))
            if essential == len(lists):
                break  # all lists together stay below
            total = np.zeros(b - a, np.int64)
            for i in lists[essential:].tolist():
                first = self.first[self.list_at[i]:self.list_at[i + 1]]
                lo, hi = max(0, int(np.searchsorted(first, a, "right")) - 1), int(np.searchsorted(first, b, "left"))
                if lo < hi:
                    d, s = self.scores(i, np.arange(lo, hi) + self.list_at[i])
                    here = slice(*np.searchsorted(d, (a, b)).tolist())
                    total[d[here] - a] += s[here]
            candidate = np.flatnonzero(total)
            sure = total[candidate]
            for j in range(essential - 1, -1, -1):
                left = sure + together[j] >= least
                candidate, sure = candidate[left], sure[left]
                if not len(candidate):
                    break
                i = int(lists[j])
                lo, hi = self.list_at[i], self.list_at[i + 1]
                block = lo + np.searchsorted(self.first[lo:hi], candidate + a, "right") - 1
                bound = np.where(block < lo, 0, self.block_max[np.maximum(block, lo)])
                left = sure + bound + (together[j - 1] if j else 0) >= least
                self.skipped += int((~left).sum())
                candidate, sure, block = candidate[left], sure[left], block[left]
                wanted = np.unique(block[block >= lo])
                if len(wanted):
                    d, s = self.scores(i, wanted)
                    at = np.minimum(np.searchsorted(d, candidate + a), len(d) - 1)
                    sure = sure + np.where(d[at] == candidate + a, s[at], 0)
            left = sure >= least
            doc, score = np.append(doc, candidate[left] + a), np.append(score, sure[left])
            if len(doc) > k:
                top = np.lexsort((doc, -score))[:k]
                doc, score = doc[top], score[top]
            if len(doc) == k:
                least = max(least, int(score.min()))
        left = score >= least
        return doc[left], score[left]


def _search(block, id_type: pa.DataType, item_type: pa.DataType, k: int):
    def run(batches):
        items, queries, weight, docs, tokens = block.value
        items = pa.array(items, item_type)
        found = [np.zeros(0, np.int64)] * len(queries)  # best scores so far in this task, ascending
        for batch in batches:
            for r in range(batch.num_rows):
                row = {a: batch.column(a)[r].as_py() for a in _ARRAYS}
                row["terms"] = batch.column("terms")[r].values.to_numpy(zero_copy_only=False)
                shard, out = Shard(row, weight, docs, tokens), []
                for q, asked in enumerate(queries):
                    doc, score = shard.best(asked, k, max(1, int(found[q][0])) if len(found[q]) == k else 1)
                    found[q] = np.sort(np.append(found[q], score))[-k:]
                    out.append((np.full(len(doc), q), doc, score))
                q, doc, score = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q, pa.int32()), items.take(pa.array(q)), batch.column("ids")[r].values.take(pa.array(doc)).cast(id_type),
                     pa.array(score, pa.int64())], ["query", "item", "doc", "score"])
    return run


def _blocks(queries: DataFrame):
    """Query rows as lists of (id, terms), QUERY_BYTES of text at a time."""
    block, size = [], 0
    for item, text in queries.toLocalIterator():
        block.append((item, terms(text)))
        size += len(text or "")
        if size >= QUERY_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search_block(d: DataFrame, block: list, base: str, schema: str, types: tuple, k: int) -> DataFrame | None:
    """Index for the terms of one block of queries, and its ranked documents."""
    spark = d.sparkSession
    words = sorted(set().union(*[said for _, said in block]))
    if not words:
        return None
    hashes = _vocabulary(words)
    order = np.argsort(hashes)
    shared = spark.sparkContext.broadcast((hashes[order], order))
    d.mapInArrow(_index(shared, types[0]), _INDEX.format(d.schema["id"].dataType.simpleString())).write.parquet(f"{base}/index")
    index = spark.read.parquet(f"{base}/index")
    docs, tokens = index.agg(F.sum("docs"), F.sum("tokens")).first()
    if not tokens:
        return None
    df = (index.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df"))
          .collect())  # a row per asked term
    weight = np.zeros(len(words), np.int64)
    for r in df:
        weight[r["terms"]] = math.floor(1000 * math.log((2 * docs + 2) / (2 * r["df"] + 1)))
    number = {w: i for i, w in enumerate(words)}
    asked = [np.array(sorted({number[w] for w in said}), np.int64) for _, said in block]
    task = spark.sparkContext.broadcast(([item for item, _ in block], asked, weight, docs, tokens))
    found = index.select("terms", "ids", *_ARRAYS).mapInArrow(_search(task, *types, k), schema)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ranked.select("item", "rank", "doc", "score").write.parquet(f"{base}/found")
    return spark.read.parquet(f"{base}/found")


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id",
           query_text: str = "text", k: int = BEST) -> DataFrame:
    """The `k` best documents of each query row: query id, rank (from 1), id,
    score (above 0), equal scores by ascending id, NULL ids last.

    NULL and empty texts have no terms: such documents are never found and
    count nowhere, such queries find nothing.  Repeated documents are found
    each, repeated query rows are answered each; no queries or no documents
    give no rows.  Very long texts are handled whole, as a chunk of their own.
    Other columns are left out.  Terms are matched by 64-bit hashes.  The index
    and each block's result are written under ``spark.checkpoint.dir``."""
    from pyspark.sql.pandas.types import to_arrow_type
    spark = docs.sparkSession
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    asked = queries.select(F.col(f"`{query_id}`").alias("item"), F.col(f"`{query_text}`").alias("text"))
    kinds = d.schema["id"].dataType, asked.schema["item"].dataType
    schema = f"query int, item {kinds[1].simpleString()}, doc {kinds[0].simpleString()}, score long"
    base, out = scratch_dir(spark, "search"), None
    for n, block in enumerate(_blocks(asked)):
        found = _search_block(d, block, f"{base}/{n}", schema, tuple(map(to_arrow_type, kinds)), k)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema).select("item", F.lit(0).alias("rank"), "doc", "score")
    return out.select(F.col("item").alias(query_id), "rank", F.col("doc").alias(id_col), "score")
