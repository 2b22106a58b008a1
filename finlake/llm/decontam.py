"""Benchmark decontamination by winnowing.

Fingerprints: the smallest k-gram hash of every `window - k + 1` consecutive
k-grams of words.  Two texts that share `window` words share a fingerprint, so
the join of fingerprints loses no shared span of that length.  Each hit is
extended: the words around it are compared with the benchmark window, one by
one, and the words of every window that really occurs are marked.

The benchmark is a stated query set against all documents, taken in blocks of
bounded size: each block's fingerprint table is broadcast (its bytes are
bounded by `block_bytes`) and one Arrow stage per block adds its hits to the
row that passes through, so documents are never shuffled, whatever the number
of documents that share a passage.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlake.llm import text as T

WINDOW = 10       # words of an item that make one window
GRAM = 5          # words of a fingerprint
BLOCK_BYTES = 16 << 20

_WORD = T.byte_table(r"[0-9a-z]")
_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a column and the first word of each text."""
    data, off = T.utf8(column)
    data = _LOWER[data]
    s, e, first = T.runs(_WORD[data], off)
    return T.Rolling(data).span(s, e), first


def _winnow(h: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints: in each window of words the
    rightmost smallest k-gram."""
    g = T.grams(h, k)
    length = np.repeat(np.diff(first), np.diff(first))
    inside = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first)) + window <= length
    at = np.flatnonzero(inside)
    if not len(at):
        return at, g[:0]
    best, place = g[at], at.copy()
    for j in range(1, window - k + 1):
        other = g[at + j]
        less = other <= best
        best = np.where(less, other, best)
        place[less] = at[less] + j
    keep = np.ones(len(place), bool)
    keep[1:] = place[1:] != place[:-1]
    return place[keep], best[keep]


def _table(keys: np.ndarray) -> np.ndarray:
    """Bit per leading 20 bits of the keys: most misses end here."""
    t = np.zeros(1 << 20, bool)
    t[(keys >> np.uint64(44)).astype(np.int64)] = True
    return t


class _Block:
    """One block of the benchmark: its windows by length, each with the items
    that contain it, and the fingerprints of the full windows."""

    def __init__(self, ids: list, texts: list, window: int, k: int):
        self.window, self.k, self.ids = window, k, ids
        self.h, first = _words(pa.array(texts, pa.string()))
        _, prints = _winnow(self.h, first, window, k)
        self.prints = np.unique(prints)
        self.print_table = _table(self.prints)
        found: dict[int, list[tuple[int, int]]] = {}
        for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
            if b > a:
                m = min(window, int(b - a))
                found.setdefault(m, []).extend((i, p) for p in range(a, b - m + 1))
        self.by_length = {}
        for m, places in found.items():
            item, at = np.array(places).T
            g = T.grams(self.h, m)[at]
            order = np.lexsort((item, g))
            g, item, at = g[order], item[order], at[order]
            key, start = np.unique(g, return_index=True)
            self.by_length[m] = key, np.append(start, len(g)), item, at[start], _table(key)

    def _occur(self, h, m, at, g):
        """Of the places `at` with m-gram hashes g: those where a window of
        length m stands, word by word, and the window's number."""
        key, _, _, example, table = self.by_length[m]
        near = table[(g >> np.uint64(44)).astype(np.int64)]
        at, g = at[near], g[near]
        w = np.minimum(np.searchsorted(key, g), len(key) - 1)
        same = key[w] == g
        at, w = at[same], w[same]
        same = np.ones(len(at), bool)
        for j in range(m):
            same &= h[at + j] == self.h[example[w] + j]
        return at[same], w[same]

    def hits(self, h: np.ndarray, first: np.ndarray):
        """Marked words, and (text, item) pairs of this block."""
        doc = T.owner(first)
        end = np.repeat(first[1:], np.diff(first))
        change = np.zeros(len(h) + 1, np.int64)
        pairs = []
        for m in self.by_length:
            if m == self.window:
                place, g = _winnow(h, first, self.window, self.k)
                near = self.print_table[(g >> np.uint64(44)).astype(np.int64)]
                place, g = place[near], g[near]
                place = place[np.isin(g, self.prints)]
                at = np.unique(place[:, None] - np.arange(self.window - self.k + 1))
                at = at[at >= 0]
                at = at[at + m <= end[at]] if len(at) else at
                g = np.zeros(len(at), np.uint64)
                for j in range(m):
                    g = g * np.uint64(T._BASE_2) + h[at + j]
                g = T.mix(g)
            else:
                at = np.flatnonzero(np.arange(len(h)) + m <= end)
                g = T.grams(h, m)[at]
            if not len(at):
                continue
            at, w = self._occur(h, m, at, g)
            change[at] += 1
            np.subtract.at(change, at + m, 1)
            _, start, item, _, _ = self.by_length[m]
            for d, x in np.unique(np.stack([doc[at], w], 1), axis=0):
                pairs.extend((int(d), int(i)) for i in item[start[x]:start[x + 1]])
        return np.cumsum(change[:-1]) > 0, sorted(set(pairs))


def _stage(block):
    def run(batches):
        b = block.value
        for chunk in T.chunks(batches):
            h, first = _words(chunk.column("text"))
            marked, pairs = b.hits(h, first)
            old = chunk.column("spans").to_pylist()
            spans, items = [], chunk.column("items").to_pylist()
            s, e, at = T.runs(marked, first)
            own = np.repeat(first[:-1], np.diff(at))
            s, e = s - own, e - own
            for i in range(chunk.num_rows):
                new = list(zip(s[at[i]:at[i + 1]].tolist(), e[at[i]:at[i + 1]].tolist()))
                spans.append(_union([(x["start"], x["end"]) for x in old[i]] + new) if old[i] else new)
            for d, i in pairs:
                items[d].append(b.ids[i])
            cols = [chunk.column("id"), chunk.column("text"), pa.array(np.diff(first), pa.int64()),
                    pa.array([[{"start": x, "end": y} for x, y in r] for r in spans],
                             pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "text", "n_words", "spans", "items"])
    return run


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                       gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, text, n_words, spans (array of word ranges
    ``start``, ``end`` covered by occurring windows, end exclusive, disjoint and
    sorted) and items (ids, as strings, of the items with an occurring window,
    sorted).

    A NULL text or an empty one has no words and no hits; NULL, empty and
    wordless items have no windows; an item with a NULL id counts as ``""``.
    Repeated rows are judged one by one, repeated items count by their id.
    Other columns are left out, so their names do not matter.  An empty
    benchmark hits nothing.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"),
                             F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).distinct()
    size = bench.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"),
                      F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"),
                      F.expr("cast(array() as array<string>)").alias("items"))
    schema = out.schema
    for k in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k) if blocks > 1 else bench
        rows = part.orderBy("id", "text").collect()  # about block_bytes of items
        block = spark.sparkContext.broadcast(_Block([r[0] for r in rows], [r[1] for r in rows], window, gram))
        out = out.mapInArrow(_stage(block), schema)
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_words", "spans",
                      F.array_sort(F.array_distinct("items")).alias("items"))
