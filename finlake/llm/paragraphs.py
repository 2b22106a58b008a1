"""Near-duplicate paragraphs across all documents, by MinHash banding.

A paragraph is a line with `min_words` words or more; its set is its five-word
shingles.  Paragraphs with equal sets are one node.  A node's signature has
`bands * rows` minimum hashes; nodes that agree in all rows of a band collide.
With 16 bands of 4 rows a pair of similarity 0.8 collides with probability
0.9998.  Colliding nodes whose group counts allow a link (the helpers of the
n-gram join are used) are joined into clusters, inside which every pair is decided on
the exact Jaccard similarity, and the links' components are the classes.  Of a class the paragraph of the smallest document id, then of the
smallest number, stays.

Passages do not depend on line breaks.  Of each window of `window` words the place
with the smallest hash of three words is an anchor, and the `words` words from an
anchor on, wherever lines end, are a unit; units of equal words are a class.  A run
of ``window + words - 1`` words (50) that occurs twice has an equal window, so an equal
anchor and unit, in both places; near copies share the units between their edits.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlake.llm import bloom
from finlake.llm import text as T
from finlake.llm.components import components
from finlake.llm.ngram_join import SET_ROWS, WIDE, WIDE_ROWS, _sum, binary, points_of, set_rows, verified_links
from finlake.session import scratch_dir

SHINGLE, PERCENT = 5, 80
MIN_WORDS = 10
BANDS, ROWS = 16, 4
DIMENSIONS = 32
PASSAGE_WORDS, WINDOW, ANCHOR = 26, 25, 3
CHUNK_BYTES, KEY_BLOCK = 1 << 20, 1 << 14  # texts and shingles at once


def _firsts(own: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which items are the first of their value within their owner."""
    keep = np.ones(len(value), bool)
    bits = np.uint64(len(value).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    # hashes with their places in the low bits: sorting values is many times faster than sorting by two keys
    x = np.sort((value + own.astype(np.uint64) * np.uint64(T._BASE)) & ~low | np.arange(len(value), dtype=np.uint64))
    near = np.flatnonzero((x[1:] ^ x[:-1]) <= low)
    a, b = (x[near] & low).astype(np.int64), (x[near + 1] & low).astype(np.int64)
    if ((own[a] == own[b]) & (value[a] == value[b])).all():
        keep[b] = False
    else:  # different items that agree in the high bits may part equal ones
        order = np.lexsort((value, own))
        keep[order[1:]] = (own[order[1:]] != own[order[:-1]]) | (value[order[1:]] != value[order[:-1]])
    return keep


class _Paragraphs:
    """Paragraphs of the texts of one chunk: text, first and last byte, number of words,
    hash of the whole line, distinct shingles, and node.  With `wanted`, a bit filter of
    lines, other lines are left out before their words are looked for."""

    def __init__(self, column: pa.Array, k: int, min_words: int, wanted: np.ndarray | None = None):
        self.data, self.off = data, off = T.utf8(column)
        rolling = T.Rolling(data, table=T.LOWER)
        ls, le, first = T.runs(data != 10, off)
        doc, line = T.owner(first), rolling.span(ls, le)
        if wanted is None:
            s, e, _ = T.runs(~T.SPACE[data], off)
            wa, wb = np.searchsorted(s, ls), np.searchsorted(s, le)
        else:
            pick = np.flatnonzero(bloom.contains(wanted, line.view(np.int64)))
            doc, line, ls, le = doc[pick], line[pick], ls[pick], le[pick]
            part = np.concatenate([[0], np.cumsum(le - ls)])
            at = np.repeat(ls - part[:-1], le - ls) + np.arange(part[-1])
            s, e, first = T.runs(~T.SPACE[data[at]], part)
            s, e, wa, wb = at[s], at[e - 1] + 1, first[:-1], first[1:]
        long = np.flatnonzero(wb - wa >= max(1, min_words))
        self.doc, self.line, self.ls, self.le, wa, wb = doc[long], line[long], ls[long], le[long], wa[long], wb[long]
        self.words = wb - wa
        h = rolling.span(s, e)
        # a paragraph of fewer words than a shingle is one shingle
        n = np.maximum(self.words - k + 1, 1)
        own = np.repeat(np.arange(len(n)), n)
        at = np.repeat(wa - (np.cumsum(n) - n), n) + np.arange(n.sum())
        if (self.words >= k).all():
            size = max(0, len(h) - k + 1)
            value = np.zeros(size, np.uint64)
            for j in range(k):
                value = T.mix(value * np.uint64(T._BASE_2) + h[j:j + size])
            value = value[at]
        else:
            value = np.zeros(len(at), np.uint64)
            for j in range(k):
                inside = at + j < wb[own]
                value[inside] = T.mix(value[inside] * np.uint64(T._BASE_2) + h[at[inside] + j])
        keep = _firsts(own, value)
        self.tokens = value[keep]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(own[keep], minlength=len(n)))]).astype(np.int64)
        self.node = T.mix(_sum(T.mix(self.tokens ^ np.uint64(0x5A5A5A5A5A5A5A5A)), self.first) + np.diff(self.first).astype(np.uint64))

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the line in its text, and start and end in code points."""
        begin = self.off[self.doc]
        newline = np.flatnonzero(self.data == 10)
        code = np.zeros(len(self.data) + 1, np.int32)
        np.cumsum((self.data & 0xC0) != 0x80, out=code[1:])
        return np.searchsorted(newline, self.ls) - np.searchsorted(newline, begin), code[self.ls] - code[begin], code[self.le] - code[begin]


def _new(node: np.ndarray, seen: set[int]) -> np.ndarray:
    """First places of the nodes that are not yet among those seen."""
    _, at = np.unique(node, return_index=True)
    at = np.array([i for i in np.sort(at).tolist() if int(node[i]) not in seen], np.int64)
    seen.update(node[at].tolist())
    return at


def _band_keys(tokens: np.ndarray, first: np.ndarray, rows_of: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys of the given sets, a column each."""
    seeds = T.mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(T._BASE))
    odd = T.mix(seeds) | np.uint64(1)
    least = np.zeros((bands * rows, len(rows_of)), np.uint64)
    n = np.diff(first)[rows_of]
    total, lo = np.cumsum(n), 0
    while lo < len(rows_of):  # so many sets that their shingles stay in the processor's cache
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] - n[lo] + KEY_BLOCK, "right")))
        starts = np.cumsum(n[lo:hi]) - n[lo:hi]
        block = tokens[np.repeat(first[rows_of[lo:hi]] - starts, n[lo:hi]) + np.arange(n[lo:hi].sum())]
        x, y = np.empty_like(block), np.empty_like(block)
        for i in range(bands * rows):
            # one multiplication by an odd number and a mix of the high bits
            np.bitwise_xor(block, seeds[i], out=x)
            np.multiply(x, odd[i], out=x)
            np.right_shift(x, np.uint64(29), out=y)
            np.bitwise_xor(x, y, out=x)
            least[i, lo:hi] = np.minimum.reduceat(x, starts)
        lo = hi
    keys = np.repeat(np.arange(bands, dtype=np.uint64)[:, None], len(rows_of), 1)
    for r in range(rows):
        keys = T.mix(keys + least[r::rows])
    return keys


def _nodes(k: int, min_words: int, bands: int, rows: int):
    """Paragraphs with their band keys; copies of a task's earlier nodes need no keys."""
    def run(batches):
        seen: set[int] = set()
        for chunk in T.chunks(batches, size=CHUNK_BYTES):
            p = _Paragraphs(chunk.column("text"), k, min_words)
            new = _new(p.node, seen)
            keys = _band_keys(p.tokens, p.first, new, bands, rows)
            held, off = np.zeros(len(p.node), np.int64), np.zeros(len(p.node) + 1, np.int32)
            held[new] = bands
            np.cumsum(held, out=off[1:])
            yield pa.RecordBatch.from_arrays(
                [chunk.column("id").take(pa.array(p.doc)), *[pa.array(x.astype(np.int64)) for x in (*p.places(), p.words)],
                 pa.array(p.node.view(np.int64)), pa.array(np.diff(p.first)), binary(points_of(p.tokens, p.first, DIMENSIONS)),
                 pa.array(p.line.view(np.int64)), T.lists(pa.array(keys.T.ravel().view(np.int64)), off)],
                ["id", "paragraph", "start", "end", "n_words", "node", "n", "point", "line", "keys"])
    return run


def _lines(wanted):
    """Lines of the wanted nodes."""
    def run(batches):
        for b in batches:
            pick = bloom.contains(wanted.value, b.column("node").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("line").filter(pa.array(pick))], ["line"])
    return run


def _sets(k: int, min_words: int, wanted, lines):
    """Sets of the wanted nodes, from the wanted lines."""
    def run(batches):
        seen: set[int] = set()
        for chunk in T.chunks(batches, size=CHUNK_BYTES):
            p = _Paragraphs(chunk.column("text"), k, min_words, lines.value)
            pick = np.flatnonzero(bloom.contains(wanted.value, p.node.view(np.int64)))
            pick = pick[_new(p.node[pick], seen)]
            yield set_rows(p.node.view(np.int64), p.tokens, p.first, pick, False)
    return run


def _widened(batches):
    """Wide points of stored sets."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            b = batch.slice(at, 256)
            sets = b.column("tokens").to_pylist()
            first = np.concatenate([[0], np.cumsum([len(x) // 8 for x in sets])]).astype(np.int64)
            point = points_of(np.frombuffer(b"".join(sets), np.uint64), first, WIDE)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(np.diff(first)), binary(point)], ["node", "n", "point"])


def duplicate_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                         percent: int = PERCENT, min_words: int = MIN_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per paragraph that has a near-duplicate: id, paragraph (number of
    its line), start, end (code points, end exclusive), n_words, kept_id and
    kept_paragraph (the one of its class that stays), removed.

    Documents without such a paragraph have no row.  NULL and empty texts have
    no paragraphs.  Repeated rows and repeated lines of one text are
    duplicates; of wholly equal rows none is told apart, so all have the same
    `removed`.  NULL ids sort last and stay only among themselves.  Other
    columns are left out.
    """
    spark = docs.sparkSession
    base = scratch_dir(spark, "paragraphs")
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    kind = d.schema["id"].dataType.simpleString()
    d.mapInArrow(_nodes(shingle, min_words, bands, rows), f"id {kind}, paragraph long, start long, end long, n_words long, node long, n long, "
                 "point binary, line long, keys array<long>").write.parquet(f"{base}/nodes")
    table = spark.read.parquet(f"{base}/nodes")
    keyed = table.select("node", F.explode("keys").alias("key"))

    def fetch(wanted, wide):
        if not wide:  # those written for the wide points; the caller joins what it wants
            return spark.read.parquet(f"{base}/sets")
        lines = table.select("node", "line").mapInArrow(_lines(wanted), "line long").distinct()
        lines = spark.sparkContext.broadcast(bloom.build(lines, "line"))
        d.select("text").mapInArrow(_sets(shingle, min_words, wanted, lines), SET_ROWS).write.parquet(f"{base}/sets")
        return spark.read.parquet(f"{base}/sets").mapInArrow(_widened, WIDE_ROWS)

    roots = components(verified_links(keyed, table.select("node", "n", "point"), fetch, percent, base))
    # per node first, so copies are counted before anything is joined
    place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("paragraph"))
    table = table.drop("n", "point", "line", "keys")
    nodes = table.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one"))
    nodes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = nodes.groupBy("root").agg(F.sum("n").alias("n"), F.min("one").alias("one")).where("n > 1")
    kept = nodes.select("node", "root").join(classes, "root").select("node", "one")
    out = table.join(kept, "node")
    stays = F.col("id").eqNullSafe(F.col("one.id")) & (F.col("paragraph") == F.col("one.paragraph"))
    return out.select(F.col("id").alias(id_col), "paragraph", "start", "end", "n_words", F.col("one.id").alias("kept_id"),
                      F.col("one.paragraph").alias("kept_paragraph"), (~stays).alias("removed"))


def _anchors(h: np.ndarray, first: np.ndarray, words: int, window: int) -> np.ndarray:
    """Places of words that are the (leftmost) least of a window, from which
    `words` words are left in the text."""
    value = T.grams(h, ANCHOR)
    end = np.repeat(first[1:], np.diff(first))
    start = np.flatnonzero(np.arange(len(h)) + window + words - 1 <= end)
    best, size = np.arange(len(value)), 1
    while size < window:
        step = min(size, window - size)
        a, b = best[:-step], best[step:]
        best = np.where(value[b] < value[a], b, a)
        size += step
    return np.unique(best[start])


def _passages(words: int, window: int):
    def run(batches):
        for chunk in T.chunks(batches, size=CHUNK_BYTES):
            data, off = T.utf8(chunk.column("text"))
            s, e, first = T.runs(~T.SPACE[data], off)
            h = T.Rolling(data, table=T.LOWER).span(s, e)
            at = _anchors(h, first, words, window) if len(h) >= words + window - 1 else np.zeros(0, np.int64)
            doc = T.owner(first)[at]
            code = np.zeros(len(data) + 1, np.int32)
            np.cumsum((data & 0xC0) != 0x80, out=code[1:])
            node = np.zeros(len(at), np.uint64)
            for j in range(words):
                node = T.mix(node * np.uint64(T._BASE_2) + h[at + j])
            begin, end = code[s[at]] - code[off[doc]], code[e[at + words - 1]] - code[off[doc]]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("id").take(pa.array(doc)), *[pa.array(x.astype(np.int64)) for x in (at - first[doc], begin, end, np.full(len(at), words))],
                 pa.array(node.view(np.int64))], ["id", "paragraph", "start", "end", "n_words", "node"])
    return run


def duplicate_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = PASSAGE_WORDS,
                       window: int = WINDOW) -> DataFrame:
    """One row per unit of `words` words that occurs again, in any line layout
    and ASCII case; columns as in ``duplicate_paragraphs``, `paragraph` being the number
    of the unit's first word in its text.  Units overlap.  Of a longer repeated run up to
    ``window - 1`` words at either end may lie outside of its units.

    NULL, empty and short texts have no units; very long ones are handled
    whole.  Repeated rows repeat each other; NULL ids sort last; of equal units
    the one with the smallest id and place stays.  No documents give no rows.
    Other columns are left out."""
    if window < 1 or words < ANCHOR:
        raise ValueError(f"needs a window and at least {ANCHOR} words")
    spark = docs.sparkSession
    base = scratch_dir(spark, "passages")
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    kind = d.schema["id"].dataType.simpleString()
    d.mapInArrow(_passages(words, window), f"id {kind}, paragraph long, start long, end long, n_words long, node long").write.parquet(f"{base}/units")
    table = spark.read.parquet(f"{base}/units")
    place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("paragraph"))
    classes = table.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one")).where("n > 1")
    stays = F.col("id").eqNullSafe(F.col("one.id")) & (F.col("paragraph") == F.col("one.paragraph"))
    return table.join(classes, "node").select(
        F.col("id").alias(id_col), "paragraph", "start", "end", "n_words", F.col("one.id").alias("kept_id"),
        F.col("one.paragraph").alias("kept_paragraph"), (~stays).alias("removed"))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, all columns kept, with the removed paragraphs cut from
    their texts (a paragraph's line break goes with it).  Passages within
    lines are only reported, by ``duplicate_passages``.

    NULL and empty texts stay as they are, repeated rows stay rows, no
    documents give none, columns may have any name, and of paragraphs that tie
    the one with the smallest id and line stays.  Rows of one id share their
    removed lines' numbers."""
    mark = "_" * (1 + max(map(len, docs.columns)))  # names no column has
    gone = (duplicate_paragraphs(docs, id_col, text_col, **options).where("removed")
            .groupBy(F.col(id_col).alias(f"{mark}id")).agg(F.collect_set("paragraph").alias(mark)))
    text = F.col(f"`{text_col}`")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(mark, i.cast("long"))), "\n")
    joined = docs.join(gone, docs[f"`{id_col}`"].eqNullSafe(gone[f"{mark}id"]), "left")
    return joined.select(*[F.when(F.col(mark).isNull(), text).otherwise(left).alias(c) if c == text_col else F.col(f"`{c}`")
                           for c in docs.columns])
