"""Shortest-pack-first packing over the length histogram.

Every document is cut into full sequences and a rest, the rests are counted by
length, and the histogram alone is packed: lengths from the longest to the
shortest go into the pack pattern with the least tokens that still has room,
a pattern being a multiset of lengths with the number of sequences that have it.
Then each piece finds its sequence by its rank among the pieces of its length.

Only the histogram reaches the driver: at most `size` counts, and a pattern
table with at most three new patterns per length, each with at most
sqrt(2 * size) different lengths.  Ranks come from per-task
counts, so no length is gathered into one task however many pieces have it.
"""
from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finlake.llm import text as T
from finlake.session import scratch_dir

SIZE = 1024
#: words whose ids a worker process remembers, half of them old ones (results do not depend on it)
CACHE_WORDS = 700_000


_WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"  # Python's \s
#: a space or line break inside of white space, neither the first nor the last of it, or at the end of a text
_ODD_SPACE = rf"[{_WHITE}][ \n](?:[{_WHITE}]|\z)"
#: before a space or line break that a visible character precedes or follows
_CUT = re.compile(r"(?<!\s)(?=[ \n])|(?=[ \n]\S)")
#: letters, then signs without an apostrophe (which may start a suffix of its own)
_WORD_SIGNS = re.compile(r"([^\W\d_]+)([^\w\s']+)")
_SPACE = re.compile(r"\s")
_JOINED = 4096  # words encoded at once


def _parts(text: str) -> list[str]:
    """What comes before the first cut, then the parts."""
    head, *parts = _CUT.split(text)
    return [head, *[p[1:] if p[0] == " " and p[1:2] not in (" ", "\n") else p for p in parts]]


class _Ids:
    """Token ids, little-endian 32-bit.  A text is cut before every
    single space or line break that a visible character precedes or follows; no
    token crosses such a place, so the ids of the parts, each encoded once, make up the
    text's.  Nor does one cross from a letter to a sign, so a new part with signs at its
    end is made of its pieces.  New pieces are encoded many at a time, told apart by the
    space or line break before each.  A part stands for itself if it starts with a line
    break or space, else for a space and itself.
    A text that holds the string of a special token is encoded as a whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}  # part -> ids
        self.old: dict[str, bytes] = {}  # what was known before: half of the memory
        self.signs: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0][0]
        size = max(vocabulary.values()) + 1
        self.spaced, self.broken = np.zeros(size, bool), np.zeros(size, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith(space)]] = True
        self.broken[self.tokenizer.encode("\n", add_special_tokens=False).ids] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, off = self.arrays(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(off, off[1:])]

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string column and the offsets of its rows in them."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False)
        whole = np.zeros(len(texts), bool)
        for x in self.special:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        slow = odd | whole
        lists = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~slow)), "\n", " \n"), " ")
        heads = {}
        if slow.any():
            rows = np.flatnonzero(slow)
            cut = [[x] if w else _parts(x) for x, w in zip(texts.take(pa.array(rows)).to_pylist(), whole[rows])]
            heads = {i: p[0] for i, p in zip(rows.tolist(), cut)}
            lists = pa.concat_arrays([lists, pa.array([["", *p[1:]] for p in cut], lists.type)])
            lists = lists.take(pa.array(np.argsort(np.argsort(slow, kind="stable"), kind="stable")))
        first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        words = lists.flatten()
        heads = [heads.get(i, x) for i, x in enumerate(words.take(pa.array(first[:-1])).to_pylist())]
        coded = words.dictionary_encode()
        at, words = coded.indices.to_numpy().copy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at[first[:-1]] = len(words) + np.arange(len(heads))
        self._remember(words)
        each = [*map(self.known.__getitem__, words), *self._each(heads)]
        n = np.fromiter(map(len, each), np.int64, len(each)) // 4
        start = np.cumsum(n) - n
        end = np.cumsum(n[at])
        place = np.repeat(start[at] - end + n[at], n[at])
        place += np.arange(len(place))
        return np.frombuffer(b"".join(each), "<u4")[place], np.append(0, end)[first]

    def _remember(self, words: list[str]) -> None:
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS // 2:
            self.old, self.known = self.known, {}
            new = set(words)
        again = [w for w in new if w in self.old]
        self.known.update(zip(again, map(self.old.__getitem__, again)))
        self._learn(new.difference(again))

    def _learn(self, words: set[str]) -> None:
        whole, letters, broken, signed = [], set(), set(), []
        for w in words:
            if w.isalpha():
                letters.add(w)
                continue
            line = w[:1] == "\n"
            v = w[1:] if line else w
            m = _WORD_SIGNS.fullmatch(v)
            if m and m[1].isalpha() and m[1][-1] < "\u0250":
                signed.append((w, "\n" + m[1] if line else m[1], m[2]))
                (broken if line else letters).add(m[1])
            elif line and v and not _SPACE.search(v):
                broken.add(v)
            else:
                whole.append(w)
        lines = ["\n" + w for w in self._joined("\n", [w for w in broken if "\n" + w not in self.known], self.broken, "\n")]
        whole += lines + self._joined(" ", [w for w in letters if w not in self.known], self.spaced)
        self.known.update(zip(whole, self._each([w if w[:1] in ("\n", " ") and w else " " + w for w in whole])))
        if len(self.signs) > CACHE_WORDS // 8:
            self.signs.clear()
        signs = list({c[2] for c in signed}.difference(self.signs))
        self.signs.update(zip(signs, self._each(signs)))
        for w, base, sign in signed:
            self.known[w] = self.known[base] + self.signs[sign]

    def _joined(self, before: str, words: list[str], marks: np.ndarray, key: str = "") -> list[str]:
        """Learn words many at a time, each after the character `before`, whose
        token marks where it starts; `key` starts their parts.  Returns those where that is not so."""
        rest = []
        for i in range(0, len(words), _JOINED):
            some = words[i:i + _JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([before + before.join(some)], add_special_tokens=False)[0].ids, "<u4")
            first = np.flatnonzero(marks[ids])
            if len(first) != len(some):
                rest += some
                continue
            raw, at = ids.tobytes(), (4 * np.append(first, len(ids))).tolist()
            self.known.update(zip((key + w for w in some) if key else some, (raw[a:b] for a, b in zip(at, at[1:]))))
        return rest

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _pieces(path: str, size: int, end_id: int):
    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids, part = T.held(f"ids {path}", lambda: _Ids(path)), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        end = np.array([end_id], "<u4").tobytes()
        for chunk in T.chunks(batches, uses=f"ids {path}"):
            doc, start, length, crc, total, rank = [], [], [], [], [], []
            coded, off = ids.arrays(chunk.column("text"))
            for i, (first, last) in enumerate(zip(off.tolist(), off[1:].tolist())):
                raw = coded[first:last].tobytes() + end
                n = len(raw) // 4
                for a in range(0, n, size):
                    m = min(size, n - a)
                    doc.append(i)
                    start.append(a)
                    length.append(m)
                    crc.append(zlib.crc32(raw[4 * a:4 * (a + m)]))
                    total.append(n)
                    rank.append(seen.get(m, 0))
                    seen[m] = rank[-1] + 1
            cols = [chunk.column("id").take(pa.array(doc, pa.int32()))]
            cols += [pa.array(x, pa.int64()) for x in (start, length, crc, total, rank, [part] * len(doc))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "start", "length", "ids_crc32", "doc_tokens", "rank", "part"])
    return run


def pack_histogram(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns as (number of sequences, ((length, times), ...)), the lengths
    of a pattern in the order in which they were placed."""
    full: list[tuple[int, tuple]] = []
    open_: dict[int, list[tuple[int, tuple]]] = {}  # used tokens -> patterns with room

    def put(used: int, n: int, pattern: tuple) -> None:
        if used == size:
            full.append((n, pattern))
        else:
            open_.setdefault(used, []).append((n, pattern))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            used = min((u for u, p in open_.items() if p and u + length <= size), default=None)
            if used is None:
                each = size // length  # a new pack is the shortest until it is full
                if left >= each:
                    put(each * length, left // each, ((length, each),))
                if left % each:
                    put(left % each * length, 1, ((length, left % each),))
                break
            # one piece into each of these packs, as many as there are
            n, pattern = open_[used].pop()
            taken = min(n, left)
            if n > taken:
                open_[used].append((n - taken, pattern))
            if pattern[-1][0] == length:
                pattern = pattern[:-1] + ((length, pattern[-1][1] + 1),)
            else:
                pattern += ((length, 1),)
            put(used + length, taken, pattern)
            left -= taken
    return full + [x for u in sorted(open_, reverse=True) for x in open_[u]]


def _slots(patterns):
    """For each length the ranges of ranks: arrays of (first rank, times,
    first sequence, offset in the sequence), sorted by first rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    next_rank: dict[int, int] = {}
    sequence = 0
    for n, pattern in patterns:
        at = 0
        for length, times in pattern:
            r = next_rank.get(length, 0)
            out.setdefault(length, []).append((r, times, sequence, at))
            next_rank[length] = r + n * times
            at += length * times
        sequence += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _place(slots):
    def run(batches):
        table = slots.value
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, at = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                here = np.flatnonzero(length == n)
                s = table[n]
                k = np.searchsorted(s[:, 0], rank[here], "right") - 1
                copy, slot = np.divmod(rank[here] - s[k, 0], s[k, 1])
                seq[here] = s[k, 2] + copy
                at[here] = s[k, 3] + slot * n
            names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(seq), pa.array(at)],
                                             [*names, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
         end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most
    `size` tokens: id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset.

    A document is its text's ids, then `end_id`; a NULL or empty text is
    `end_id` alone.  Repeated rows are packed one by one.  Other columns are
    left out.  No documents give no pieces.  The pieces (numbers only) are
    written once under ``spark.checkpoint.dir``, so ranks cannot change.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    names = ["start", "length", "ids_crc32", "doc_tokens", "rank", "part"]
    at = scratch_dir(spark, "pieces")
    d.mapInArrow(_pieces(tokenizer, size, end_id), f"id {kind}, " + ", ".join(f"{c} long" for c in names)).write.parquet(at)
    pieces = spark.read.parquet(at)

    by_task = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = by_task.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    slots = spark.sparkContext.broadcast(_slots(pack_histogram(counts, size)))
    ranked = (pieces.join(before, ["length", "part"])
              .select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).alias("rank")))
    out = ranked.mapInArrow(_place(slots), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
