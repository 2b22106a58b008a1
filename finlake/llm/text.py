"""Array helpers for Arrow tasks: texts as one UTF-8 byte array per chunk.

Tasks see whole texts.  A chunk is a slice of a record batch of a few MB (one
very long text makes a chunk of its own), so memory follows the longest text
and not the number of rows.  NULL texts count as empty ones.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_2 = 0xD1B54A32D192ED03 | 1


_HELD: dict[str, object] = {}


def held(key: str, make: Callable[[], object]):
    """What `make` gives, kept in this worker process for its next tasks until
    one that does not use `key` goes through `chunks`: one thing at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text",
           size: int = CHUNK_BYTES, uses: str | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `size` bytes of text each; `uses` is the
    key of what the task has `held`."""
    if uses not in _HELD:
        _HELD.clear()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        length = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        lo, done = 0, 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(length, done + size, "right")))
            yield batch.slice(lo, hi - lo)
            lo, done = hi, int(length[hi - 1])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows in them."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0]:off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def byte_table(pattern: str) -> np.ndarray:
    """Which of the 256 byte values a character class of ASCII characters has."""
    import re
    out = np.zeros(256, bool)
    for i in range(128):
        out[i] = re.fullmatch(pattern, chr(i)) is not None
    return out


SPACE = byte_table(r"[\x20\x09-\x0D]")


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of set bytes that stay within one
    text, and for each text the index of its first run (one more at the end)."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    first = np.zeros(n + 1, bool)
    first[off] = True
    start = mask.copy()
    start[1:] &= ~mask[:-1] | first[1:n]
    end = mask.copy()
    end[:-1] &= ~mask[1:] | first[1:n]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Polynomial hashes (mod 2^64) of any span of a byte array, from prefix
    sums; equal spans have equal values wherever they stand."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int = _BASE, table: np.ndarray | None = None):
        n = len(data)
        power, inverse = self._powers.get(base, (np.ones(1, np.uint64),) * 2)
        if len(power) <= n:
            m = max(n + 1, CHUNK_BYTES + (CHUNK_BYTES >> 3))
            step = np.full(m, base, np.uint64)
            step[0] = 1
            power = np.cumprod(step, dtype=np.uint64)
            step[1:] = pow(base, -1, 1 << 64)
            inverse = np.cumprod(step, dtype=np.uint64)
            if m <= 4 * CHUNK_BYTES:
                self._powers[base] = power, inverse
        self.prefix = np.zeros(n + 1, np.uint64)
        # bytes are spread over 64 bits first: near texts differ in every bit
        x = (_SPREAD if table is None else table)[data]
        x *= power[:n]
        np.cumsum(x, out=self.prefix[1:])
        self.inverse = inverse

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
        return mix(h ^ (end - start).astype(np.uint64) * np.uint64(_BASE_2))


_SPREAD = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
#: table for ``Rolling``: hashes of the bytes with A-Z lower-cased
LOWER = _SPREAD.copy()
LOWER[65:91] = _SPREAD[97:123]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes (the last k - 1 places are not
    there); texts must be kept apart by the caller."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE_2) + h[j:j + n]
    return mix(out)


def per_row(counted: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of a per-item array over each text's items."""
    total = np.zeros(len(counted) + 1, np.int64)
    np.cumsum(counted, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def owner(first: np.ndarray) -> np.ndarray:
    """Index of the text each item belongs to, from the first item per text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def lists(values: pa.Array, off: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), values)


def rows_beside_text(docs: DataFrame, text_col: str) -> DataFrame:
    """The documents as two columns: id, a struct of all other columns, and text."""
    none = F.lit(0).alias("_" * (1 + max(map(len, docs.columns))))  # a struct needs a field
    return docs.select(F.struct(none, *[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("id"),
                       F.col(f"`{text_col}`").alias("text"))


def unpacked(rows: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    return rows.select(*[F.col("text").alias(c) if c == text_col else F.col(f"id.`{c}`").alias(c) for c in columns])
