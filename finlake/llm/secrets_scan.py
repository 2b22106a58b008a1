"""Secret scan: fixed patterns, and windows of high entropy.

Patterns (kinds assign, access, hex) are found leftmost and non-overlapping.
The entropy kind looks at every maximal run of token characters
``[A-Za-z0-9+/_.=-]``: a window of `width` characters slides over it and belongs
to the character class hex, alphanumeric or base64, the narrowest that holds all
the window's characters, so what stands before or after a secret does not
change its class.  The window's Shannon entropy comes from character counts that
change by one character in and one out per step; windows at or above their
class's threshold are joined into spans.  Allow-listed spans (no digit, no
letter, paths and file names, dates and versions, UUIDs) are suppressed.

Every text is read whole.  The cheap byte tests below only decide which texts
can have a match of a kind at all.
"""
from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlake.llm import text as T

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18

WIDTH = 24
#: bits per character a window must reach, by character class
THRESHOLDS = {"hex": 3.0, "alnum": 3.9, "base64": 4.0}
ALLOWED = [re.compile(p) for p in (
    r"[^0-9]*", r"[^A-Za-z]*",                                          # no digit, or no letter
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUID
    r"(?:[A-Za-z]+|[0-9]{1,4})(?:[./_=-]+(?:[A-Za-z]+|[0-9]{1,4}))*[./_=-]*",           # paths, dates, versions
)]

_TOKEN = T.byte_table(r"[A-Za-z0-9+/_.=-]")
_KINDS = ["assign", "access", "hex", "entropy"]
_LOG = [0.0] + [i * math.log2(i) for i in range(1, 4097)]


def _class(s: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return "hex"
    return "alnum" if s.isalnum() else "base64"


#: by character, whether it is outside of lower-case hex, upper-case hex, and alphanumeric
_OUTSIDE = {c: (c not in "0123456789abcdef", c not in "0123456789ABCDEF", not c.isalnum()) for c in map(chr, range(128))}


def entropy_spans(run: str, width: int = WIDTH, thresholds: dict[str, float] = THRESHOLDS) -> list[tuple[int, int]]:
    """Joined windows of one run of token characters whose entropy reaches the
    threshold of the window's class (`_class`)."""
    # H = log2(w) - sum(c log2 c) / w, so a sum of c log2 c of at most this
    hexed, alnum, base64 = (width * (math.log2(width) - thresholds[c]) + 1e-9 for c in ("hex", "alnum", "base64"))
    # last places of characters outside of the classes
    lower = upper = other = -1
    count: dict[str, int] = {}
    total, out = 0.0, []
    if run.isalpha():  # on the allow list, as any part of it
        return out
    for i, c in enumerate(run):
        n = count.get(c, 0)
        total += _LOG[n + 1] - _LOG[n]
        count[c] = n + 1
        not_lower, not_upper, not_alnum = _OUTSIDE[c]
        if not_lower:
            lower = i
        if not_upper:
            upper = i
        if not_alnum:
            other = i
        if i >= width:
            c = run[i - width]
            n = count[c]
            total += _LOG[n - 1] - _LOG[n]
            count[c] = n - 1
        s = i - width + 1
        if s >= 0 and total <= (hexed if lower < s or upper < s else alnum if other < s else base64):
            if out and s <= out[-1][1]:
                out[-1] = out[-1][0], i + 1
            else:
                out.append((s, i + 1))
    return [(s, e) for s, e in out if not any(p.fullmatch(run[s:e]) for p in ALLOWED)]


def _assign_spans(text: str) -> list[tuple[int, int, int]]:
    return [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]


def _run_spans(run: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 1, m.end()) for m in ACCESS.finditer(run) if m.end() - m.start() >= MIN_ACCESS]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(run)]


def _scan(width: int, thresholds: dict[str, float]):
    def run(batches):
        for chunk in T.chunks(batches):
            data, off = T.utf8(chunk.column("text"))
            spans: dict[int, list[tuple[int, int, int]]] = {}
            s, e, first = T.runs(_TOKEN[data], off)
            wide = np.flatnonzero(e - s >= min(16, width))
            doc = T.owner(first)
            raw = data.tobytes()
            code = None
            # an assignment has one of these signs
            for i in np.flatnonzero(T.per_row((data == 58) | (data == 61), off)).tolist():
                spans[i] = _assign_spans(raw[off[i]:off[i + 1]].decode("utf-8", "replace"))
            # matches of the other kinds lie inside one token run
            for r in wide.tolist():
                i, at, run_text = int(doc[r]), int(s[r]), raw[s[r]:e[r]].decode()
                found = _run_spans(run_text)
                if len(run_text) >= width:
                    found += [(x, 3, y) for x, y in entropy_spans(run_text, width, thresholds)]
                if found:
                    if code is None:  # code points before each byte
                        code = np.zeros(len(data) + 1, np.int64)
                        np.cumsum((data & 0xC0) != 0x80, out=code[1:])
                    c = int(code[at] - code[off[i]])
                    spans.setdefault(i, []).extend((c + x, k, c + y) for x, k, y in found)
            rows = [[{"kind": _KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans.get(i, ()))]
                    for i in range(chunk.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [chunk.column(c) for c in chunk.schema.names]
                + [pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                                      ("end", pa.int64())])))],
                [*chunk.schema.names, "spans"])
    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                 thresholds: dict[str, float] | None = None) -> DataFrame:
    """One row per document: id, text and spans, an array of (kind, start, end)
    in code points, end exclusive, sorted by start, then kind in the order
    assign, access, hex, entropy.

    NULL and empty texts have no spans.  Repeated rows are scanned one by one.
    Other columns are left out.  The rows never leave their partition.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {d.schema['id'].dataType.simpleString()}, text string, spans array<struct<kind:string,start:bigint,end:bigint>>"
    out = d.mapInArrow(_scan(width, dict(thresholds or THRESHOLDS)), schema)
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "spans")


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", width: int = WIDTH,
           thresholds: dict[str, float] | None = None) -> DataFrame:
    """The documents, all columns kept, with every span of a secret replaced
    by `mask`; overlapping spans become one.  Texts are scanned and masked in
    one Python worker: each that a task starts stays, with all its memory."""
    scan = _scan(width, dict(thresholds or THRESHOLDS))

    def run(batches):
        for batch in scan(batches):
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                out, at = [], 0
                for x in spans:
                    if x["end"] > at:
                        if x["start"] >= at or not out:
                            out += [texts[i][at:x["start"]], mask]
                        at = x["end"]
                if out:
                    texts[i] = "".join(out) + texts[i][at:]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    d = T.rows_beside_text(docs, text_col)
    schema = f"id {d.schema['id'].dataType.simpleString()}, text string"
    return T.unpacked(d.mapInArrow(run, schema), docs.columns, text_col)
