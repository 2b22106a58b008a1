"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad.  A line's features are measured on its own bytes and
words (size, symbols, capitals, digits, repeated words, repeated lines, end
punctuation), and the two neighbouring lines' features count as well;
transitions are learned.  Training takes every line of a labelled document
to have the document's label.  A document's quality is the mean of its lines'
forward-backward probabilities of "good", weighted by length.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlake.llm import crf
from finlake.llm import text as T

#: labelled documents that the model is fitted on, at most: those with the smallest hash of their id
SAMPLE = 3000
STEPS = 150
CUT = 0.7

_UPPER, _LOWER, _DIGIT = (T.byte_table(p) for p in (r"[A-Z]", r"[a-z]", r"[0-9]"))
_SYMBOL, _PUNCT, _STOP = T.byte_table(r"[#*$%&|<>{}\\^~=_@]"), T.byte_table(r"[!?.,;:'\"()\[\]/-]"), T.byte_table(r"[.!?]")
_BANG = T.byte_table(r"[!]")
OWN = 24


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line with a visible character; the length of each; the
    first line of each text."""
    data, off = T.utf8(column)
    space = T.SPACE[data]
    ls, le, lfirst = T.runs(data != 10, off)
    ws, we, _ = T.runs(~space, off)
    wa, wb = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    keep = wb > wa
    ldoc = T.owner(lfirst)[keep]
    ls, le, wa, wb = ls[keep], le[keep], wa[keep], wb[keep]
    first = np.searchsorted(ldoc, np.arange(len(off)))
    n = len(ls)
    if n == 0:
        return np.zeros((0, OWN)), np.zeros(0), first

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return (total[le] - total[ls]) / (le - ls)

    rolling = T.Rolling(data)
    words = rolling.span(ws, we)
    line_of = np.repeat(np.arange(n), wb - wa)
    # words outside kept lines do not exist: every word is in a line
    same = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.concatenate([[False], (words[1:] == words[:-1]) & (line_of[1:] == line_of[:-1])]), out=same[1:])
    count = wb - wa
    key = words + T.mix(line_of.astype(np.uint64))
    distinct = np.bincount(line_of[np.unique(key, return_index=True)[1]], minlength=n)
    line_key = rolling.span(ls, le) + T.mix(ldoc.astype(np.uint64) + np.uint64(9))
    _, inverse, times = np.unique(line_key, return_inverse=True, return_counts=True)
    last = data[we[wb - 1] - 1]
    chars = le - ls
    upper, lower, symbol, bang = share(_UPPER[data]), share(_LOWER[data]), share(_SYMBOL[data]), share(_BANG[data])
    repeat, fresh = (same[wb] - same[wa]) / count, distinct / count
    f = [np.log1p(chars) / 6, np.log1p(count) / 4, (chars / count) / 10, symbol, upper, lower, share(_DIGIT[data]),
         share(_PUNCT[data]), share(data >= 128), bang, repeat, fresh, _STOP[last], times[inverse] > 1,
         symbol > 0.01, symbol > 0.05, symbol > 0.2, upper > lower, bang > 0.02, repeat > 0.1, repeat > 0.5,
         (fresh < 0.6) & (count > 8), count < 4, share(data == 124) > 0.02]
    return np.stack([np.asarray(x, np.float64) for x in f], 1), chars.astype(np.float64), first


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the lines before and after it in its
    text, and a constant."""
    n = len(own)
    if n == 0:
        return np.zeros((0, 3 * OWN + 1))
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    after[:-1] = own[1:]
    before[first[:-1][first[:-1] < n]] = 0
    after[first[1:][first[1:] > 0] - 1] = 0
    return np.concatenate([own, before, after, np.ones((n, 1))], 1)


def fit(features: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (of "good" against "bad") and transitions that maximise the
    conditional likelihood of the line labels, with a small ridge."""
    w, move = np.zeros(features.shape[1]), np.zeros((2, 2))
    state = np.repeat(label, np.diff(first))
    onehot = np.stack([1 - state, state], 1).astype(float)
    inner = np.diff(first) - 1
    seen = np.array([[inner[(label == 0) & (inner > 0)].sum(), 0], [0, inner[(label == 1) & (inner > 0)].sum()]], float)
    # a document is one piece of evidence: its lines share its label
    weight = 1 / max(1, len(features))
    a, b = crf.Adam(w.shape, 0.1), crf.Adam(move.shape, 0.05)
    for _ in range(steps):
        score = np.stack([np.zeros(len(features)), features @ w], 1)
        p, counts = crf.marginals(score, first, move)
        w += a.step(features.T @ (onehot - p)[:, 1] * weight - 1e-4 * w)
        move += b.step((seen - counts) * weight - 1e-3 * move)
    return w, move


def score_texts(column: pa.Array, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    w, move = model
    own, length, first = line_features(column)
    f = with_neighbours(own, first)
    p, _ = crf.marginals(np.stack([np.zeros(len(f)), f @ w], 1), first, move)
    total = np.concatenate([[0.0], np.cumsum(p[:, 1] * length)])
    weight = np.concatenate([[0.0], np.cumsum(length)])
    s, n = total[first[1:]] - total[first[:-1]], weight[first[1:]] - weight[first[:-1]]
    return np.clip(np.divide(s, n, out=np.zeros(len(s)), where=n > 0), 0, 1)


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          quality_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The model, from at most `sample` labelled documents that are not held
    out.  NULL ids and labels are not used; of several labels of a document the
    smallest counts.  Without labels of both kinds every line is as likely good as bad."""
    chosen = (labels.select(F.col(id_col).alias("id"), F.col(quality_col).alias("q"))
              .where(F.col("id").isNotNull() & F.col("q").isNotNull() & ~held_out("id"))
              .groupBy("id").agg((F.min("q") >= 1).cast("int").alias("q")))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)  # bounded, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    picked = (texts.join(F.broadcast(chosen), "id").groupBy("id")
              .agg(F.min("text").alias("text"), F.min("q").alias("q")))

    def measure(batches):
        for chunk in T.chunks(batches):
            own, _, first = line_features(chunk.column("text"))
            own = own.astype(np.float32)
            lines = [own[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([chunk.column("id"), chunk.column("q"), pa.array(lines, pa.binary())], ["id", "q", "lines"])

    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    rows = picked.mapInArrow(measure, f"id {kind}, q int, lines binary").orderBy("id").collect()
    label = np.array([r["q"] for r in rows], np.int64)
    if len(set(label.tolist())) < 2:
        return np.zeros(3 * OWN + 1), np.zeros((2, 2))
    own = [np.frombuffer(bytes(r["lines"]), np.float32).reshape(-1, OWN) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    return fit(with_neighbours(np.concatenate(own).astype(np.float64), first), first, label)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  quality_col: str = "quality", sample: int = SAMPLE, cut: float = CUT,
                  keep: list[str] | None = None, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """The documents with score (0 to 1) and predicted (1 if score >= cut), by
    `model` or one trained here.

    All columns are kept, or those in `keep`; columns named score or predicted are replaced.
    NULL, empty and blank texts have no line and score 0.  Repeated rows are
    scored one by one.  Rows never leave their partition.
    """
    model = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels, id_col, text_col, quality_col, sample))
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    back = text_col in names

    def run(batches):
        for chunk in T.chunks(batches):
            cols = [chunk.column("row"), *([chunk.column("text")] if back else [])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(score_texts(chunk.column("text"), model.value))],
                                             ["row", *(["text"] if back else []), "score"])

    d = T.rows_beside_text(docs.select(*{f"`{c}`": 1 for c in [*names, text_col]}), text_col).withColumnRenamed("id", "row")
    out = d.mapInArrow(run, f"row {d.schema['row'].dataType.simpleString()}, {'text string, ' * back}score double")
    cols = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names]
    return out.select(*cols, "score", (F.col("score") >= cut).cast("int").alias("predicted"))
