"""Language of every word, and so of a document, from a linear-chain
conditional random field.

Words are runs of ASCII letters and non-ASCII bytes, in lower case.  A word's
features are its prefixes and suffixes, its 2- and 3-byte grams and itself (the
lexicon), hashed into a table of weights; transitions between the languages of
neighbouring words are learned from code-switched sequences, made by joining
short stretches of labelled documents.  Forward-backward labels the words of the whole
text; a document's language has the largest sum of probabilities, weighted by
word length.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finlake.llm import crf
from finlake.llm import text as T
from finlake.llm.quality_crf import held_out

#: labelled documents of each language that the model is fitted on, at most
PER_LANGUAGE = 200
STEPS = 45
BITS = 16
STRETCH, SEQUENCE = 24, 240  # words of a stretch, and of a training sequence
CHUNK = 4 << 20

_LETTER = T.byte_table(r"[A-Za-z]")
_WORD = _LETTER.copy()
_WORD[128:] = True


def _lower(data: np.ndarray) -> np.ndarray:
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    # Latin-1 letters: their second byte, after C3
    second = np.zeros(len(data), bool)
    second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[second] += 32
    return low


class _Words:
    """The words of a column, each distinct one once with its features."""

    def __init__(self, column: pa.Array):
        data, off = T.utf8(column)
        low = _lower(data)
        s, e, self.first = T.runs(_WORD[data], off)
        self.length = (e - s).astype(np.float64)
        rolling = T.Rolling(low)
        _, at, self.word = np.unique(rolling.span(s, e), return_index=True, return_inverse=True)
        s, e = s[at], e[at]
        n = e - s
        parts = [(rolling.span(s, e), np.arange(len(s)), 1)]
        for k in (1, 2, 3, 4):
            ok = np.flatnonzero(n > k)
            parts += [(rolling.span(s[ok], s[ok] + k), ok, 10 + k), (rolling.span(e[ok] - k, e[ok]), ok, 20 + k)]
        for k in (2, 3):
            m = np.maximum(n - k + 1, 0)
            own = np.repeat(np.arange(len(s)), m)
            p = s[own] + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            parts.append((rolling.span(p, p + k), own, 30 + k))
        self.own = np.concatenate([p[1] for p in parts])
        self.feature = np.concatenate([(T.mix(p[0] + np.uint64(p[2])) >> np.uint64(64 - BITS)).astype(np.int64) for p in parts])
        self.scale = 1 / np.sqrt(np.maximum(1, np.bincount(self.own, minlength=len(s))))
        self.distinct = len(s)
        # a text has a letter if a word has an ASCII one; else its characters tell
        self.letter = T.per_row(_LETTER[data], off) > 0
        for i in np.flatnonzero(~self.letter & (np.diff(self.first) > 0)).tolist():
            self.letter[i] = any(c.isalpha() for c in data[off[i]:off[i + 1]].tobytes().decode("utf-8", "replace"))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Emission score of each distinct word by language."""
        out = np.stack([np.bincount(self.own, weights[:, k][self.feature], self.distinct) for k in range(weights.shape[1])], 1)
        return out * self.scale[:, None]


def _switched(first: np.ndarray, label: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word order, sequence bounds and word labels of training sequences made
    of stretches of documents in a fixed random order."""
    starts = np.concatenate([np.arange(a, b, STRETCH) for a, b in zip(first[:-1], first[1:])] or [np.zeros(0, np.int64)]).astype(np.int64)
    doc = np.searchsorted(first, starts, "right") - 1
    ends = np.minimum(starts + STRETCH, first[doc + 1])
    # two stretches of a document in turn, so that most words have a neighbour of their own language
    pair = np.random.default_rng(seed).permutation((len(starts) + 1) // 2)
    order = np.stack([2 * pair, 2 * pair + 1], 1).ravel()
    order = order[order < len(starts)]
    words = np.concatenate([np.arange(starts[i], ends[i]) for i in order] or [np.zeros(0, np.int64)]).astype(np.int64)
    state = np.repeat(label[doc[order]], (ends - starts)[order])
    return words, np.append(np.arange(0, len(words), SEQUENCE), len(words)), state


def fit(words: _Words, label: np.ndarray, languages: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    weights, move = np.zeros((1 << BITS, languages)), np.zeros((languages, languages))
    order, first, state = _switched(words.first, label)
    if not len(order):
        return weights, move
    word = words.word[order]
    inside = np.ones(len(order), bool)
    inside[first[:-1]] = False
    at = np.flatnonzero(inside)
    seen = np.zeros((languages, languages))
    np.add.at(seen, (state[at - 1], state[at]), 1)
    wanted = np.stack([np.bincount(word[state == k], minlength=words.distinct) for k in range(languages)], 1)
    each = 1 / len(order)
    a, b = crf.Adam(weights.shape, 0.2), crf.Adam(move.shape, 0.1)
    for _ in range(steps):
        p, counts = crf.marginals(words.scores(weights)[word], first, move)
        got = np.stack([np.bincount(word, p[:, k], words.distinct) for k in range(languages)], 1)
        g = (wanted - got) * words.scale[:, None] * each
        gradient = np.stack([np.bincount(words.feature, g[words.own, k], 1 << BITS) for k in range(languages)], 1)
        weights += a.step(gradient - 1e-6 * weights)
        move += b.step((seen - counts) * each - 1e-4 * move)
    return weights, move


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, weights and transitions from at most `per_language` labelled,
    not held-out documents of each language, chosen by the smallest hash of
    their id."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    ok = ~held_out("id") & F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = (d.where(ok).select("id", "lang").withColumn("rank", rank).where(F.col("rank") <= per_language)
              .select("id", "lang").distinct())  # bounded, so it may be broadcast
    rows = (d.where(ok).join(F.broadcast(chosen), ["id", "lang"], "leftsemi").groupBy("id", "lang")
            .agg(F.min("text").alias("text")).orderBy("id", "lang").collect())
    names = sorted({r["lang"] for r in rows})
    label = np.array([names.index(r["lang"]) for r in rows], np.int64)
    if not names:
        return [], np.zeros((1 << BITS, 0)), np.zeros((0, 0))
    words = _Words(pa.array([r["text"] for r in rows], pa.large_string()))
    return names, *fit(words, label, len(names))


def label_words(column: pa.Array, weights: np.ndarray, move: np.ndarray) -> tuple[_Words, np.ndarray]:
    """Words of a column and each word's probabilities by language."""
    words = _Words(column)
    p, _ = crf.marginals(words.scores(weights)[words.word], words.first, move)
    return words, p


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per document: id, lang_pred, score and shares, an array of the
    share of each language in the text in alphabetical order of the languages.

    A NULL text or one without a letter is ``und`` with score 0, and so is every
    text if no document has a language to learn from.  Ids, sources and the
    language column are no inputs of a prediction.  Repeated rows are labelled one by
    one; other columns are left out.
    """
    names, weights, move = train(docs, id_col, text_col, lang_col, per_language)
    model = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), move))

    def run(batches):
        for chunk in T.chunks(batches, size=CHUNK):
            if not names:
                n = chunk.num_rows
                yield pa.RecordBatch.from_arrays(
                    [chunk.column("id"), pa.array(["und"] * n), pa.array([0.0] * n), pa.array([[]] * n, pa.list_(pa.float64()))],
                    ["id", "lang_pred", "score", "shares"])
                continue
            words, p = label_words(chunk.column("text"), *model.value)
            total = np.zeros((len(words.word) + 1, len(names)))
            np.cumsum(p * words.length[:, None], axis=0, out=total[1:])
            share = total[words.first[1:]] - total[words.first[:-1]]
            weight = share.sum(1, keepdims=True)
            share = np.divide(share, weight, out=np.zeros_like(share), where=weight > 0)
            known = words.letter & (weight[:, 0] > 0)
            lang = [names[b] if k else "und" for b, k in zip(share.argmax(1).tolist(), known.tolist())]
            score = np.where(known, share.max(1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("id"), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1)),
                 T.lists(pa.array(share.ravel()), np.arange(len(lang) + 1) * len(names))], ["id", "lang_pred", "score", "shares"])

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, lang_pred string, score double, shares array<double>")
    return out.withColumnRenamed("id", id_col)
