"""Quality rules with risk-controlled thresholds.

Each rule compares one signal of a document with a cutoff.  Cutoffs come from
labelled good documents: for a stratum and rule, a fixed grid is walked from
the mildest value to the strictest while the exact (Clopper-Pearson) upper
bound of the share of good documents beyond the value stays at or under
`risk`; the last such value is the cutoff.  The walk is fixed-sequence testing, which needs no
correction for the grid; the error probability `delta` is divided among
strata and rules by Holm's method: a walk that reaches the strictest value
passes its share on to the others.  So with probability 1 - delta no
stratum loses more than `risk` of its good documents to any rule.  Strata with
too few good labels to show that for any value, even without a single one beyond it,
are pooled into one; which ones depends on the numbers of labels alone, so the bound
stays exact, but for them it holds of the pool and not of each.  Where the
pool's labels are too few as well, the rules reject nothing there.

The labelled counts are sums by (stratum, rule, grid point), made by Spark; the driver sees
one small row per stratum, so strata must be few (languages, not sources of
single documents).
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlake.llm import text as T
from finlake.session import scratch_dir

SYMBOLS = r"[#*$%&|<>]"
RISK, DELTA = 0.01, 0.05
#: rule -> the signal, as a share or ratio, in SQL; larger is worse
RULES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "long_words": "word_chars / greatest(n_words, 1) / 20",
}
GRID = [round(0.02 * i, 2) for i in range(1, 50)]

_SYMBOL = T.byte_table(SYMBOLS)
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _repeated(key: np.ndarray) -> np.ndarray:
    """Which of the 64-bit keys occur twice or more."""
    s = np.sort(key)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(key), bool)
    table = np.zeros(1 << 20, bool)
    table[(twice >> np.uint64(44)).astype(np.int64)] = True
    out = table[(key >> np.uint64(44)).astype(np.int64)]
    at = np.flatnonzero(out)
    i = np.minimum(np.searchsorted(twice, key[at]), len(twice) - 1)
    out[at] = twice[i] == key[at]
    return out


def _counts(batches):
    for chunk in T.chunks(batches):
        data, off = T.utf8(chunk.column("text"))
        space = T.SPACE[data]
        s, e, first = T.runs(~space, off)
        n = np.diff(first)
        chars = T.per_row(~space & ((data & 0xC0) != 0x80), off)
        rolling = T.Rolling(data)
        salt = T.mix(np.arange(1, len(n) + 1, dtype=np.uint64) * np.uint64(T._BASE_2))
        # words in 3-word windows that occur twice in their text
        h = rolling.span(s, e)
        g = T.grams(h, 3)
        at = np.arange(len(g))
        inside = at + 3 <= np.repeat(first[1:], n)[:len(g)]
        at = at[inside]
        twice = at[_repeated(g[at] + salt[T.owner(first)[at]])]
        hit = np.zeros(len(h), bool)
        for j in range(3):
            hit[twice + j] = True
        # lines with a word, and those equal to an earlier one
        ls, le, lfirst = T.runs(data != 10, off)
        worded = np.searchsorted(s, le) > np.searchsorted(s, ls)
        ldoc = T.owner(lfirst)
        key = (rolling.span(ls, le) + salt[ldoc])[worded]
        _, earliest = np.unique(key, return_index=True)
        dup = np.ones(len(key), bool)
        dup[earliest] = False
        dups = np.zeros(len(ls), np.int64)
        dups[np.flatnonzero(worded)] = dup
        cols = [n, chars, T.per_row(_SYMBOL[data], off), T.per_row(worded, lfirst), T.per_row(dups, lfirst),
                T.per_row(hit, first)]
        yield pa.RecordBatch.from_arrays(
            [chunk.column("id")] + [pa.array(c.astype(np.int64)) for c in cols], ["id", *_COUNTS])


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            stratum_col: str | None = None) -> DataFrame:
    """Counts of each whole text: n_words, word_chars, n_symbols, n_lines (with
    a word), n_dup_lines, n_repeat_words; and the stratum (NULL: ``""``)."""
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col else F.lit("")
    d = docs.select(F.struct(F.col(id_col).alias("id"), stratum.alias("stratum")).alias("id"),
                    F.col(text_col).alias("text"))
    schema = f"id {d.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in _COUNTS)
    return d.mapInArrow(_counts, schema).select(F.col("id.id").alias(id_col), "id.stratum", *_COUNTS)


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def safe(k: int, n: int, risk: float, delta: float) -> bool:
    """Whether the exact upper confidence bound (1 - delta) of a probability,
    after k events in n trials, is at most `risk`: k or fewer events then have
    a probability of at most delta under `risk`."""
    if k >= n or k > risk * n:
        return False
    i = np.arange(k + 1)
    log_n = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    logs = log_n[n] - log_n[i] - log_n[n - i] + i * math.log(risk) + (n - i) * math.log1p(-risk)
    return float(np.exp(logs).sum()) <= delta


def pool_of(sizes: dict[str, int], risk: float, delta: float) -> list[list[str]]:
    """Strata by number of good labels -> groups that get cutoffs together: those
    too small for any cutoff of their own are one group, the last."""
    least = math.log(delta / max(1, len(sizes) * len(RULES))) / math.log1p(-risk)
    thin = sorted(s for s, n in sizes.items() if n < least)
    return [[s] for s in sorted(sizes) if s not in thin] + ([thin] if thin else [])


def walk(beyond: dict[tuple, list[int]], n: dict[tuple, int], risk: float, delta: float) -> dict[tuple, float | None]:
    """Cutoffs by walk.  `beyond` has, for each walk, the good documents beyond
    each grid value, and `n` all its good documents."""
    at, open_ = dict.fromkeys(beyond, len(GRID)), set(beyond)
    while open_:
        share = delta / len(open_)
        for w in open_:
            while at[w] and safe(beyond[w][at[w] - 1], n[w], risk, share):
                at[w] -= 1
        ended = {w for w in open_ if not at[w]}
        if not ended:
            break
        open_ -= ended
    return {w: GRID[i] if i < len(GRID) else None for w, i in at.items()}


def fit_cutoffs(signal: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality",
                risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Cutoffs by stratum: columns stratum, pooled (whether it shares its cutoffs
    with other strata), n (good labels they rest on), then one per rule (a
    share, or NULL: the rule rejects nothing there).

    `labels` with quality 1 are the good holdout; other values and NULL are not
    used.  Several labels of a document count once, and as good only if all
    are 1.  Documents that fail the base rules are no evidence: they go anyway.
    A stratum without good labels has no row.
    """
    good = (labels.where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull())
            .groupBy(F.col(id_col).alias("_id")).agg(F.min((F.col(quality_col) == 1).cast("int")).alias("_good"))
            .where("_good = 1").select("_id"))
    held = (signal.where(~base_failed()).join(good, signal[id_col] == F.col("_id"))
            .select("stratum", *[F.expr(v).alias(r) for r, v in RULES.items()]))
    beyond = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[
        F.sum((F.col(r) > g).cast("long")).alias(f"{r}_{i}") for r in RULES for i, g in enumerate(GRID)])
    rows = {r["stratum"]: r for r in beyond.collect()}  # one row per stratum
    groups = pool_of({s: r["n"] for s, r in rows.items()}, risk, delta)
    size = {g: sum(rows[s]["n"] for s in group) for g, group in enumerate(groups)}
    cut = walk({(g, r): [sum(rows[s][f"{r}_{i}"] for s in group) for i in range(len(GRID))]
                for g, group in enumerate(groups) for r in RULES},
               {(g, r): n for g, n in size.items() for r in RULES}, risk, delta)
    out = [(s, len(group) > 1, size[g], *[cut[g, r] for r in RULES]) for g, group in enumerate(groups) for s in group]
    schema = "stratum string, pooled boolean, n long, " + ", ".join(f"{r} double" for r in RULES)
    return signal.sparkSession.createDataFrame(out, schema)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          stratum_col: str | None = "lang", quality_col: str = "quality", risk: float = RISK,
          delta: float = DELTA) -> DataFrame:
    """One row per document: id, stratum, the counts, base_failed, failed (names
    of the rules beyond their cutoff) and kept.

    NULL and empty texts have no words and fail the base rules.  A NULL
    stratum is a stratum like others; a stratum without good labels rejects by
    the base rules only.  Repeated rows are judged one by one; other columns
    are left out.
    """
    at = scratch_dir(docs.sparkSession, "signals")  # a few numbers per document, used twice
    signals(docs, id_col, text_col, stratum_col).write.parquet(at)
    signal = docs.sparkSession.read.parquet(at)
    cuts = fit_cutoffs(signal, labels, id_col, quality_col, risk, delta).collect()
    by = {c["stratum"]: c for c in cuts}
    limit = {r: F.create_map(*[x for s, c in by.items() if c[r] is not None for x in (F.lit(s), F.lit(c[r]))])
             if any(c[r] is not None for c in cuts) else F.lit(None).cast("map<string,double>") for r in RULES}
    failed = F.array_compact(F.array(*[F.when(F.expr(v) > limit[r][F.col("stratum")], F.lit(r))
                                       for r, v in RULES.items()]))
    return (signal.withColumn("base_failed", base_failed()).withColumn("failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)))
