"""op11: the index and its search against plain scoring of all documents."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from finlake.llm import lexical_search as L

WORDS = [f"w{i}" for i in range(40)] + ["Ünï", "ß", "x1"]


def plain(docs, queries, k=L.BEST):
    """Every document scored for every query, as the definition says."""
    cut = [(i, re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in docs]
    cut = [(i, t) for i, t in cut if t]
    n_docs, words = len(cut), sum(len(t) for _, t in cut)
    df = Counter(w for _, t in cut for w in set(t))
    out = []
    for item, text in queries:
        asked = set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        scored = []
        for i, t in cut:
            tf, m = Counter(t), 100 - 50 + (50 * len(t) * n_docs) // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 20 * m))
                    for w in asked if tf[w])
            if s > 0:
                scored.append((-s, (i is None, i or 0), i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def corpus(n, seed=3):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return [(i, " ".join(rng.choices(WORDS, weights, k=rng.choice([1, 3, 20, 90])))) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_equals_plain_scoring(spark, frame, monkeypatch, small):
    docs = corpus(700) + [(9, "W1 w2"), (9, "W1 w2"), (800, None), (801, ""), (802, "-- !"), (803, "w7 " * 30000), (None, "w1 w30")]
    docs += [(1000 + i, "w3 w35 w35") for i in range(150)]  # more equal scores than places
    queries = [(1, "w3 w35"), (2, "W1, w2; ünï Ünï"), (3, None), (4, "nothing here"), (5, " ".join(WORDS)), (5, "w30"), (6, "w7 w0")]
    asked = spark.createDataFrame([(i, t, "x") for i, t in queries], "item_id int, text string, rank string")
    if small:  # several query blocks
        monkeypatch.setattr(L, "QUERY_BYTES", 10)
    got = sorted(map(tuple, L.search(frame(docs).repartition(3), asked).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == plain(docs, queries)


def test_no_rows(spark, frame):
    asked = spark.createDataFrame([(1, "w1")], "item_id int, text string")
    assert L.search(frame([]), asked).collect() == []
    assert L.search(frame([(1, None), (2, "")]), asked).collect() == []
    out = L.search(frame(corpus(5)), asked.limit(0))
    assert out.collect() == [] and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_blocks_are_rejected_before_decompression():
    """Many windows and blocks: same best documents as a full sum, and block
    maxima do reject candidates."""
    rng = np.random.default_rng(5)
    n = 20000
    length = rng.integers(5, 400, n) * (1 + np.arange(n) // 500 % 3 * 8)  # runs of long documents, as sources give
    term, doc, count = [], [], []
    for t, share in enumerate([0.9, 0.5, 0.2, 0.03, 0.004]):
        at = np.flatnonzero(rng.random(n) < share)
        term.append(np.full(len(at), t))
        doc.append(at)
        count.append(np.minimum(rng.geometric(0.6, len(at)), length[at]))
    term, doc, count = (np.concatenate(x) for x in (term, doc, count))
    mixed = rng.permutation(len(term))
    made = L.build_shard(term[mixed], doc[mixed], count[mixed], length)
    row = {a: L._packed(made[a]) for a in L._ARRAYS} | {"terms": made["terms"]}
    weight = np.array([100, 700, 1600, 3500, 5500])
    shard = L.Shard(row, weight, n, int(length.sum()))
    m = 50 + 50 * length * n // int(length.sum())
    total = np.zeros(n, np.int64)
    np.add.at(total, doc, weight[term] * L.impact(count, m[doc]))
    for k in (1, 50):
        want = np.lexsort((np.arange(n), -total))[:k]
        got, score = shard.best(np.arange(5), k, 1)
        order = np.lexsort((got, -score))
        assert got[order].tolist() == want.tolist() and score[order].tolist() == total[want].tolist()
    assert shard.skipped > 0
    bound = np.repeat(shard.block_max, np.diff(shard.block_at))
    order = np.lexsort((doc, term))
    assert (bound >= (weight[term] * L.impact(count, m[doc]))[order]).all()
    # block maxima are reached, not only bounds
    best = np.maximum.reduceat((weight[term] * L.impact(count, m[doc]))[order], shard.block_at[:-1])
    assert (best == shard.block_max).all()


def test_statistics_beyond_64_bits():
    length = np.array([3_000_000])
    assert L._length_part(length, 10**12, 10**18).tolist() == [50 + 50 * 3_000_000 * 10**12 // 10**18]
