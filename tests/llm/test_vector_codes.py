"""op13: codes, errors and codebooks against plain Lloyd rounds in Python integers."""
import math
import random

import numpy as np
import pytest

from finlake.llm import vector_codes as V


def plain(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return [], []
    width = max(1, -(-max(len(v) for _, v in kept) // parts))
    kept = sorted(((i, v) for i, v in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [(i, [tuple((v + [0] * (parts * width))[p * width:(p + 1) * width]) for p in range(parts)]) for i, v in kept]
    books = [[x[p] for _, x in cut[:entries]] for p in range(parts)]

    def near(x, book):
        away = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return away.index(min(away)), min(away)
    for _ in range(rounds):
        for p, book in enumerate(books):
            at = [near(x[p], book)[0] for _, x in cut]
            for e in set(at):
                own = [x[p] for (_, x), a in zip(cut, at) if a == e]
                book[e] = tuple(sum(c) // len(own) for c in zip(*own))
    out = []
    for i, x in cut:
        found = [near(x[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{a:02x}" for a, _ in found), min(sum(d for _, d in found), (1 << 63) - 1)))
    return sorted(out, key=repr), books


def vectors(n, size, seed=1, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(size)]) for i in range(n)]


def compare(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, row string, code string")
    got, books = V.compress(df.repartition(3), **how)
    want, wanted_books = plain(rows, how.get("parts", V.PARTS), how.get("entries", V.ENTRIES), how.get("rounds", V.ROUNDS))
    assert got.columns == ["vec_id", "code", "error"]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert [[tuple(e) for e in b.tolist()] for b in books] == wanted_books


@pytest.mark.parametrize("how", [{}, {"parts": 4, "entries": 5, "rounds": 4}, {"parts": 2, "entries": 3, "rounds": 0}])
def test_equals_plain_rounds(spark, how):
    rows = vectors(300, 32)
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # one vector a third of all rows
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 30), (2002, [float("nan")] * 32), (2003, [float("-inf")] * 32)]
    compare(spark, rows, **how)


def test_odd_lengths_ties_and_few_rows(spark):
    compare(spark, [(1, [1.0] * 7), (2, [1.0] * 7), (3, [0.5] * 3), (4, [])], parts=4)
    compare(spark, [(5, [])], parts=4)
    compare(spark, [(1, [0.1, 0.2])], parts=2)


def test_large_components_are_exact(spark):
    rows = [(i, [c * 1e7 for c in v]) for i, v in vectors(40, 8, seed=2)]
    compare(spark, rows, parts=4, entries=6, rounds=2)


def test_no_vectors(spark):
    for rows in ([], [(1, None), (2, [float("nan")])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        got, books = V.compress(df)
        assert got.collect() == [] and books == [] and got.columns == ["vec_id", "code", "error"]


def test_only_parts_that_change_entry_move(spark):
    """A second round's shuffle holds the parts whose entry changed, no others."""
    import glob
    df = spark.createDataFrame(vectors(200, 16), "vec_id long, embedding array<float>")
    before = set(glob.glob(spark.conf.get("spark.checkpoint.dir").removeprefix("file:") + "/vectors-*"))
    V.compress(df, parts=4, entries=8, rounds=2)
    base, = set(glob.glob(spark.conf.get("spark.checkpoint.dir").removeprefix("file:") + "/vectors-*")) - before
    moved = spark.read.parquet(f"{base}/moved-1").count()
    assert 0 < moved < 400 and spark.read.parquet(f"{base}/owned-0").count() == 800
    assert spark.read.parquet(f"{base}/seen-1").where("moved = 0").count() == 800 - moved


def test_distances_at_the_border_of_doubles():
    x = np.array([[1 << 40, -(1 << 40)], [3, 4]])
    book = np.array([[1 << 40, -(1 << 40) + 1], [0, 0]])
    at, away = V.nearest(x, book)
    assert at.tolist() == [0, 1] and away.tolist() == [1, 25]
