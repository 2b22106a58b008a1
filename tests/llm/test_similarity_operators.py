"""Repeats, joins and components against brute force."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from finlake.llm import bloom, ngram_join, repeats
from finlake.llm.components import components

SF = "/root/testdata/sf0.001"


def documents(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def roots(links, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, i) for i in range(1001, 1400)]
    edges += [(i, i + 1) for i in range(2000, 2100)] + [(7, 7), (7, 7)]
    df = spark.createDataFrame([*edges, (None, 3), (3, None)], "u long, v long")
    got = {r.node: r.root for r in components(df).collect()}
    want = roots(edges, {n for e in edges for n in e if e[0] != e[1]})
    assert got == want
    assert components(df.limit(0)).collect() == []


def test_bloom(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    bits = bloom.build(keys, "k")
    mine = np.array([r.k for r in keys.collect()])
    assert bloom.contains(bits, mine).all()
    other = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63 - 1, 20000)
    assert bloom.contains(bits, other).mean() < 0.05
    assert not bloom.contains(bloom.build(keys.limit(0), "k"), mine).any()


# --- n-gram join

def sets(docs, k=3):
    out = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def join_by_pairs(docs, percent=90):
    s = sets(docs)
    links = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and
             min(len(s[i]), len(s[j])) * 100 >= percent * max(len(s[i]), len(s[j])) and
             100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j])]
    comp = roots(links, range(len(s)))
    low = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[comp[i]].append(d)
    return Counter((d, len(s[i]), min(low[comp[i]], default=None)) for i, (d, _) in enumerate(docs))


def families(seed, n=9, size=14):
    """Groups of near copies, some just inside the threshold and some just out."""
    rng = random.Random(seed)
    docs = []
    for g in range(n):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 8, 9, 11, 12, 20, 41, 80, 150, 400]))]
        for _ in range(size):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(w) + 1)
                rng.choice([lambda: w.insert(at, f"x{rng.randrange(9)}"), lambda: w.pop(min(at, len(w) - 1)) if len(w) > 1 else 0,
                            lambda: w.append("end")])()
            docs.append((len(docs) * 3 % 1009, " ".join(w).upper() if rng.random() < .3 else " \n".join(w)))
    return docs


def test_ngram_join(spark, frame):
    odd = [(900, None), (901, ""), (902, " \n"), (903, "a"), (904, "A"), (905, "a b"), (906, "a  B"), (905, "a b"), (None, "a b"), (None, "lonely null"),
           (907, "x " * 500), (908, "x x x"), (909, "long " + " ".join(str(i) for i in range(30000))), (910, " ".join(str(i) for i in range(30000)))]
    for docs in (documents(spark), odd, families(1), families(2), families(3)):
        got = Counter(tuple(r) for r in ngram_join.link_documents(frame(docs)).collect())
        assert got == join_by_pairs(docs)
    assert ngram_join.link_documents(frame([])).collect() == []


def test_ngram_join_large_cluster_in_tiles(spark, frame, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAF_NODES", 7)
    docs = families(4, n=3, size=60)
    got = Counter(tuple(r) for r in ngram_join.link_documents(frame(docs)).collect())
    assert got == join_by_pairs(docs)


def test_groups_keep_every_linked_pair():
    """Any two sets at the threshold share a key, for all sizes."""
    import pyarrow as pa
    starts = ngram_join.band_starts(90)
    rng = random.Random(3)
    for n in [*range(9, 60), 95, 100, 190, 333, 1000]:
        base = [f"t{rng.random()}" for _ in range(n + 2)]
        keep = -(-90 * (2 * (n + 2)) // 190)
        for lost in range(n + 2 - keep + 1):
            w = base[lost:]
            sh = ngram_join._Shingles(pa.array([" ".join(base), " ".join(w)]), 3)
            a, b = (set(sh.tokens[sh.first[i]:sh.first[i + 1]].tolist()) for i in (0, 1))
            if 100 * len(a & b) >= 90 * len(a | b) and a != b:
                row, key = ngram_join._keys(sh, np.array([0, 1]), 90, starts)
                assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


# --- repeats

def remove_plain(docs, length):
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = Counter()
    for (d, _), t in zip(docs, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[d, len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def repeats_of(df):
    return Counter((r.doc_id, r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed), r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_small_windows(spark, frame, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randrange(3, 9)))
    passages = ["".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [rng.choice(passages)[rng.randrange(5):] if rng.random() < .5 else "".join(word() for _ in range(rng.randrange(40))) for _ in range(rng.randrange(5))]
        docs.append((i, "".join(parts)))
    docs += [(100, None), (101, ""), (102, "a" * 300), (103, "ab" * 120), (5, docs[5][1]), (5, docs[5][1]), (None, passages[0] + "null"), (104, "q" * 40)]
    got = repeats_of(repeats.remove_repeats(frame(docs), length=40, spread=12, steps=(5, 1)))
    assert got == remove_plain(docs, 40)


def test_repeats_documents(spark, frame):
    docs = documents(spark)
    docs += [(9001, docs[0][1] * 2 if docs[0][1] else ""), (9002, "x" + (docs[1][1] or "")[3:900])]
    assert repeats_of(repeats.remove_repeats(frame(docs))) == remove_plain(docs, 400)
    assert repeats.remove_repeats(frame([])).collect() == []
    kept = {r.doc_id: (r.kept, r.kept_sha256) for r in repeats.remove_repeats(frame(docs[:5]), with_kept=True).collect()}
    assert all(hashlib.sha256(k).hexdigest() == h for k, h in kept.values())


# --- paragraphs

def paragraph_classes(docs, k=5, percent=80, min_words=10):
    """(doc, line) -> smallest (doc, line) of its class, by all pairs."""
    places, ss = [], []
    for d, t in docs:
        for i, line in enumerate((t or "").split("\n")):
            w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line))
            if len(w) >= min_words:
                places.append((d, i, line))
                ss.append({tuple(w[x:x + k]) for x in range(max(1, len(w) - k + 1))})
    links = [(i, j) for i in range(len(ss)) for j in range(i) if 100 * len(ss[i] & ss[j]) >= percent * len(ss[i] | ss[j])]
    comp = roots(links, range(len(ss)))
    low, n = {}, Counter()
    for i, (d, line, _) in enumerate(places):
        key = (d is None, d or 0, line)
        low[comp[i]] = min(low.get(comp[i], key), key)
        n[comp[i]] += 1
    return Counter((places[i][0], places[i][1], len(places[i][2]), low[comp[i]][1:], (places[i][0] is None, places[i][0] or 0, places[i][1]) != low[comp[i]])
                   for i in range(len(places)) if n[comp[i]] > 1)


def test_paragraphs(spark, frame):
    from finlake.llm import paragraphs
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(rng.randrange(8, 90))] for _ in range(12)]

    def near(p):
        p = list(p)
        for _ in range(rng.choice([0, 0, 1, 2])):
            p[rng.randrange(len(p))] = word()
        return " ".join(p)
    docs = [(i, "\n".join(near(rng.choice(passages)) if rng.random() < .5 else " ".join(word() for _ in range(rng.randrange(40)))
                          for _ in range(rng.randrange(5)))) for i in range(80)]
    docs += [(90, None), (91, ""), (92, "\n\n"), (3, docs[3][1]), (None, near(passages[0])), (None, " ".join(passages[1])),
             (93, "x " * 50 + "\n" + "x " * 60 + "\n\n" + "X " * 70), (94, " ".join(passages[2]).upper() + "\r")]
    for some in (docs, documents(spark)):
        got = Counter((r.doc_id, r.paragraph, r.end - r.start, (r.kept_id or 0, r.kept_paragraph), r.removed)
                      for r in paragraphs.duplicate_paragraphs(frame(some), min_words=10).collect())
        assert got == paragraph_classes(some)
    assert paragraphs.duplicate_paragraphs(frame([])).collect() == []
    cut = paragraphs.without_duplicates(frame([(1, "a\n" + near(passages[4])), (2, "b\n" + " ".join(passages[5]) + "\nc"), (3, " ".join(passages[5])), (4, None)]), min_words=5)
    assert {r.doc_id: r.text for r in cut.collect() if r.doc_id > 1} == {2: "b\n" + " ".join(passages[5]) + "\nc", 3: "", 4: None}


def test_paragraphs_of_ten_words_by_default(spark, frame):
    from finlake.llm import paragraphs
    rng = random.Random(9)
    lines = [" ".join(f"w{rng.randrange(3000)}" for _ in range(n)) for n in (9, 10, 12, 19, 30) for _ in range(4)]
    docs = [(i, "\n".join(rng.sample(lines, 6) + [f"only {i}"])) for i in range(30)]
    got = Counter((r.doc_id, r.paragraph, r.end - r.start, (r.kept_id or 0, r.kept_paragraph), r.removed)
                  for r in paragraphs.duplicate_paragraphs(frame(docs)).collect())
    assert got == paragraph_classes(docs, min_words=10) and any(n[2] < 100 for n in got)


def test_paragraphs_read_texts_twice(spark, frame, monkeypatch):
    """Sets are found again only in lines that may be near copies, and once."""
    from finlake.llm import paragraphs
    a = " ".join(f"w{i}" for i in range(40))
    df = frame([(1, a), (2, "x\n" + a.replace("w7 ", "v7 ")), (3, a.upper()), (4, " ".join(f"u{i}" for i in range(40))), (5, None)])
    kind, read = type(df), []
    run = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *x, **y: read.append("text" in self.columns) or run(self, *x, **y))
    rows = paragraphs.duplicate_paragraphs(df, percent=70).collect()
    assert sorted((r.doc_id, r.paragraph, r.kept_id, r.removed) for r in rows) == [(1, 0, 1, False), (2, 1, 1, True), (3, 0, 1, True)]
    assert sum(read) == 2


def test_paragraphs_of_wanted_lines():
    import pyarrow as pa

    from finlake.llm import paragraphs as P
    rng = random.Random(8)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60))) + " ü" for _ in range(300)]
    column = pa.array(["\n".join(lines[:100]), None, "", "\n \n" + "\n".join(lines[100:]), "AB cd"])
    for k in (1, 3, 5):
        whole = P._Paragraphs(column, k, 3)
        for one in (0, len(whole.line) // 2, len(whole.line) - 1):
            key = whole.line[one:one + 1].view(np.int64)
            wanted = np.zeros(1 << 13, np.uint8)
            for at in P.bloom._positions(key, 16):
                np.bitwise_or.at(wanted, at >> 3, (128 >> (at & 7)).astype(np.uint8))
            part = P._Paragraphs(column, k, 3, wanted)
            assert 0 < len(part.node) < 20
            for i in range(len(part.node)):
                j = next(j for j in range(len(whole.node)) if (whole.doc[j], whole.ls[j]) == (part.doc[i], part.ls[i]))
                assert (part.node[i], part.le[i], part.words[i]) == (whole.node[j], whole.le[j], whole.words[j])
                assert (part.tokens[part.first[i]:part.first[i + 1]] == whole.tokens[whole.first[j]:whole.first[j + 1]]).all()
            assert one in [j for j in range(len(whole.line)) if whole.line[j] in part.line]


def test_first_items_of_owners():
    from finlake.llm import paragraphs as P
    rng = np.random.default_rng(3)
    for n, values in ((0, 1), (1, 1), (2, 1), (500, 5), (500, 400)):
        own = np.sort(rng.integers(0, 9, n))
        value = rng.integers(0, 1 << 63, values).astype(np.uint64)[rng.integers(0, values, n)]
        # values that differ in the lowest bits only meet in the sort
        for value in (value, value & np.uint64(3), value & np.uint64(3) | np.uint64(1 << 62)):
            seen, want = set(), []
            for pair in zip(own.tolist(), value.tolist()):
                want.append(pair not in seen)
                seen.add(pair)
            assert P._firsts(own, value).tolist() == want


def test_passages_in_any_line_layout(spark, frame):
    from finlake.llm import paragraphs
    rng = random.Random(10)
    word = lambda: f"x中{rng.randrange(100000)}"
    fill = lambda n: [word() for _ in range(n)]
    docs, runs = [], []
    for i in range(40):
        run = fill(50)
        wrapped = [" ".join(run[a:a + 7]) for a in range(0, 50, 7)]
        runs.append(run)
        docs += [(4 * i, " ".join(fill(rng.randrange(70)) + run + fill(70))),               # inside a long line
                 (4 * i + 1, " ".join(fill(30)) + "\n" + " ".join(run) + "\n" + "z " * 3),   # a line of its own
                 (4 * i + 2, "\n".join(fill(rng.randrange(4)) + wrapped + fill(3))),         # lines of seven words
                 (4 * i + 3, " ".join(fill(20) + [x.upper() for x in run[:25]]) + "\r\n\t" + " ".join(run[25:] + fill(90)))]
    docs += [(900, None), (901, ""), (902, " ".join(fill(300))), (None, docs[0][1]), (903, "short text")]
    texts = dict(docs)
    rows = paragraphs.duplicate_passages(frame(docs)).collect()
    found = {(r.doc_id, r.kept_id) for r in rows}
    for i in range(40):
        assert {(4 * i + k, 4 * i) for k in range(4)} <= found, i
    assert not {r.doc_id for r in rows} & {900, 901, 902, 903}
    for r in rows:
        said = texts[r.doc_id][r.start:r.end].lower().split()
        assert len(said) == r.n_words == 26 and said == texts[r.doc_id].lower().split()[r.paragraph:r.paragraph + 26]
        assert texts[r.kept_id].lower().split()[r.kept_paragraph:r.kept_paragraph + 26] == said
        assert r.removed == ((r.doc_id, r.paragraph) != (r.kept_id, r.kept_paragraph))
    assert paragraphs.duplicate_passages(frame([])).collect() == []


def test_registered_paragraph_query_has_passages(spark, tmp_path):
    from finlake.llm import queries
    rng = random.Random(11)
    fill = lambda n: [f"w{rng.randrange(100000)}" for _ in range(n)]
    run = fill(57)
    docs = [(15, " ".join(fill(40) + run + fill(43))), (2837, " ".join(run + fill(8)))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op5_paragraph_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows if r.kind == "passage" and r.kept_id == 15} == {15, 2837}


def test_deduplicate_by_row_with_any_column_names(spark):
    """Repeated ids are told apart by their texts, and no column name clashes."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(0, b), (5, a), (5, b), (6, b), (7, None), (None, b), (5, a)]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, _kept string, row string, component_id string")
    out = ngram_join.deduplicate(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in out.collect() if r.text) == [("0", b), ("5", a), ("None", b)]
    assert out.where("text is null").count() == 1
    from finlake.llm import paragraphs
    df = df.withColumnsRenamed({"_kept": "_gone", "row": "_gone_id"})
    cut = paragraphs.without_duplicates(df, min_words=5)
    assert cut.columns == df.columns and cut.count() == len(rows)
    assert {str(r.doc_id): r.text for r in cut.where("doc_id in (0, 6, 7)").collect()} == {"0": b, "6": "", "7": None}
