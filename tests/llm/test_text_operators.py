"""Operators on whole texts against plain re-computations."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
from tokenizers import Tokenizer
import pytest
from pyspark.sql import functions as F

from finlake.llm import chat, decontam, packing, queries, rules, secrets_scan
from finlake.llm import text as T

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "   \n\t \n"), (3, "   \n\t \n"), (4, "a"), (None, "null id é 中文"), (5, "tie tie tie " * 30),
       (5, "tie tie tie " * 30), (6, "long " * 40000 + "é" * 5000), (7, "\n\n\na b c\n\na b c\n x\n")]


def documents(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def test_rolling_equals_on_equal_spans():
    data = np.frombuffer(b"abcabcxabc" * 20, np.uint8)
    r = T.Rolling(data)
    h = r.span(np.array([0, 3, 7, 10, 1]), np.array([3, 6, 10, 13, 4]))
    assert h[0] == h[1] == h[2] == h[3] != h[4]


# --- packing

def check_packing(rows, docs):
    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in docs)
    total = sum(len(k[1]) * n for k, n in want.items())
    assert sum(r.length for r in rows) == total
    pieces = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens), []).append(r)
    for (i, ids), n in want.items():
        at = 0
        while at < len(ids):
            m = min(1024, len(ids) - at)
            crc = zlib.crc32(np.array(ids[at:at + m], "<u4").tobytes())
            assert len(pieces[i, at, m, crc, len(ids)]) >= n
            at += m
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    assert sorted(by) == list(range(len(by)))
    return 1 - total / max(1, 1024 * len(by))


def test_packing_exact_and_dense(spark, frame):
    docs = documents(spark)
    rows = packing.pack(frame(docs), queries.tokenizer_path()).collect()
    assert check_packing(rows, docs) < 0.03
    check_packing(packing.pack(frame(ODD), queries.tokenizer_path()).collect(), ODD)
    assert packing.pack(frame([]), queries.tokenizer_path()).collect() == []


def test_ids_of_parts_are_ids_of_texts():
    ids, plain = packing._Ids(queries.tokenizer_path()), Tokenizer.from_file(queries.tokenizer_path())
    rng = np.random.default_rng(7)
    alphabet = list(" \n\t  'stvreaé中1.!  \x1c") + ["'s", "'re", "  ", " \n", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(3000)] + ["", " ", "  ", " a", "a ", "a  b"]
    words = ["é.", "ab,", "中文。", "x***", "Ab's.", "A\u0301!", "no²", "z_", "'s", "don't", "\U0001F600", "½", "q…", "a.b", "W" * 30]
    texts += [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(500)]
    for t, raw in zip(texts, ids.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)
    assert np.frombuffer(ids.encode(["a <|endoftext|> b"])[0], "<u4").tolist() == [64, 220, 50256, 275]


def test_ids_cut_at_line_breaks(monkeypatch):
    ids, plain = packing._Ids(queries.tokenizer_path()), Tokenizer.from_file(queries.tokenizer_path())
    words = [a + b for a in "abcdefgh" for b in "klmnop"]
    ids.encode(["\n".join(f"{a} {b}" for a in words for b in words), " ".join(f"{a},\n{b}" for a in words for b in words)])
    assert len(ids.known) <= 3 * len(words) + 1  # not one for each two words that a line break parts

    monkeypatch.setattr(packing, "CACHE_WORDS", 400)
    r = random.Random(3)
    marks = [" ", "\n", "  ", "\n\n", "\t", "\r", "\x1c", "\x85", "\u3000", "a", "Foo", "\u00e9", "x1", "'s", ",", "...", "\u0301", "\u02b0", "<|endoftext|>"]
    for _ in range(200):
        texts = ["".join(r.choices(marks, k=r.randint(0, 14))) for _ in range(10)]
        for t, raw in zip(texts, ids.encode(texts)):
            assert np.frombuffer(raw, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_histogram_packing_shortest_first():
    patterns = packing.pack_histogram({6: 3, 4: 2, 3: 1, 1: 2}, 10)
    used = Counter()
    for n, p in patterns:
        assert sum(k * c for k, c in p) <= 10
        for k, c in p:
            used[k] += n * c
    assert used == {6: 3, 4: 2, 3: 1, 1: 2}
    assert sum(n for n, _ in patterns) == 4
    many = packing.pack_histogram({k: 10 ** 9 + k for k in range(1, 1025)}, 1024)
    assert len(many) <= 3 * 1024


# --- secrets

def base(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        text) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_secrets_base_matches(spark, frame):
    odd = ODD + [(20, 'é PassWord = "abcdefghijkl" secret:short token=' + "A" * 12 + " AKIA" + "Z9" * 8 + " xAKIA123 " + "0a" * 9),
                 (21, "api_key: api_key: aaaaaaaaaaaaaa apikey='" + "q" * 20 + "' ſecret=abcdefghijklmnop toKen=abcdefghijklmnop"),
                 (22, "AKIA" * 10 + "deadbeef" * 5 + "é" * 3 + "deadbeef" * 2)]
    for docs in (documents(spark), odd):
        got = Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans if s.kind != "entropy"))
                      for r in secrets_scan.find_secrets(frame(docs)).collect())
        assert got == Counter((i, tuple(base(t))) for i, t in docs)


def test_entropy_is_incremental_and_allow_listed():
    import math
    run = "x7Kp2mQ9vR4tZ8bN3cW6yL1sD5fG0hJ" + "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1"
    w = 24
    need = secrets_scan.THRESHOLDS[secrets_scan._class(run)]
    hot = set()
    for i in range(len(run) - w + 1):
        c = Counter(run[i:i + w])
        if -sum(n / w * math.log2(n / w) for n in c.values()) >= need:
            hot |= set(range(i, i + w))
    got = secrets_scan.entropy_spans(run)
    assert {p for s, e in got for p in range(s, e)} == hot and hot
    assert secrets_scan.entropy_spans("abcdefghijklmnopqrstuvwxyzABCDEF") == []
    assert secrets_scan.entropy_spans("123e4567-e89b-12d3-a456-426614174000") == []
    assert secrets_scan.entropy_spans("/usr/share/some/long/path/name-2024.1.2") == []


def test_entropy_class_is_that_of_the_window(spark, frame):
    rng = random.Random(3)
    docs = []
    for width in (32, 40, 64):
        for before in ("", "SESSION=", "sig/", "v1.", "Z-", "a_b="):
            for after in ("", ".sig", "/x="):
                docs.append((len(docs), before + "".join(rng.choice("0123456789ABCDEF") for _ in range(width)) + after))
    masked = {r.doc_id: r.text for r in secrets_scan.redact(frame(docs)).collect()}
    for i, text in docs:
        assert not re.search("[0-9A-F]{8}", masked[i]), (text, masked[i])
        w, hot = secrets_scan.WIDTH, set()
        for at in range(len(text) - w + 1):
            n = Counter(text[at:at + w]).values()
            if math.log2(w) - sum(x * math.log2(x) for x in n) / w >= secrets_scan.THRESHOLDS[secrets_scan._class(text[at:at + w])]:
                hot |= set(range(at, at + w))
        assert {p for s, e in secrets_scan.entropy_spans(text) for p in range(s, e)} == hot
    # numbers, paths and names stay allowed behind a prefix
    for text in ("id=20240102030405060708091011121314", "/usr/share/some/long/path/name-2024.1.2", "ID-123e4567-e89b-12d3-a456-426614174000"):
        assert secrets_scan.entropy_spans(text) == []


def test_redaction_takes_one_python_worker(frame):
    # each worker that a task starts is kept with its memory, on check_h beyond an executor's 3000 MB
    plan = secrets_scan.redact(frame([(1, "password=abcdefgh12345678")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_redaction_masks_and_keeps_columns(spark, frame):
    docs = [(1, "é token=abcdefghijklmnop end"), (2, None), (3, "clean"), (3, "clean"), (4, "deadbeef" * 4)]
    out = secrets_scan.redact(frame(docs))
    assert out.columns == frame(docs).columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [
        (1, "é [SECRET] end"), (2, ""), (3, "clean"), (3, "clean"), (4, "[SECRET]")]
    assert secrets_scan.redact(frame([])).count() == 0


# --- quality rules

def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines),
            len(lines) - len(set(lines)), len(hit))


def test_rule_signals(spark, frame):
    for docs in (documents(spark), ODD):
        got = Counter((r.doc_id, *[r[c] for c in rules._COUNTS]) for r in rules.signals(frame(docs)).collect())
        assert got == Counter((i, *plain_counts(t)) for i, t in docs)
    assert rules.signals(frame([])).collect() == []


def test_exact_bound():
    import math
    for k, n, risk in ((0, 300, .01), (0, 298, .01), (2, 700, .01), (7, 1500, .01), (5, 5, .5)):
        cdf = sum(math.comb(n, i) * risk ** i * (1 - risk) ** (n - i) for i in range(k + 1))
        assert rules.safe(k, n, risk, 0.05) == (cdf <= 0.05 and k < n and k <= risk * n)


def test_rules_reject_junk_and_keep_good(spark):
    rows = [(i, " ".join(f"a{i}b{j}" for j in range(80)), "en") for i in range(900)]
    rows += [(1000 + i, "".join(f"w{i}x{j}$*& " for j in range(60)), "en") for i in range(50)]
    rows += [(2000, rows[-1][1], None), (2001, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(900)] + [(1000, 0), (None, 1), (5, None), (7, 1)], "doc_id long, quality int")
    out = {r.doc_id: r for r in rules.judge(docs, labels).collect()}
    assert all(out[i].kept for i in range(900))
    assert not any(out[1000 + i].kept for i in range(50))
    assert "symbols" in out[1000].failed
    assert out[2000].kept and not out[2001].kept and out[2001].base_failed
    assert rules.judge(docs, labels.limit(0)).where("kept").count() == 951


def plain_cutoffs(good, delta=rules.DELTA, risk=rules.RISK):
    """Cutoffs by (stratum, rule) from [(stratum, shares by rule)], each bound summed up in exact fractions."""
    def bounded(k, n, share):
        p = Fraction(str(risk))
        return k < n and sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1)) <= share

    strata = sorted({s for s, _ in good})
    size = Counter(s for s, _ in good)
    first = Fraction(str(delta)) / (len(strata) * 4)
    thin = {s for s in strata if not bounded(0, size[s], first)}
    name = {s: "thin" if s in thin else s for s in strata}
    shares = {(g, r): [v[r] for s, v in good if name[s] == g] for g in set(name.values()) for r in rules.RULES}
    at, left = dict.fromkeys(shares), set(shares)
    while True:
        share = Fraction(str(delta)) / len(left)
        for w in left:
            best = None
            for g in reversed(rules.GRID):
                if not bounded(sum(x > g for x in shares[w]), len(shares[w]), share):
                    break
                best = g
            at[w] = best
        ended = {w for w in left if at[w] == rules.GRID[0]}
        left -= ended
        if not ended or not left:
            return {(s, r): at[name[s], r] for s in strata for r in rules.RULES}


def test_cutoffs_and_verdicts_equal_plain_ones(spark):
    rng, rows = np.random.default_rng(5), []
    for lang, n in (("en", 900), ("de", 300), ("fr", 280), ("es", 40), (None, 30), ("xx", 20)):
        for _ in range(n):
            words = [f"w{x}" for x in rng.integers(0, 10 ** 6, 60)]
            for j in range(min(60, int(rng.exponential(2)))):
                words[j] += "$"
            if rng.random() < 0.02:
                words += words[:8] * 2
            lines = "\n".join(" ".join(words[i:i + 10]) for i in range(0, len(words), 10))
            rows.append((len(rows), lines + ("\n" + words[0]) * int(rng.random() < 0.3), lang))
    labels = [(i, int(lang != "xx")) for i, _, lang in rows]
    rows += [(len(rows) + i, " ".join(f"w{i}x{j}$$" for j in range(60)), lang) for i, lang in enumerate(("de", "xx", "en"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = rules.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    value = {}
    for r in out:
        words, chars, symbols, lines, dups, repeats = plain_counts(rows[r.doc_id][1])
        value[r.doc_id] = {"symbols": symbols / words, "repeats": repeats / words, "duplicate_lines": dups / lines,
                           "long_words": chars / words / 20}
    good = [(r.stratum, value[r.doc_id]) for r in out if r.doc_id < len(labels) and r.stratum != "xx" and not r.base_failed]
    cut = plain_cutoffs(good)
    assert cut["de", "symbols"] == cut["es", "symbols"] == cut["", "symbols"] is not None  # pooled
    assert cut["en", "symbols"] != cut["de", "symbols"]
    for r in out:
        assert set(r.failed) == {k for k, v in value[r.doc_id].items()
                                 if cut.get((r.stratum, k)) is not None and v > cut[r.stratum, k]}
        assert r.kept == (not r.base_failed and not r.failed)
    assert any(r.failed for r in out if r.stratum == "de") and not any(r.failed for r in out if r.stratum == "xx")


def test_ended_walks_pass_their_share_on():
    n, none = 480, [0] * len(rules.GRID)
    assert rules.safe(0, n, 0.01, 0.05 / 4) and not rules.safe(0, n, 0.01, 0.05 / 8)
    walks = {k: none for k in "abcd"} | {k: [n] * len(rules.GRID) for k in "efgh"}
    size = dict.fromkeys("abcd", 10 * n) | dict.fromkeys("efgh", n)
    assert rules.walk(walks, size, 0.01, 0.05) == dict.fromkeys("abcd", 0.02) | dict.fromkeys("efgh")
    walks["e"] = [n] * 40 + [0] * 9
    assert rules.walk(walks, size, 0.01, 0.05)["e"] == rules.GRID[40]
    assert rules.walk({"e": walks["e"], "f": walks["f"]} | {k: [n] * 49 for k in "ghijkl"}, dict.fromkeys("efghijkl", n), 0.01, 0.05)["e"] is None


# --- decontamination

def plain_hits(text, items):
    low = lambda t: [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    words = low(text)
    hit, found = set(), set()
    for item, t in items:
        w = low(t)
        m = min(10, len(w))
        for i in range(len(w) - m + 1) if m else ():
            for j in range(len(words) - m + 1):
                if words[j:j + m] == w[i:i + m]:
                    hit |= set(range(j, j + m))
                    found.add(str(item))
    return len(words), len(hit), tuple(sorted(found))


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_decontamination(spark, frame, block_bytes):
    long = " ".join(f"w{i % 7}x{i % 11}" for i in range(60))
    items = [(1, long), (2, "Only Four words here"), (3, None), (4, "..."), (10, "a a a a a a a a a a a a a"), (10, long[40:200]),
             (5, "é ß ü ä ö å ø æ ñ ç extra"), (None, "only four words here")]
    docs = ODD + [(30, "x " + long + " y"), (31, "ONLY four, WORDS here. only four words"), (32, "a " * 12 + "b " + "a " * 9),
                  (33, long[100:260]), (34, "É ß ü ä ö å ø æ ñ ç é ß ü ä ö å ø æ ñ ç extra"), (35, long + " - " + long)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter()
    for r in decontam.find_contamination(frame(docs), bench, block_bytes=block_bytes).collect():
        got[r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), tuple(r["items"])] += 1
    plain = [("" if i is None else i, t) for i, t in items]
    assert got == Counter((i, *plain_hits(t, plain)) for i, t in docs)
    assert decontam.find_contamination(frame([]), bench).collect() == []
    assert {len(r.spans) for r in decontam.find_contamination(frame(docs), bench.limit(0)).collect()} == {0}


# --- chats

def test_chat_reads_back(spark):
    bs = "\\"
    rows = [(1, 0, "user", "hi <|end|> [INST] <|"), (1, 1, "user", f"<{bs}|turn|> </s> <{bs}{bs}/s> [{bs}/INST]"), (1, 2, "assistant", "a<"),
            (1, 3, "assistant", "|end|> é中"), (1, 4, "system", None), (1, 5, "assistant", ""), (2, None, None, "x"), (2, 1, "a<|b", "y"),
            (2, 1, "a<|b", "y"), (None, 0, "assistant", "tie"), (3, 0, "assistant", "[INST]" * 3), (3, 0, "user", "<s>")]
    rows += [(9, i, "user" if i % 3 else "assistant", f"t{i} <|") for i in range(300)]
    # pieces that fill whole steps of the running sums, many turns of one role, a very long text
    rows += [(10, i, "assistant", f"u{i}é") for i in range(127)] + [(11, i, "assistant", "v") for i in range(255)]
    rows += [(12, i, "ab"[i // 700 % 2], f"w{i}") for i in range(3000)] + [(13, 0, "user", "long <|é" * 200_000), (13, 1, "assistant", "end")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, blocks string")
    out = {r.conv_id: r for r in chat.format_chats(df).withColumn("turns", chat.read_turns(F.col("formatted")))
           .withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert set(out) == {1, 2, 3, 9, 10, 11, 12, 13, None}
    for c, r in out.items():
        mine = sorted([x for x in rows if x[0] == c], key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in mine]
        assert r.loss == "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert len(r.loss_spans) == sum(x[2] == "assistant" for x in mine)
        starts = 1 + sum(a[2] != b[2] for a, b in zip(mine, mine[1:]))
        assert r.formatted.count("<|start|>") == r.formatted.count("<|end|>") == starts
        assert r.formatted.count("<|turn|>") == len(mine) - starts
        assert not re.search(r"\[/?INST\]|</?s>", r.formatted)
    assert chat.format_chats(df.limit(0)).collect() == []
