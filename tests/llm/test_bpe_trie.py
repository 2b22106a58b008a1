"""op12: ids and decoded texts equal the library's, and the trie's tokens equal plain merging."""
import random

import numpy as np
import pytest

from finlake.llm import bpe_trie as B
from finlake.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(4)
    out = ["", " ", "\n\n", "Hello  World's it's <|endoftext|>x <|ENDOFTEXT|> ok", "<|endoftext|>", "a<|startoftext|><|endoftext|> b<|",
           " é é ΣΑΣ 123 ... 你好 \x1cx\x85y z\tq", "a" * 5000 + "!" * 3000, "İstanbul ſ K Å ́a",
           "x\x00y ퟿ \U0001f600‍\U0001f600", "don't we'll I'M they've x'd 's't"]
    for _ in range(1500):
        out.append("".join(rng.choice("aeionrstlhdm") for _ in range(rng.randint(1, 14))) + rng.choice(["", " ", "'s", ".", "\n", "é", "7"])
                   + "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC") for _ in range(rng.randint(1, 9))))
    for _ in range(300):
        spans = [(1, 0x2ff), (0x300, 0x3ff), (0x4e00, 0x4fff), (0x1f300, 0x1f6ff), (0x2000, 0x206f)]
        out.append("".join(chr(rng.randint(*rng.choice(spans))) for _ in range(30)))
    return out


def test_ids_and_decoding_equal_the_library(spark, frame, library):
    said = texts()
    rows = list(enumerate(said)) + [(5000, None), (3, said[3]), (6000, "long word " * 40000)]
    back = B.decode(B.encode(frame(rows).repartition(3), PATH), PATH)
    assert back.columns == ["doc_id", "ids", "text"]
    got = sorted((r["doc_id"], bytes(r["ids"]), r["text"]) for r in back.collect())
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_small_memories_change_nothing(library, monkeypatch):
    monkeypatch.setattr(B, "CACHE_PARTS", 50)
    monkeypatch.setattr(B, "CACHE_PAIRS", 20)
    e, said = B.TrieEncoder(PATH), texts()[:200]
    got = [x for i in range(0, 200, 20) for x in e.encode(said[i:i + 20])]
    assert got == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in said]


def test_general_path_equals_the_known_one():
    fast, slow, said = B.TrieEncoder(PATH), B.TrieEncoder(PATH), texts()
    slow.ascii_words = None
    assert fast.ascii_words and fast.encode(said) == slow.encode(said)


def merged(e, symbols):
    """Plain byte-pair merging: the merge of least rank, leftmost first."""
    row = list(symbols)
    while True:
        found = min(((e.rank.get(p, B._NEVER), i) for i, p in enumerate(zip(row, row[1:]))), default=(B._NEVER, 0))
        if found[0] == B._NEVER:
            return row
        i = found[1]
        row[i:i + 2] = [row[i] + row[i + 1]]


def test_tokens_of_shared_prefixes_equal_plain_merging():
    e, rng = B.TrieEncoder(PATH), random.Random(8)
    words = {"".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for pool in ("ab", "inger", "thaesnrl", "!-=.", "0123") for _ in range(400)}
    trie = {}
    for w in words:
        e.insert(trie, w)
    ids = e.walk(trie)
    assert set(ids) == words
    for w in words:
        want = merged(e, [*w[:-1], w[-1] + e.suffix])
        assert [e.names[i] for i in np.frombuffer(ids[w], "<u4").tolist()] == want


def test_empty_and_odd_ids(spark, frame):
    assert B.encode(frame([]), PATH).collect() == []
    rows = [(1, None), (2, b""), (3, np.array([320, 4_000_000_000, 49407], "<u4").tobytes())]
    out = B.decode(spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in rows], "doc_id int, ids binary"), PATH)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: None, 2: "", 3: "a</w> <|endoftext|>"}


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        B.TrieEncoder(tokenizer_path("byte_bpe_50k.json"))


def test_only_lengths_of_tokens_are_tried(library):
    """A prefix is looked up by the lengths that tokens with its last letters have, longest first."""
    e = B.TrieEncoder(PATH)
    for tokens, ends in ((e.inner, e.inner_ends), (e.final, e.final_ends)):
        for end, sizes in list(ends.items())[:2000]:
            assert list(sizes) == sorted(set(sizes), reverse=True)
            assert all(end[-n:] in tokens for n in sizes if n < len(end))
        for t in list(tokens)[:5000]:
            assert len(t) in ends.get(t[-B._END:], B._SHORT)


def test_words_are_cut_without_collections(monkeypatch):
    import gc
    e, seen = B.TrieEncoder(PATH), []
    words = e._words
    monkeypatch.setattr(e, "_words", lambda parts: seen.append(gc.isenabled()) or words(parts))
    assert gc.isenabled() and e.encode(["söme wörds", "ä"])
    assert seen and not any(seen) and gc.isenabled()
    monkeypatch.setattr(e, "_words", lambda parts: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        e.encode(["nëw"])
    assert gc.isenabled()
