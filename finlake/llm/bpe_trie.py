"""Byte-pair encoding over a trie of distinct words, and decoding.

The last token of a prefix's encoding decides the rest: the encoding of a
prefix is that of a shorter prefix followed by one token, and a token may
follow another only if merging the two together leaves them as they are.  So
the distinct words of a chunk are put into a trie, which is walked depth first
with the last token of every prefix on the path; prefixes that words share are
encoded once.  A word's last letter is a symbol of its own (it carries the end
of the word), hence a leaf.

Texts are cut at spaces and line breaks, and a part's ids are remembered per
worker process, up to a fixed number of parts.  Documents are never shuffled.
"""
from __future__ import annotations

import gc
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlake.llm import text as T

#: parts, and words, whose ids a worker remembers; a full memory is emptied (results do not change)
CACHE_PARTS = 300_000
CACHE_PAIRS = 1_000_000
_JOINED = 4096  # parts normalized at once
_SPACE = re.compile(r"\s")
_PRINTABLE = re.compile(r"[!-~]+").fullmatch
_NEVER = 1 << 60
_END = 4  # last letters by which tokens are looked up
_SHORT = tuple(range(_END - 1, 0, -1))
#: word patterns of known files, and what they cut from lower-case printable ASCII
_ASCII_WORDS = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+": r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"}


class TrieEncoder:
    """A tokenizer file's normalizer and word split, and its merges by trie.

    Files of byte-pair models with an end-of-word suffix and without dropout,
    decoder or post-processing of their own are taken; others raise ValueError."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix")
        odd = [k for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for k in ("decoder", "post_processor") if spec.get(k)]
        odd += [t["content"] for t in spec["added_tokens"] if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]]
        if model["type"] != "BPE" or not self.suffix or odd:
            raise ValueError(f"{path}: not a plain byte-pair model with word ends {odd}")
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: r for r, p in reversed(list(enumerate(pairs)))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.names: dict[int, str] = {i: t for t, i in (*self.vocab.items(), *self.special.items())}
        n = len(self.suffix)
        # token by the letters it covers, inside a word and at its end
        self.inner = {t: t for t in self.vocab if not t.endswith(self.suffix)}
        self.final = {t[:-n]: t for t in self.vocab if t.endswith(self.suffix) and len(t) > n}
        self.longest = max(map(len, (*self.inner, *self.final)))
        self.raw = {t: np.array([i], "<u4").tobytes() for t, i in self.vocab.items()}
        # by a prefix's last letters: the lengths of the tokens that can end it, longest first
        self.inner_ends, self.final_ends = self._by_end(self.inner), self._by_end(self.final)
        self.ascii_words = self._known_cut(spec)
        self.spines: dict[str, tuple | None] = {}
        self.follows: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.known_words: dict[str, bytes] = {}

    @staticmethod
    def _by_end(tokens: dict[str, str]) -> dict[str, tuple[int, ...]]:
        sizes: dict[str, set[int]] = {}
        for t in tokens:
            if len(t) >= _END:
                sizes.setdefault(t[-_END:], set()).add(len(t))
        return {end: (*sorted(some, reverse=True), *[n for n in _SHORT if end[-n:] in tokens]) for end, some in sizes.items()}

    @staticmethod
    def _known_cut(spec: dict):
        """How printable ASCII is cut into words, where that is known to need no library."""
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        plain = (normal == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
                 and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"])
        pattern = _ASCII_WORDS.get(cuts[0]["pattern"].get("Regex")) if plain else None
        return re.compile(pattern).findall if pattern else None

    # ---- merges of one token, and which tokens may follow each other
    def _symbols(self, token: str) -> list[str]:
        if token in self.inner:
            return list(token)
        letters = token[:-len(self.suffix)]
        return [*letters[:-1], letters[-1] + self.suffix]

    def _spines(self, token: str) -> tuple | None:
        """The token's left and right edge while it is merged together: each
        symbol there and the rank of the merge that ends it.  None for a token
        that its own letters do not give."""
        if token not in self.spines:
            made: dict[int, tuple] = {}  # number of a symbol -> its two halves and the rank
            row = [(s, i) for i, s in enumerate(self._symbols(token))]
            while len(row) > 1:
                r, i = min((self.rank.get((a[0], b[0]), _NEVER), i) for i, (a, b) in enumerate(zip(row, row[1:])))
                if r == _NEVER:
                    break
                number = -1 - len(made)
                made[number] = row[i], row[i + 1], r
                row[i:i + 2] = [(row[i][0] + row[i + 1][0], number)]
            edges = None
            if len(row) == 1 and row[0][0] == token:
                edges = []
                for side in (0, 1):
                    (name, number), ends, spine = row[0], _NEVER, []
                    while True:
                        spine.append((name, ends))
                        if number not in made:
                            break
                        ends = made[number][2]
                        name, number = made[number][side]
                    edges.append(tuple(spine))
                edges = tuple(edges)
            self.spines[token] = edges
        return self.spines[token]

    def may_follow(self, a: str, b: str) -> bool:
        """Whether a's and b's letters together give a, then b: no merge across
        the border comes while both its sides are there.  Of equal merges the
        left one goes first."""
        key = (a, b)
        ok = self.follows.get(key)
        if ok is None:
            if len(self.follows) >= CACHE_PAIRS:
                self.follows.clear()
            edges = self._spines(b)
            ok = edges is not None
            if ok:
                for x, x_ends in self._spines(a)[1]:
                    for y, y_ends in edges[0]:
                        r = self.rank.get((x, y))
                        if r is not None and r < x_ends and r <= y_ends:
                            ok = False
            self.follows[key] = ok
        return ok

    # ---- the trie
    @staticmethod
    def insert(trie: dict, word: str) -> None:
        node = trie
        for c in word[:-1]:
            child = node.get(c)
            if child is None:
                child = node[c] = {}
            node = child
        node[word[-1], True] = word

    def _last(self, tail: str, depth: int, last: list[str], tokens: dict[str, str], ends: dict[str, tuple[int, ...]]) -> str:
        """The last token of the encoding of a prefix of `depth` letters that
        ends with `tail`, from the last tokens of its own prefixes."""
        for size in ends.get(tail[-_END:], _SHORT):
            token = tokens.get(tail[-size:])
            if token is None or size > depth:
                continue
            if depth == size:
                if self._spines(token) is not None:
                    return token
            else:
                ok = self.follows.get((last[depth - size], token))
                if ok or ok is None and self.may_follow(last[depth - size], token):
                    return token
        raise ValueError(f"no token for the end of {tail!r}")

    def walk(self, trie: dict) -> dict[str, bytes]:
        """Ids of the trie's words as little-endian 32-bit bytes."""
        out: dict[str, bytes] = {}
        raw, longest, skipped = self.raw, self.longest, len(self.suffix)
        last = [""]  # by depth on the current path
        stack = [(0, "", trie)]
        while stack:
            depth, tail, node = stack.pop()
            if depth:
                last[depth:] = [self._last(tail, depth, last, self.inner, self.inner_ends)]
            for key, child in node.items():
                if type(key) is str:
                    stack.append((depth + 1, (tail + key)[-longest:], child))
                    continue
                end = self._last((tail + key[0])[-longest:], depth + 1, last, self.final, self.final_ends)
                ids, at = [raw[end]], depth + 1 + skipped - len(end)
                while at:
                    token = last[at]
                    ids.append(raw[token])
                    at -= len(token)
                out[child] = b"".join(ids[::-1])
        return out

    # ---- texts
    def _words(self, parts: list[str]) -> list[list[str]]:
        """Each part's words.  Parts without white space are normalized and cut
        many at a time, joined by spaces."""
        out: list[list[str]] = []
        for lo in range(0, len(parts), _JOINED):
            some = parts[lo:lo + _JOINED]
            text = self.normalize(" ".join(some))
            ends = np.cumsum([len(p) + 1 for p in text.split(" ")]).tolist()
            if len(ends) != len(some) or any(map(_SPACE.search, some)):
                out += [[w for w, _ in self.split(self.normalize(p))] for p in some]
                continue
            found: list[list[str]] = [[] for _ in some]
            k = 0
            for word, (at, _) in self.split(text):
                while at >= ends[k]:
                    k += 1
                found[k].append(word)
            out += found
        return out

    def _learn(self, new: set[str]) -> None:
        plain, other, words = [], [], []
        for p in new:
            if self.ascii_words and _PRINTABLE(p):
                plain.append(p)
                words.append(self.ascii_words(p.lower()))
            else:
                other.append(p)
        spaced = [p for p in other if _SPACE.search(p)]
        rest = list(set(other).difference(spaced))
        words += self._words(rest) + [w for p in spaced for w in self._words([p])]
        every = set().union(*words)
        fresh = every.difference(self.known_words)
        if len(self.known_words) + len(fresh) > CACHE_PARTS:
            self.known_words.clear()
            fresh = every
        trie: dict = {}
        for w in fresh:
            self.insert(trie, w)
        self.known_words.update(self.walk(trie))
        del trie
        ids = self.known_words
        for part, said in zip(plain + rest + spaced, words):
            self.known[part] = ids[said[0]] if len(said) == 1 else b"".join([ids[w] for w in said])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit bytes."""
        collects = gc.isenabled()
        gc.disable()  # lists of words and the trie are many small objects and have no cycles
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut: list[list[str]] = []  # alternately text and special token
        for t in texts:
            cut.append(self.special_at.split(t) if self.special_at and self.special_at.search(t) else [t])
        parts = [[p.replace("\n", " ").split(" ") for p in pieces[::2]] for pieces in cut]
        every = set().union(*[p for pieces in parts for p in pieces])
        new = every.difference(self.known)
        if len(self.known) + len(new) > CACHE_PARTS:
            self.known.clear()
            new = every
        self._learn(new)
        get = self.known.__getitem__
        out = []
        for pieces, said in zip(cut, parts):
            ids = b"".join(map(get, said[0]))
            for name, more in zip(pieces[1::2], said[1:]):
                ids += np.array([self.special[name]], "<u4").tobytes() + b"".join(map(get, more))
            out.append(ids)
        return out

    def decode(self, ids: bytes) -> str:
        """Tokens joined by spaces; unknown ids are left out."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        try:
            return " ".join(map(self.names.__getitem__, numbers))
        except KeyError:
            return " ".join(self.names[i] for i in numbers if i in self.names)


def encoder(path: str) -> TrieEncoder:
    """The encoder of a file, made once per worker process."""
    return T.held(f"trie {path}", lambda: TrieEncoder(path))


def _encode(path: str):
    def run(batches):
        e = encoder(path)
        for c in T.chunks(batches, uses=f"trie {path}"):
            ids = e.encode([t or "" for t in c.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([c.column("id"), pa.array(ids, pa.binary())], ["id", "ids"])
    return run


def _decode(path: str):
    def run(batches):
        e = encoder(path)
        for c in T.chunks(batches, "ids", uses=f"trie {path}"):
            said = [None if i is None else e.decode(i) for i in c.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([c.column("id"), c.column("ids"), pa.array(said, pa.string())], ["id", "ids", "text"])
    return run


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (little-endian unsigned 32-bit integers as binary) of each
    whole text, as the tokenizer file gives them without special tokens added;
    strings of special tokens inside a text are those tokens.

    NULL and empty texts have no ids.  Rows are handled one by one, so repeated
    rows and ids stay; other columns are left out.  A very long text is a chunk
    of its own."""
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(_encode(tokenizer), f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, ids and text: the tokens of the ids, special ones too, joined by
    spaces, as a file without a decoder gives them.  NULL ids give NULL, no ids
    an empty text, unknown ids nothing."""
    d = coded.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(_decode(tokenizer), f"id {kind}, ids binary, text string").withColumnRenamed("id", id_col)
