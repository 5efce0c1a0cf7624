"""BPE encoding and decoding by per-prefix dynamic programming.

For a byte-level BPE every prefix of a word has one last token: the token t such that the encoding of the prefix is the
encoding of what lies before t, followed by t. An automaton over the vocabulary, a trie with failure links (a suffix of
what is read leads to each match) and not the minimal automaton of all suffixes, gives the tokens that end at a byte,
longest first; the pair-compatibility test tells whether t may follow the last token stored before it. Exactly one does.
Following the stored tokens back from the end of the word gives its ids. All words of a batch advance together in numpy.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from vellum.llm.common import kept, lean, slices, texts

#: The pattern that splits text before the merges of byte-level vocabularies of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker keeps between batches, and bytes of new words that one pass takes.
CACHE_WORDS, PASS_BYTES = 500_000, 2_000_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

NONE = np.int32(2**31 - 1)


def byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Open-addressing table from pairs of tokens to the token that merges them."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.mask = (1 << max(10, int(len(left)).bit_length() + 4)) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.full(self.mask + 1, NONE, np.int32)
        key, value = (left.astype(np.int64) << 32) | right, merged.astype(np.int32)
        at = self._slot(key)
        while len(key):
            free = self.keys[at] < 0
            _, first = np.unique(at, return_index=True)
            put = np.zeros(len(key), bool)
            put[first] = True
            put &= free
            self.keys[at[put]], self.values[at[put]] = key[put], value[put]
            key, value, at = key[~put], value[~put], (at[~put] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        at = self._slot(key)
        got = self.keys[at]
        out = np.where(got == key, self.values[at], NONE)
        odd = np.flatnonzero((got != key) & (got >= 0))
        while len(odd):
            at[odd] = (at[odd] + 1) & self.mask
            got = self.keys[at[odd]]
            hit = got == key[odd]
            out[odd[hit]] = self.values[at[odd[hit]]]
            odd = odd[~hit & (got >= 0)]
        return out


class Merges:
    """The merges of a vocabulary over bytes. Tokens are numbered by age: first the base symbols, then each merge in order, so a larger number was merged later.

    With ``suffix`` the last byte of a word is a symbol of its own kind, and tokens that end a word are found apart."""

    def __init__(self, spec: dict):
        vocab, byte, suffix = spec["model"]["vocab"], byte_of_char(), spec["model"].get("end_of_word_suffix") or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        by_byte = {b: c for c, b in byte.items()}
        names = [by_byte[b] for b in range(256)]
        names += [c + suffix for c in names] if suffix else []
        self.base = len(names)
        names += [a + b for a, b in merges]
        age = {name: i for i, name in enumerate(names)}
        if len(age) != len(names):
            raise ValueError("two merges make one token")
        closed = [bool(suffix) and n.endswith(suffix) and len(n) > len(suffix) for n in names]
        self.names = names
        self.ids = np.array([vocab[n] for n in names], np.uint32)
        self.body = [bytes(byte[c] for c in (n[: -len(suffix)] if end else n)) for n, end in zip(names, closed, strict=True)]
        self.size = np.array([len(b) for b in self.body], np.int32)
        self.left, self.right = np.arange(len(names), dtype=np.int32), np.arange(len(names), dtype=np.int32)
        self.left[self.base :] = [age[a] for a, _ in merges]
        self.right[self.base :] = [age[b] for _, b in merges]
        grown = np.arange(self.base, len(names), dtype=np.int32)
        self.pairs = PairTable(self.left[self.base :], self.right[self.base :], grown)
        usable = np.ones(len(names), bool)
        usable[self.base :] = self.compatible(self.left[self.base :], self.right[self.base :], grown)
        self.suffix = suffix
        self._automaton(usable, np.array(closed))

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether a and b stay side by side: take their merges back, youngest first, and look for a merge across the boundary that would have come before the one taken back (of two alike the left one comes first)."""
        ok = np.ones(len(a), bool)
        at, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), NONE, np.int32) if limit is None else limit.copy()
        while len(at):
            crossed = self.pairs.get(a, b) < limit
            ok[at[crossed]] = False
            on = ~crossed & (np.maximum(a, b) >= self.base)
            at, a, b = at[on], a[on], b[on]
            back = a > b
            limit = np.where(back, a, b + 1)
            a, b = np.where(back, self.right[a], a), np.where(back, b, self.left[b])
        return ok

    def _automaton(self, usable: np.ndarray, closed: np.ndarray) -> None:
        node = {b"": 0}
        parent, edge, depth, token = [0], [0], [0], [-1]
        for t in np.flatnonzero(usable).tolist():
            b = self.body[t][:-1] if closed[t] else self.body[t]
            for j in range(1, len(b) + 1):
                if b[:j] not in node:
                    node[b[:j]] = len(parent)
                    parent.append(node[b[: j - 1]])
                    edge.append(b[j - 1])
                    depth.append(j)
                    token.append(-1)
            if not closed[t]:
                token[node[b]] = t
        parent, edge, depth, token = np.array(parent), np.array(edge), np.array(depth), np.array(token, np.int32)
        go = np.zeros((len(parent), 256), np.int32)
        fall = np.zeros(len(parent), np.int32)
        best = token.copy()
        self.shorter = np.full(len(self.body), -1, np.int32)
        for d in range(1, int(depth.max()) + 1):
            own = np.flatnonzero(depth == d)
            fall[own] = go[fall[parent[own]], edge[own]] if d > 1 else 0
            go[parent[own], edge[own]] = own
            go[own] = go[fall[own]]
            named = own[token[own] >= 0]
            self.shorter[token[named]] = best[fall[named]]
            best[own] = np.where(token[own] >= 0, token[own], best[fall[own]])
        self.go, self.best, self.fall = go, best, fall
        if self.suffix:
            ends = np.flatnonzero(usable & closed)
            at = np.array([node[self.body[t][:-1]] for t in ends.tolist()], np.int32)
            final = np.array([self.body[t][-1] for t in ends.tolist()], np.int32)
            self.closing = PairTable(at, final, ends)
            deep = at > 0
            self.shorter[ends[deep]] = self._close(fall[at[deep]], final[deep])

    def _close(self, state: np.ndarray, final: np.ndarray) -> np.ndarray:
        """The longest token that ends a word with the byte ``final`` after the state."""
        out, on, state = np.full(len(state), -1, np.int32), np.arange(len(state)), state.copy()
        while len(on):
            t = self.closing.get(state[on], final[on])
            hit = t != NONE
            out[on[hit]] = t[hit]
            on = on[~hit & (state[on] > 0)]
            state[on] = self.fall[state[on]]
        return out

    def encode_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and the number of each word's ids."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        length = size[order]
        data = np.frombuffer(b"".join([words[i] for i in order.tolist()]), np.uint8)
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        cell = start + np.arange(len(words))
        last = np.full(len(data) + len(words), -1, np.int32)
        state = np.zeros(len(words), np.int32)
        longest = int(length[0]) if len(length) else 0
        reach = np.searchsorted(-length, -np.arange(1, longest + 2), side="right")
        for j in range(1, longest + 1):
            m, on = int(reach[j - 1]), int(reach[j])
            now = data[start[:m] + j - 1]
            if self.suffix:
                t = np.empty(m, np.int32)
                t[on:] = self._close(state[on:m], now[on:].astype(np.int32))
                state[:on] = self.go[state[:on], now[:on]]
                t[:on] = self.best[state[:on]]
            else:
                state[:m] = self.go[state[:m], now]
                t = self.best[state[:m]]
            pend = np.arange(m)
            while len(pend):
                n = self.size[t]
                ok = n == j
                rest = np.flatnonzero(~ok)
                ok[rest] = self.compatible(last[cell[pend[rest]] + j - n[rest]], t[rest])
                last[cell[pend[ok]] + j] = t[ok]
                pend, t = pend[~ok], self.shorter[t[~ok]]
        word, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        on, left = np.arange(len(words)), length.copy()
        on, left = on[left > 0], left[left > 0]
        while len(on):
            t = last[cell[on] + left]
            word.append(on)
            found.append(t)
            left = left - self.size[t]
            on, left = on[left > 0], left[left > 0]
        word_all, found_all = order[np.concatenate(word)[::-1]], np.concatenate(found)[::-1]
        by = np.argsort(word_all, kind="stable")
        return self.ids[found_all[by]].astype("<u4"), np.bincount(word_all, minlength=len(words))

    def passes(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``encode_flat`` over runs of words of bounded size."""
        at = 0
        while at < len(words):
            to, n = at, 0
            while to < len(words) and (to == at or n < PASS_BYTES):
                n += len(words[to])
                to += 1
            yield self.encode_flat(words[at:to])
            at = to

    def encode_many(self, words: list[bytes]) -> Iterator[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        for ids, counts in self.passes(words):
            body, at = ids.tobytes(), 0
            for end in (4 * np.cumsum(counts)).tolist():
                yield body[at:end]
                at = end


def read_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class ByteBpe(Merges):
    """A byte-level vocabulary: texts are split by a pattern, words are encoded once and kept."""

    def __init__(self, path: str):
        spec = read_spec(path)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        super().__init__(spec)
        self.special = {t["content"]: int(t["id"]) for t in spec.get("added_tokens", [])}
        body_of_id = {int(i): b for i, b in zip(self.ids, self.body, strict=True)} | {i: c.encode() for c, i in self.special.items()}
        self.bodies = [body_of_id.get(i, b"") for i in range(max(body_of_id) + 1)]
        self.cut = regex.compile(SPLIT)
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def learn(self, tokens: set[str]) -> None:
        """Put the ids of words that the cache lacks into it."""
        new = list(tokens - self.cache.keys())
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = list(tokens)
        self.cache.update(zip(new, self.encode_many([t.encode() for t in new]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, as little-endian unsigned 32-bit integers; the special tokens' strings give their ids."""
        split = []
        for text in texts:
            parts = self.special_cut.split(text) if self.special_cut else [text]
            split.append([(self.special[p], None) if i % 2 else (None, self.cut.findall(p)) for i, p in enumerate(parts)])
        self.learn(set().union(*[tokens for parts in split for _, tokens in parts if tokens]))
        get = self.cache.__getitem__
        return [b"".join([np.uint32(s).tobytes() if s is not None else b"".join(map(get, tokens)) for s, tokens in parts]) for parts in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bodies.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def load(path: str) -> ByteBpe:
    return kept("bpe", path, ByteBpe)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of every whole text (array of int). One narrow Arrow pass. Null and empty texts have no ids, null
    doc_ids stay null, repeated rows and very long texts are rows like others, an empty table gives an empty result,
    other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for b in slices(whole):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode(b.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(lean(run, "bpe"), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of its ids; ids that the vocabulary lacks give nothing. Null or empty ids give an empty text; null
    doc_ids, repeated rows and empty tables as in ``encode_documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            found = [bpe.decode(np.array([i for i in x or [] if 0 <= i < len(bpe.bodies)], "<u4").tobytes()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(lean(run, "bpe"), "doc_id long, text string")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode every whole text, decode its ids again, and return the number of ids and the digests of both.

    Null texts are empty (no ids); very long texts are encoded whole; repeated rows give repeated results; a null doc_id
    stays null; an empty table gives an empty result; other columns are ignored. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for b in slices(whole):
                ids = bpe.encode(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return texts(docs).mapInArrow(lean(run, "bpe"), SCHEMA)
