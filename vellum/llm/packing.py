"""Packing of tokenised documents into fixed windows by order-preserving dynamic programming.

The documents of an input partition form one stream of ids in stored order. A window may end at a document's end for
nothing, at a sentence's end for a small penalty, at any other id for a larger one. The dynamic programme chooses the
ends that minimise padding plus penalties over the whole stream; its transition takes a sliding minimum, held in a
monotone queue. A window that ends at neither end is worth its penalty only when it is full, and only from the start
that is cheapest while it leaves the queue, so that few of the other positions need to be looked at.

The ids at the end of a partition that fill no window are cut into powers of two, which need no padding: at most eleven
short sequences a partition, the shortest of a single id. Who trains on windows alone leaves them out by their length.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vellum.llm.bpe import Merges, read_spec
from vellum.llm.common import U64, Words, kept, lean, slices, texts

#: Ids in a window, id after each document, penalties of a cut (in ids of padding).
WINDOW, END_ID, SENTENCE_CUT, FREE_CUT = 2048, 1, 6, 24
#: Ids after which windows that are certain are given out.
RUN_IDS = 400_000
CACHE_WORDS = 500_000


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ends_document boolean"


class IdStore:
    """Ids of words by the words' hash: an open-addressing table in numpy, emptied when it is full."""

    SLOTS = 1 << 21

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.SLOTS, U64)
        self.at = np.full(self.SLOTS, -1, np.int32)
        self.n, self.used = 0, 0
        self.begin, self.count = np.zeros(CACHE_WORDS, np.int64), np.zeros(CACHE_WORDS, np.int64)
        self.ids = np.zeros(1 << 20, np.uint32)

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> U64(20)).astype(np.int64) & (self.SLOTS - 1)
        out = self.at[slot]
        odd = np.flatnonzero((self.keys[slot] != h) & (out >= 0))
        while len(odd):
            slot[odd] = (slot[odd] + 1) & (self.SLOTS - 1)
            out[odd] = self.at[slot[odd]]
            odd = odd[(self.keys[slot[odd]] != h[odd]) & (out[odd] >= 0)]
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """``h``: distinct hashes that the store lacks."""
        k = self.n
        if k + len(h) > len(self.begin):  # more new words than the store holds: for this pass only
            grown = k + len(h)
            self.begin, self.count = np.resize(self.begin, grown), np.resize(self.count, grown)
            while self.SLOTS < 2 * grown:
                self.SLOTS *= 2
            self.keys, self.at = np.zeros(self.SLOTS, U64), np.full(self.SLOTS, -1, np.int32)
        self.begin[k : k + len(h)] = self.used + np.cumsum(count) - count
        self.count[k : k + len(h)] = count
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.n, self.used = k + len(h), self.used + len(ids)
        value = np.arange(k, self.n, dtype=np.int32)
        slot = (h >> U64(20)).astype(np.int64) & (self.SLOTS - 1)
        while len(h):
            _, first = np.unique(slot, return_index=True)
            put = np.zeros(len(h), bool)
            put[first] = True
            put &= self.at[slot] < 0
            self.keys[slot[put]], self.at[slot[put]] = h[put], value[put]
            h, value, slot = h[~put], value[~put], (slot[~put] + 1) & (self.SLOTS - 1)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries one after the other, and each entry's number of ids."""
        count = self.count[which]
        ends = np.cumsum(count)
        inner = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[which] - ends + count, count)
        return self.ids[inner], count


class WordIds:
    """Ids of whole texts, equal to the library's. The vocabulary drops white space and splits there, so that words between ASCII spaces are encoded apart, each new one once. New words are normalised together and go through the merges; words with other white space or a special token's string are left to the library itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = read_spec(path)
        split = [p["pattern"]["Regex"] for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        self.merges = Merges(spec) if spec["model"].get("end_of_word_suffix") and split and spec.get("normalizer") else None
        self.pieces = regex.compile(split[0] + "| ") if self.merges else None
        odd = [regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = regex.compile("|".join([r"[^\S ]|[\x1c-\x1f\x85\u200b-\u200d\ufeff]", *odd]))
        self.store = IdStore()

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32) for w in words]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)

    def _normal(self, text: str) -> str:
        if text.isascii() or ("\u03a3" not in text and unicodedata.is_normalized("NFC", text)):
            return text.lower()  # the same as the library's normaliser there, but for the white space that it maps
        return self.tokenizer.normalizer.normalize_str(text)

    def new_words(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``n`` words joined by single spaces, and each word's number of ids."""
        if not self.merges:
            return self._library(text.split(" "))
        if self.odd.search(text):
            words = text.split(" ")
            hard = np.array([bool(self.odd.search(w)) for w in words])
            parts = [np.zeros(0, np.uint32)] * n
            for mark, how in ((True, self._library), (False, lambda w: self.new_words(" ".join(w), len(w)))):
                own = np.flatnonzero(hard == mark)
                if len(own):
                    ids, count = how([words[i] for i in own])
                    for i, x in zip(own, np.split(ids, np.cumsum(count)[:-1]), strict=True):
                        parts[i] = x
            return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        normal = self._normal(text)
        if normal.count(" ") != n - 1:
            return self._library(text.split(" "))
        pieces = self.pieces.findall(normal)
        index = {" ": 0}
        which = np.array([index.setdefault(p, len(index)) for p in pieces], np.int64)
        word = np.cumsum(which == 0)[which > 0]
        which = which[which > 0] - 1
        found = list(self.merges.passes([p.encode() for p in list(index)[1:]]))
        ids, count = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        begin, size = (np.cumsum(count) - count)[which], count[which]
        inner = np.arange(int(size.sum())) + np.repeat(begin - np.cumsum(size) + size, size)
        return ids[inner], np.bincount(word, weights=size, minlength=n).astype(np.int64)

    def encode(self, col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text and the numbers of ids at which a sentence ends."""
        w = Words(col)
        h = w.hashes()
        which = self.store.find(h)
        lacking = np.flatnonzero(which < 0)
        if len(lacking):
            new, first = np.unique(h[lacking], return_index=True)
            if self.store.n + len(new) > CACHE_WORDS:
                self.store.clear()
                new, first = np.unique(h, return_index=True)
                lacking = np.arange(len(h))
            at = lacking[first]
            size = w.ends[at] - w.starts[at]
            place = np.cumsum(size + 1) - size - 1
            joined = np.full(int(place[-1] + size[-1]), 32, np.uint8)
            inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            joined[np.repeat(place, size) + inner] = w.data[np.repeat(w.starts[at], size) + inner]
            self.store.add(new, *self.new_words(joined.tobytes().decode("utf-8", "replace"), len(new)))
            which = self.store.find(h)
        ids, count = self.store.take(which)
        upto = np.concatenate([[0], np.cumsum(count)])
        stop = np.isin(w.data[w.ends - 1], np.frombuffer(b".!?", np.uint8))
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            yield ids[upto[a] : upto[b]], upto[a + 1 : b + 1][stop[a:b]] - upto[a]


def load(path: str) -> WordIds:
    return kept("words", path, WordIds)


class Cuts:
    """The dynamic programme over a stream: ends of windows that minimise padding plus penalties, whatever the stream's length.

    Spots are positions where a window may end. ``cost`` of a spot is that of the windows up to it, plus its position,
    so that a window costs its full length and its end's penalty; ``back`` is the spot where that window begins."""

    def __init__(self, window: int):
        self.window = window
        self.at, self.cost, self.back = [0], [0], [-1]
        self.queue: deque[int] = deque([0])  # spots of growing position and cost: the starts that may still be the cheapest

    def _put(self, p: int, fee: int, i: int) -> None:
        c = self.cost[i] + self.window + fee
        queue, cost = self.queue, self.cost
        while queue and cost[queue[-1]] >= c:
            queue.pop()
        queue.append(len(cost))
        self.at.append(p)
        cost.append(c)
        self.back.append(i)

    def extend(self, spots: list[int], fees: list[int]) -> None:
        """Take further positions, rising, with the penalty of an end there."""
        at, queue, window = self.at, self.queue, self.window
        for p, fee in zip(spots, fees, strict=True):
            while at[queue[0]] < p - window:  # the cheapest start leaves the window: its full window is the last chance
                i = queue.popleft()
                self._put(at[i] + window, FREE_CUT, i)
            self._put(p, fee, queue[0])

    def certain(self) -> int:
        """The last spot that every further choice goes through."""
        open_ = sorted(set(self.queue))
        while len(open_) > 1:
            i = self.back[open_.pop()]
            if i not in open_:
                insort(open_, i)
        return open_[0]

    def path(self, j: int) -> list[int]:
        """The ends of the cheapest windows up to spot j."""
        found = []
        while j > 0:
            found.append(self.at[j])
            j = self.back[j]
        return found[::-1]

    def forget(self, j: int) -> None:
        """Begin the stream again at the certain spot j."""
        base, cost = self.at[j], self.cost[j]
        self.queue = deque(i - j for i in self.queue)
        self.at, self.cost, self.back = [p - base for p in self.at[j:]], [c - cost for c in self.cost[j:]], [-1, *(i - j for i in self.back[j + 1 :])]


def tail(rest: int, window: int) -> list[int]:
    """Lengths of the sequences that hold the last ids: powers of two where these cost less than the padding of one window."""
    bits = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return bits if rest < window and (len(bits) - 1) * FREE_CUT < window - rest else [rest]


def cuts(total: int, sentence: np.ndarray, document: np.ndarray, window: int = WINDOW) -> list[int]:
    """Ends of the windows over a whole stream of ``total`` ids; ``sentence`` and ``document``: where these end."""
    fee = dict.fromkeys(np.asarray(sentence).tolist(), SENTENCE_CUT) | dict.fromkeys(np.asarray(document).tolist(), 0) | {total: 0}
    spots = sorted(p for p in fee if 0 < p <= total)
    programme = Cuts(window)
    programme.extend(spots, [fee[p] for p in spots])
    return programme.path(len(programme.at) - 1)


class Packer:
    """Packs a stream of documents; holds the ids whose windows are not certain yet, as a rule those of one run."""

    def __init__(self, window: int, end_id: int, shard: int):
        self.window, self.shard, self.sequence = window, shard, 0
        self.end = np.array([end_id], "<u4")
        self.open: list[tuple[int | None, np.ndarray, int, int]] = []  # doc_id, ids, ids before, ids of the document
        self.held, self.due = 0, RUN_IDS
        self.programme = Cuts(window)

    def add(self, doc_id: int | None, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        ids = np.concatenate([ids, self.end]).astype("<u4", copy=False)
        n, at, ends = len(ids), 0, ends[(ends > 0) & (ends < len(ids))]
        while at < n:
            take = min(n - at, RUN_IDS)
            own = ends[(ends > at) & (ends < at + take)] - at + self.held
            spots, fees = own.tolist(), [SENTENCE_CUT] * len(own)
            self.open.append((doc_id, ids[at : at + take], at, n))
            self.held += take
            at += take
            if at == n or at in ends:
                spots.append(self.held)
                fees.append(0 if at == n else SENTENCE_CUT)
            self.programme.extend(spots, fees)
            if self.held >= self.due:
                yield from self.flush()

    def flush(self, last: bool = False) -> Iterator[tuple]:
        """Give out the windows that are certain; with ``last`` all."""
        programme = self.programme
        if last:
            found = programme.path(len(programme.at) - 1)  # the stream ends with a document
            if found:
                begin = found[-2] if len(found) > 1 else 0
                found[-1:] = np.cumsum([begin, *tail(found[-1] - begin, self.window)]).tolist()[1:]
        else:
            j = programme.certain()
            found = programme.path(j)
            programme.forget(j)
        k, opened, rest, b = 0, 0, [], 0
        for doc_id, ids, before, whole in self.open:
            at, n = 0, len(ids)
            while at < n and k < len(found):
                to = min(n, found[k] - b)
                yield doc_id, before + at, to - at, zlib.crc32(ids[at:to].tobytes()), whole, (self.shard << 32) | self.sequence, b + at - opened, before + to == whole
                at = to
                if b + to == found[k]:
                    opened, k = found[k], k + 1
                    self.sequence += 1
            if at < n:
                rest.append((doc_id, ids[at:], before + at, whole))
            b += n
        self.open, self.held = rest, sum(len(p[1]) for p in rest)
        self.due = 2 * self.held + RUN_IDS


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of the tokenised documents with their window (``sequence_id``) and place in it (``offset``).

    Each input partition is packed by itself in stored order: no shuffle, and a retried task gives the same windows.
    Null and empty texts give one piece, the end id. Long documents span windows; repeated rows are packed again;
    a null doc_id stays null; an empty table gives an empty result; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        packer = Packer(window, end_id, TaskContext.get().partitionId())
        kinds = [pa.int64()] * 7 + [pa.bool_()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for whole in batches:
            for b in slices(whole):
                rows = []
                for doc_id, (ids, ends) in zip(b.column("doc_id").to_pylist(), coder.encode(b.column("text")), strict=True):
                    rows += packer.add(doc_id, ids, ends)
                if rows:
                    yield out(rows)
        if rows := list(packer.flush(last=True)):
            yield out(rows)

    return texts(docs).mapInArrow(lean(run, "words"), SCHEMA)
