"""Substring dedup over word sequences by prefix-partitioned suffix trees.

The suffixes of all texts, cut at the window's length, are the leaves of one tree. It is built in subtrees: a suffix's
prefix, of variable length, runs to the end of the smallest run of words in its window, and names the part that the
suffix goes to; suffixes in a row share that run, so that they travel as one segment of words. A part that outgrows
memory is split: its suffixes go on by longer prefixes, up to the whole window. A subtree is held as the order of its
suffixes by their words and the lengths of common prefixes of neighbours; an inner node as deep as the window is a
run of such lengths, its leaves are the places of one repeated window, and windows in a row make a maximal repeat. Only
suffixes that can share such a node are sent: equal windows have equal smallest runs, so that one whose smallest run
stands nowhere else is a leaf of its own.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from vellum.llm.common import NO_ID, U64, Words, as_row, from_row, grams, lean, materialize, mix, partitions, row_key, slices, text_bytes, texts

#: Words of a window and of the runs whose smallest ends its prefix; words by which the prefixes of a part are lengthened.
WINDOW, RUN, LONGER = 20, 8, 4
#: Slots of a partition, which are read one after the other, and how many times more each time that parts are split;
#: words that a part may hold before it is split. Parts of less than half of that are built together.
SLOTS, FINER, MOST_WORDS = 4, 16, 3_000_000
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
#: kind 0: entries of parts, 1: codes that go to their documents, 2: segments of a part that is split.
_ROWS = "bucket int, kind int, slot int, body binary"
_PLACE = 40  # bits of a word's place; the text's number among those of one doc_id stands above
_ID_BYTES = 6  # of a word's hash, in segments
Rows = list[tuple[int, int, int, bytes]]


def _planes(a: np.ndarray) -> bytes:
    """Little-endian byte planes, which pack small numbers well."""
    return a.astype(np.int64, copy=False).view(np.uint8).reshape(len(a), 8).T.tobytes()


def pack(numbers: tuple[np.ndarray, ...], raw: bytes = b"") -> bytes:
    """Columns of equal length as differences, and bytes as they are."""
    small = zstandard.ZstdCompressor(level=1).compress(b"".join(_planes(np.diff(x, prepend=0)) for x in numbers))
    return struct.pack("<II", len(numbers[0]), len(small)) + small + raw


def unpack(blob: bytes, columns: int) -> tuple[list[np.ndarray], bytes]:
    n, size = struct.unpack_from("<II", blob)
    small = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8 : 8 + size]), np.uint8).reshape(columns, 8, n)
    return [np.cumsum(x.T.copy().view(np.int64).reshape(-1)) for x in small], blob[8 + size :]


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each first on, as many as counted, one after the other."""
    return np.arange(int(count.sum())) + np.repeat(first - np.cumsum(count) + count, count)


def smallest_runs(h: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each window, place of its smallest run, hashes of all runs); the leftmost of equal runs counts."""
    run = min(RUN, window)
    g = grams(h, run)
    starts = np.flatnonzero(doc[window - 1 :] == doc[: max(0, len(h) - window + 1)]) if len(h) >= window else np.zeros(0, np.int64)
    if not len(starts):
        return starts, starts, g
    n, span = window - run + 1, 1
    least = g
    while 2 * span <= n:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[starts], least[starts + n - span])
    place = starts.copy()
    todo = np.arange(len(starts))
    for j in range(n):
        hit = g[starts[todo] + j] == least[todo]
        place[todo[hit]] = starts[todo[hit]] + j
        todo = todo[~hit]
        if not len(todo):
            break
    return starts, place, g


def _batch(rows: Rows) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "kind", "slot", "body"])


def _home(h: np.ndarray, buckets: int, slots: int = SLOTS) -> np.ndarray:
    """Bucket and slot of a hash, as one number."""
    return (h % U64(buckets)).astype(np.int64) * slots + ((h // U64(buckets)) % U64(slots)).astype(np.int64)


def _cut(by: np.ndarray, slots: int = SLOTS) -> Iterator[tuple[int, int, slice]]:
    """(bucket, slot, place) of the ranges of equal numbers of a sorted array."""
    edge = [0, *(np.flatnonzero(np.diff(by)) + 1).tolist(), len(by)]
    for i, j in zip(edge, edge[1:], strict=False):
        if j > i:
            yield *divmod(int(by[i]), slots), slice(i, j)


def _known(key: np.ndarray, code: np.ndarray, buckets: int) -> Rows:
    """Rows that carry codes, as runs of consecutive ones, to the buckets of their documents' keys."""
    home = _home(mix(key.view(U64)), buckets)
    order = np.lexsort((code, key, home))
    home, key, code = home[order], key[order], code[order]
    head = np.ones(len(key), bool)
    head[1:] = (key[1:] != key[:-1]) | (code[1:] != code[:-1] + 1)
    at = np.flatnonzero(head)
    home, key, code, count = home[at], key[at], code[at], np.diff(np.append(at, len(code)))
    return [(b, 1, s, pack((key[i], code[i], count[i]))) for b, s, i in _cut(home)]


def _by_slot(batches: Iterator[pa.RecordBatch], least: int = 4 << 20) -> Iterator[list[bytes]]:
    """The bodies of whole slots, of several while they are small. Rows come sorted by slot."""
    held, size, now = [], 0, None
    for b in batches:
        for slot, body in zip(b.column("slot").to_pylist(), b.column("body").to_pylist(), strict=True):
            if slot != now and size >= least:
                yield held
                held, size = [], 0
            now = slot
            held.append(body)
            size += len(body)
    if held:
        yield held


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document: its codes as runs of consecutive ones (starts, then lengths)."""
    for bodies in _by_slot(batches):
        key, start, count = (np.concatenate(x) for x in zip(*(unpack(body, 3)[0] for body in bodies), strict=True))
        order = np.lexsort((start, key))
        key, start, end = key[order], start[order], (start + count)[order]
        edge, rows = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)], []
        for i, j in zip(edge, edge[1:], strict=False):  # a place may be told twice: runs may overlap
            far = np.maximum.accumulate(end[i:j])
            head = np.flatnonzero(np.append(True, start[i + 1 : j] > far[:-1]))
            first, last = start[i:j][head], far[np.append(head[1:], j - i) - 1]
            rows.append((int(key[i]), np.concatenate([first, last - first]).tobytes()))
        for i in range(0, len(rows), 5000):
            k, body = zip(*rows[i : i + 5000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(body, pa.binary())], names=["key", "runs"])


def codes_of(runs: bytes | None, dup: int) -> np.ndarray:
    """The places that runs of codes hold for one text."""
    start, length = np.frombuffer(runs or b"", np.int64).reshape(2, -1)
    own = start >> _PLACE == dup
    return spread(start[own] & ((1 << _PLACE) - 1), length[own])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray, np.ndarray]]:
    for whole in batches:
        for b in slices(whole):
            w = Words(b.column("text"))
            key = b.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
            code = (b.column("dup").to_numpy(zero_copy_only=False).astype(np.int64) << _PLACE)[w.doc] + np.arange(len(w.doc)) - w.first[w.doc]
            yield b, w, key[w.doc], code


def _runs_out(window: int, buckets: int) -> Callable:
    """Smallest runs of every slice, to the slot of their hash. A run that a slice has twice is known to repeat: its
    places go straight to their documents, and other slices get one note of it, an entry of no place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, w, key, code in _slices(batches):
            _, place, g = smallest_runs(w.hashes(), w.doc, window)
            place = place[np.diff(place, prepend=-1) != 0]
            v = g[place]
            values, where, count = np.unique(v, return_inverse=True, return_counts=True)
            twice = count[where] > 1
            once, noted = place[~twice], values[count > 1]
            rows = _known(key[place[twice]], code[place[twice]], buckets)
            hashes, keys, codes = np.concatenate([v[~twice], noted]), np.append(key[once], np.zeros(len(noted), np.int64)), np.append(code[once], np.full(len(noted), -1))
            home = _home(hashes, buckets)
            order = np.argsort(home, kind="stable")
            hashes, keys, codes = hashes[order], keys[order], codes[order]
            yield _batch(rows + [(b, 0, s, pack((keys[i], codes[i]), hashes[i].tobytes())) for b, s, i in _cut(home[order])])

    return run


def _apart(batches: Iterator[pa.RecordBatch], on: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of entries; those with codes are put aside, to be passed on as they are."""
    for b in batches:
        told = pa.array(np.array(b.column("kind").to_numpy(zero_copy_only=False) == 1))
        if told.true_count:
            on.append(b.filter(told))
        yield b.filter(pc.invert(told))


def _runs_in(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Of each slot's runs those that stand in more than one place."""
    on: list[pa.RecordBatch] = []
    for bodies in _by_slot(_apart(batches, on)):
        yield from on
        on.clear()
        keys, codes, hashes = [], [], []
        for body in bodies:
            (k, c), rest = unpack(body, 2)
            keys.append(k), codes.append(c), hashes.append(np.frombuffer(rest, U64))
        key, code, v = map(np.concatenate, (keys, codes, hashes))
        order = np.argsort(v, kind="stable")
        key, code, v = key[order], code[order], v[order]
        head = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        count = np.diff(np.append(head, len(v)))
        again = np.repeat((count > 1) | (np.minimum.reduceat(code, head) < 0), count) & (code >= 0)
        yield _batch(_known(key[again], code[again], buckets))
    yield from on


def segments_of(starts: np.ndarray, place: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first start, number of starts) of each segment: starts in a row of one run and group."""
    head = np.ones(len(starts), bool)
    head[1:] = (starts[1:] != starts[:-1] + 1) | (place[1:] != place[:-1]) | (group[1:] != group[:-1])
    at = np.flatnonzero(head)
    return at, np.diff(np.append(at, len(starts)))


def _send(kind: int, words: np.ndarray, starts: np.ndarray, place: np.ndarray, group: np.ndarray, key: np.ndarray, code: np.ndarray, window: int, buckets: int, slots: int = SLOTS) -> Rows:
    """Suffixes as segments of words, to the slot of their group; ``place``: where the run that names it starts."""
    at, count = segments_of(starts, place, group)
    home = _home(group[at], buckets, slots)
    order = np.argsort(home, kind="stable")
    at, count = at[order], count[order]
    size = count + window - 1
    ids = words[spread(starts[at], size)].view(np.uint8).reshape(-1, 8)[:, :_ID_BYTES]
    upto = np.concatenate([[0], np.cumsum(size)])
    first = starts[at]
    return [(b, kind, s, pack((key[at[i]], code[at[i]], count[i], place[at[i]] - first[i]), ids[upto[i.start] : upto[i.stop]].tobytes())) for b, s, i in _cut(home[order], slots)]


def groups_of(words: np.ndarray, starts: np.ndarray, place: np.ndarray, level: int, window: int) -> np.ndarray:
    """The group of each suffix at a level: by its run, at each further level by more words after it, at last by the whole window."""
    run = min(RUN, window)
    whole = run + LONGER * (level - 1) >= window
    begin, end = (starts, starts + window) if whole else (place, np.minimum(place + run + LONGER * level, starts + window))
    out = np.zeros(len(starts), U64)
    for j in range(int((end - begin).max(initial=0))):
        on = begin + j < end
        out[on] = out[on] * U64(0xD1342543DE82EF95) + words[begin[on] + j]
    return mix(out)


def _suffixes_out(window: int, buckets: int) -> Callable:
    """Suffixes whose smallest run repeats, to the slot of their group. Of equal windows of a slice the first is sent;
    the others are known to come later and go straight to their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, w, key, code in _slices(batches):
            h = w.hashes()
            starts, place, g = smallest_runs(h, w.doc, window)
            marked = np.zeros(len(h), bool)
            for i, (dup, runs) in enumerate(zip(b.column("dup").to_pylist(), b.column("runs").to_pylist(), strict=True)):
                marked[w.first[i] + codes_of(runs, dup)] = True
            on = marked[place]
            starts, place = starts[on], place[on]
            k, c, x = key[starts], code[starts], grams(h, window)[starts]
            order = np.lexsort((c, k, x))
            first = np.ones(len(order), bool)
            first[1:] = x[order][1:] != x[order][:-1]
            lead = order[np.flatnonzero(first)][np.cumsum(first) - 1]
            equal = ~first
            for j in range(window):  # equal hashes are compared word by word
                equal[equal] = h[starts[order[equal]] + j] == h[starts[lead[equal]] + j]
            sent = np.sort(order[~equal])
            later, lead = order[equal], lead[equal]
            own = (k[later] != k[lead]) | (c[later] != c[lead])  # one place may come twice where a row repeats
            yield _batch(_known(k[later[own]], c[later[own]], buckets) + _send(0, h, starts[sent], place[sent], g[place[sent]], k[sent], c[sent], window, buckets))

    return run


@dataclass
class Subtree:
    """The suffixes of a part in the order of their words: ``order`` numbers them, equal ones by document and place;
    ``common`` is the length of the prefix that each has in common with the one before, up to the window."""

    order: np.ndarray
    common: np.ndarray

    def nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(first leaf, number of leaves) of the inner nodes whose leaves have ``depth`` words or more in common, as places in the order."""
        head = np.flatnonzero(self.common < depth)
        count = np.diff(np.append(head, len(self.order)))
        return head[count > 1], count[count > 1]


def build_subtree(words: np.ndarray, starts: np.ndarray, key: np.ndarray, code: np.ndarray, window: int) -> Subtree:
    """Ranks of all runs of 1, 2, 4, ... words, each from pairs of the ranks before, order the suffixes and tell what neighbours have in common."""
    ranks = [np.unique(words, return_inverse=True)[1]]
    while 2 << (len(ranks) - 1) <= window:
        last, span = ranks[-1], 1 << (len(ranks) - 1)
        pair = last.copy() << 32
        pair[: len(last) - span] |= last[span:]
        ranks.append(np.unique(pair, return_inverse=True)[1])
    pieces, at = [], 0
    for level in range(len(ranks) - 1, -1, -1):
        if window - at >= 1 << level:
            pieces.append(ranks[level][starts + at])
            at += 1 << level
    order = np.lexsort((code, key, *pieces[::-1]))
    a, b = starts[order][:-1], starts[order][1:]
    common = np.zeros(len(order), np.int64)
    same = common[1:]
    for level in (*range(len(ranks) - 1, -1, -1), *range(len(ranks) - 2, -1, -1)):
        on = np.flatnonzero(same + (1 << level) <= window)
        on = on[ranks[level][a[on] + same[on]] == ranks[level][b[on] + same[on]]]
        same[on] += 1 << level
    return Subtree(order, common)


class Part:
    """Suffixes of some slots, as segments, up to a number of words."""

    def __init__(self, window: int):
        self.window, self.bodies, self.words = window, [], 0

    def add(self, body: bytes) -> None:
        numbers, rest = unpack(body, 4)
        self.bodies.append((numbers, rest))
        self.words += len(rest) // _ID_BYTES

    def build(self) -> tuple[tuple[np.ndarray, ...], Subtree]:
        """(words, starts, place, key, code) of the suffixes, and their subtree."""
        key, code, count, off = (np.concatenate(x) for x in zip(*(numbers for numbers, _ in self.bodies), strict=True))
        ids = np.zeros((self.words, 8), np.uint8)
        ids[:, :_ID_BYTES] = np.frombuffer(b"".join(rest for _, rest in self.bodies), np.uint8).reshape(-1, _ID_BYTES)
        self.bodies, self.words = [], 0
        words, size = ids.view(U64).reshape(-1), count + self.window - 1
        at = np.cumsum(size) - size
        starts = spread(at, count)
        key, code, place = np.repeat(key, count), spread(code, count), np.repeat(at + off, count)
        return (words, starts, place, key, code), build_subtree(words, starts, key, code, self.window)


def _suffixes_in(window: int, buckets: int, level: int, most: int) -> Callable:
    """Builds the subtree of each slot and tells, of the leaves of every node as deep as the window, all but the first.

    A slot that outgrows ``most`` words keeps one leaf of each node; if that does not halve it, all its suffixes go on
    by longer prefixes, to finer slots."""
    slots = min(SLOTS * FINER ** (level + 1), 1 << 27)

    def settle(part: Part) -> tuple[Rows, tuple[np.ndarray, ...]]:
        (words, starts, place, key, code), tree = part.build()
        head, count = tree.nodes(window)
        lead, later = np.repeat(tree.order[head], count - 1), tree.order[spread(head + 1, count - 1)]
        own = (key[later] != key[lead]) | (code[later] != code[lead])
        first = np.ones(len(starts), bool)
        first[later] = False
        return _known(key[later[own]], code[later[own]], buckets), (words, *(x[first] for x in (starts, place, key, code)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on: list[pa.RecordBatch] = []
        part, now, split = Part(window), None, False
        for b in _apart(batches, on):
            yield from on
            on.clear()
            for slot, body in zip(b.column("slot").to_pylist(), b.column("body").to_pylist(), strict=True):
                if slot != now and (2 * part.words >= most or split):
                    if part.words:
                        told, rest = settle(part)
                        yield _batch(told + (_onward(rest) if split else []))
                    part, split = Part(window), False
                now = slot
                part.add(body)
                if part.words > most:
                    told, rest = settle(part)
                    yield _batch(told)
                    part = Part(window)
                    for _, _, _, body in _send(0, rest[0], rest[1], rest[2], np.zeros(len(rest[1]), U64), rest[3], rest[4], window, 1):
                        part.add(body)
                    if split or 2 * part.words > most:
                        part, split = Part(window), True
                        yield _batch(_onward(rest))
        if part.words:
            told, rest = settle(part)
            yield _batch(told + (_onward(rest) if split else []))
        yield from on

    def _onward(rest: tuple[np.ndarray, ...]) -> Rows:
        words, starts, place, key, code = rest
        group = groups_of(words, starts, place, level + 1, window)
        by = np.lexsort((starts, group))
        return _send(2, words, starts[by], place[by], group[by], key[by], code[by], window, buckets, slots)

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """(key, dup, text): dup numbers the different texts of one doc_id."""
    rows = texts(docs).select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    return rows.repartition(partitions(docs.sparkSession), "key").withColumn("dup", F.dense_rank().over(Window.partitionBy("key").orderBy("text")) - 1)


def later_windows(docs: DataFrame, window: int = WINDOW, most: int = MOST_WORDS) -> DataFrame:
    """(key, runs): for each document with any, the codes of the windows whose words also start earlier.

    ``most``: words that a part of the tree may hold; a larger one is split by longer prefixes."""
    n = partitions(docs.sparkSession)
    numbered = _numbered(docs)
    dealt = lambda df: df.repartitionById(n, "bucket").sortWithinPartitions("slot")
    gathered = lambda df: dealt(df).mapInArrow(lean(_by_key), "key long, runs binary")
    runs = dealt(numbered.mapInArrow(lean(_runs_out(window, n)), _ROWS)).mapInArrow(lean(lambda b: _runs_in(b, n)), _ROWS)
    marked = numbered.join(gathered(runs), "key")
    suffixes, told, level = marked.select("key", "dup", "text", "runs").mapInArrow(lean(_suffixes_out(window, n)), _ROWS), None, 0
    while True:  # as a rule once: a further round only splits parts that outgrow memory
        found = materialize(dealt(suffixes).mapInArrow(lean(_suffixes_in(window, n, level, most)), _ROWS), "leaves")
        told = found.where("kind = 1") if told is None else told.unionByName(found.where("kind = 1"))
        suffixes, level = found.where("kind = 2"), level + 1
        if suffixes.isEmpty():
            return gathered(told)
        suffixes = suffixes.withColumn("kind", F.lit(0))


def removed_mask(n_words: int, dup: int, runs: bytes | None, window: int) -> np.ndarray:
    """Which of a text's words a later window covers."""
    steps = np.zeros(n_words + 1, np.int64)
    own = codes_of(runs, dup)
    steps[own] += 1
    steps[own + window] -= 1
    return np.cumsum(steps[:-1]) > 0


def repeat_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each document the number of its words and of those removed, and the digest of the words kept.

    A word is removed if a window of ``window`` words over it has a word sequence that also starts earlier: in a document
    of smaller doc_id, or earlier in the same one. Null and empty texts have no words; texts shorter than a window lose
    none. Null doc_ids come before all others, in an order by hashes of their texts. Rows that repeat a doc_id and its text are one document, each with the
    same result; different texts of one doc_id follow each other in the order of the texts. An empty table gives an empty
    result; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                n, gone, digest = [], [], []
                for text, dup, runs in zip(text_bytes(b.column("text")), b.column("dup").to_pylist(), b.column("runs").to_pylist(), strict=True):
                    words = text.split()
                    n.append(len(words))
                    if runs:
                        mask = removed_mask(len(words), dup, runs, window)
                        gone.append(int(mask.sum()))
                        words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                    else:
                        gone.append(0)
                    digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
                key = b.column("key").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([None if k < NO_ID else k for k in key], pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = _numbered(docs).join(later_windows(docs, window), "key", "left")
    return joined.select("key", "dup", "text", "runs").mapInArrow(lean(run), DIGEST)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, end): the maximal runs of words of each document that occur earlier, ends exclusive. Null, empty and
    short texts give no row; null and repeated ids, repeated rows and empty tables as in ``repeat_digests``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                rows = []
                for text, key, dup, runs in zip(text_bytes(b.column("text")), b.column("key").to_pylist(), b.column("dup").to_pylist(), b.column("runs").to_pylist(), strict=True):
                    edge = np.flatnonzero(np.diff(removed_mask(len(text.split()), dup, runs, window).astype(np.int8), prepend=0, append=0)).tolist()
                    rows += [(None if key < NO_ID else key, a, e) for a, e in zip(edge[::2], edge[1::2], strict=True)]
                cols = list(zip(*rows, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "end"])

    return _numbered(docs).join(later_windows(docs, window), "key").select("key", "dup", "text", "runs").mapInArrow(lean(run), "doc_id long, start long, end long")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without the words of later windows, with their columns; n_chars follows the text.

    A text that loses words keeps its others joined by one space; one that loses none stays as it is, null, empty and
    white space too. Of equal windows the first by doc_id and place stays, whole texts included, however long; null
    doc_ids come first, in an order by hashes of their texts; rows that repeat a doc_id and text lose the same words, so that both stay or neither; different
    texts of one doc_id follow each other in the order of the texts. An empty table stays empty; other columns go
    through, whatever their names."""

    @F.udf("string", useArrow=True)
    def rest(text: str, dup: int, runs: bytes) -> str:
        words = (text or "").encode().split()
        mask = removed_mask(len(words), dup, runs, window).tolist()
        return b" ".join(w for w, m in zip(words, mask, strict=True) if not m).decode()

    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = as_row(docs).withColumn("key", row_key(F.col("row.doc_id"), text)).repartition(partitions(docs.sparkSession), "key")
    joined = rows.withColumn("dup", F.dense_rank().over(Window.partitionBy("key").orderBy(text)) - 1).join(later_windows(docs, window), "key", "left")
    cut = F.when(F.col("runs").isNotNull(), rest(text, F.col("dup"), F.col("runs")))
    return from_row(joined.withColumn("cut", cut), docs, F.col("runs").isNotNull(), F.col("cut"))
