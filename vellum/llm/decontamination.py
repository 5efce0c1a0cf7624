"""Benchmark decontamination: which words of a document lie in ten-word windows of benchmark items (Wu-Manber).

A text is read as its words, lower-cased, each with one space before and after it, so that a window is a string that can
only be found at word bounds. Windows of like length share a table: a block of bytes at the cursor gives by the shift
table how far no window can end, and the cursor skips that far; where the shift is 0, the bucket of the block has the
windows whose first bytes end in it, their first bytes are compared, then all bytes. Cursors of many stretches of text
advance together in numpy. Documents stay where they are read: nothing is shuffled.

The tables are broadcast, for items of at most ``ITEM_BYTES`` of text; more items are searched in groups of that size,
one pass over the documents after another.

Nulls and texts without words: no words, no hits; an item without words has no window. A null item_id counts as an empty
one. Rows of one item_id are one item with the windows of all of them; repeated documents get equal rows. Empty tables:
no documents give no rows, no items no hits. Of very long texts each is searched by itself, in the same way. Columns
other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vellum.llm.common import U64, bound_batches, lean, materialize, raw, slices

#: Words of a window.
WINDOW = 10
#: Bytes of item text whose tables are broadcast at once.
ITEM_BYTES = 16 << 20
#: Bytes of text that one cursor walks; cursors of a slice walk together.
STRETCH = 512
#: Windows of these lengths in bytes and more share a table, up to the next length.
LENGTHS = (3, 4, 16, 32, 64)
#: Candidates that are compared at once.
COMPARED = 1 << 16
_PAD = 8
_ODD = U64(0x9E3779B97F4A7C15)

# Bytes of words: digits, letters (upper-case ones as lower-case) and all bytes of other characters than ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class Spaced:
    """Texts as words with single spaces around them: ``body``, the place of each word in it and its document.

    Texts are parted by line feeds, which no window contains; ``_PAD`` bytes lie before and after."""

    def __init__(self, col: pa.Array):
        data, offsets = raw(col)
        solid = _WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]]))) if len(data) else np.zeros(0, np.int64)
        ends = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))) + 1 if len(data) else starts
        size = ends - starts
        self.doc = np.searchsorted(offsets[1:], starts, side="right")
        self.count = np.bincount(self.doc, minlength=len(col)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        before = np.concatenate([[0], np.cumsum(size)])
        self.start = _PAD + before[:-1] + np.arange(len(size)) + 2 * self.doc + 1
        self.end = self.start + size
        n = 2 * _PAD + int(before[-1]) + len(size) + 2 * len(col)
        self.body = np.full(n, 0x20, np.uint8)
        self.body[np.arange(int(before[-1])) + np.repeat(self.start - before[:-1], size)] = _LOWER[data[solid]]
        self.body[_PAD + before[self.first[1:]] + self.first[1:] + 2 * np.arange(len(col)) + 1] = 0x0A
        self.body[:_PAD] = self.body[-_PAD:] = 0x0A

    def codes(self) -> np.ndarray:
        """The eight bytes from each place on, as numbers, without a copy."""
        return np.ndarray(len(self.body) - 7, "<u8", self.body, strides=(1,))


class Table:
    """Shift table, buckets and first bytes of windows of like length."""

    def __init__(self, items: Spaced, begin: np.ndarray, length: np.ndarray, ids: np.ndarray):
        self.ids, self.begin, self.length = ids, begin, length
        self.m = int(length.min())  # of each window its first m bytes are looked for
        self.block = 8 if self.m >= 16 else 4 if self.m >= 4 else 3
        self.mask = U64((1 << 8 * self.block) - 1)
        codes, far = items.codes(), self.m - self.block
        self.bits = int(np.clip(np.ceil(np.log2(8 * len(ids) * (far + 1))), 12, 22))
        self.shift = np.full(1 << self.bits, far + 1, np.int32)
        for at in range(far + 1):  # shifts fall, so that the least stays
            self.shift[self.slot(codes[begin + at])] = far - at
        slot = self.slot(codes[begin + far])
        order = np.argsort(slot, kind="stable")
        self.bucket = order
        self.lo = np.searchsorted(slot[order], np.arange((1 << self.bits) + 1))
        self.head = codes[begin] & self.mask

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return (((codes & self.mask) * _ODD) >> U64(64 - self.bits)).astype(np.int64)

    def candidates(self, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(begin, slot) of all places where a window may begin: cursors stand at the end of the first m bytes."""
        at = np.arange(_PAD + self.m, n - _PAD + 1, STRETCH)
        stop = np.minimum(at + STRETCH, n - _PAD + 1)
        found, slots = [at[:0]], [at[:0]]
        while len(at):
            slot = self.slot(codes[at - self.block])
            skip = self.shift[slot]
            if (hit := skip == 0).any():
                found.append(at[hit] - self.m)
                slots.append(slot[hit])
            at = at + np.maximum(skip, 1)
            if not (on := at < stop).all():
                at, stop = at[on], stop[on]
        return np.concatenate(found), np.concatenate(slots)

    def matches(self, text: Spaced, items: Spaced) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(begin in the text, window) of all occurrences."""
        codes, own = text.codes(), items.codes()
        at, slot = self.candidates(codes, len(text.body))
        many = self.lo[slot + 1] - self.lo[slot]
        ends = np.cumsum(many)
        for lo in range(0, int(ends[-1]) if len(ends) else 0, COMPARED):  # of a bucket of any size a part at a time
            k = np.arange(lo, min(lo + COMPARED, int(ends[-1])))
            of = np.searchsorted(ends, k, side="right")
            where, window = at[of], self.bucket[self.lo[slot[of]] + k - (ends[of] - many[of])]
            same = ((codes[where] ^ self.head[window]) & self.mask == 0) & (where + self.length[window] <= len(text.body))
            where, window = where[same], window[same]
            for a in range(0, int(self.length[window].max(initial=0)), 8):  # eight bytes at once, the last ones from the end
                size = self.length[window]
                off = np.maximum(np.minimum(a, size - 8), 0)
                cut = U64(2**64 - 1) >> (U64(8) * (U64(8) - np.minimum(size, 8).astype(U64)))
                same = (codes[where + off] ^ own[self.begin[window] + off]) & cut == 0
                where, window = where[same], window[same]
            if len(where):
                yield where, window


class Search:
    """The windows of a group of items, ready to be searched for."""

    def __init__(self, ids: list[str], texts: list[str]):
        items = Spaced(pa.array(texts, pa.string()))
        self.items = items
        self.names = sorted(set(ids))
        place = {x: i for i, x in enumerate(self.names)}
        item = np.array([place[x] for x in ids], np.int64)
        full = np.maximum(items.count - WINDOW + 1, np.minimum(items.count, 1))
        row = np.repeat(np.arange(len(ids)), full)
        head = items.first[row] + np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
        words = np.minimum(items.count[row], WINDOW)
        begin = items.start[head] - 1
        length = items.end[head + words - 1] + 1 - begin
        # equal windows are one, with the items of all
        text = items.body.tobytes()
        seen: dict[bytes, int] = {}
        kind = np.fromiter((seen.setdefault(text[b : b + n], len(seen)) for b, n in zip(begin.tolist(), length.tolist(), strict=True)), np.int64, len(begin))
        _, one = np.unique(kind, return_index=True)
        pairs = np.unique(kind * max(1, len(self.names)) + item[row])
        self.owner_lo = np.searchsorted(pairs // max(1, len(self.names)), np.arange(len(one) + 1))
        self.owners = pairs % max(1, len(self.names))
        self.words = words[one]
        begin, length = begin[one], length[one]
        group = np.searchsorted(LENGTHS, length, side="right")
        self.tables = [Table(items, begin[k], length[k], np.flatnonzero(k)) for g in range(1, len(LENGTHS) + 1) if (k := group == g).any()]

    def __call__(self, text: Spaced, docs: int, edges: np.ndarray) -> np.ndarray:
        """Adds each occurrence to ``edges`` (how many begin and end at a word); gives the pairs document * items + item."""
        found, n = [np.zeros(0, np.int64)], max(1, len(self.names))
        for table in self.tables:
            for where, window in table.matches(text, self.items):
                window = table.ids[window]
                first = np.searchsorted(text.start, where + 1)
                edges += np.bincount(first, minlength=len(edges)) - np.bincount(first + self.words[window], minlength=len(edges))
                many = self.owner_lo[window + 1] - self.owner_lo[window]
                k = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                found.append(np.unique(np.repeat(text.doc[first], many) * n + self.owners[np.repeat(self.owner_lo[window], many) + k]))
        return np.unique(np.concatenate(found))


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _spans(text: Spaced, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, end) of the runs of hit words, counted in their document."""
    hit = np.cumsum(edges)[: len(text.doc)] > 0
    new = np.concatenate([[True], text.doc[1:] != text.doc[:-1]]) if len(hit) else np.zeros(0, bool)
    start = np.flatnonzero(hit & (new | ~np.concatenate([[False], hit[:-1]])))
    last = np.flatnonzero(hit & (np.concatenate([new[1:], [True]]) | ~np.concatenate([hit[1:], [False]]))) if len(hit) else start
    doc = text.doc[start]
    return doc, start - text.first[doc], last + 1 - text.first[doc]


def _searcher(shared):
    """Texts with what earlier groups of items have found, to the same with what this group finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = shared.value
        for batch in batches:
            for part in slices(batch):
                text = Spaced(part.column("text"))
                edges = np.zeros(len(text.doc) + 1, np.int64)
                docs = part.num_rows
                before, own = part.column("spans"), part.column("items")
                if len(before.flatten()):
                    row = np.repeat(np.arange(docs), np.diff(before.offsets.to_numpy()))
                    flat = before.flatten()
                    edges += np.bincount(text.first[row] + flat.field(0).to_numpy(), minlength=len(edges)) - np.bincount(text.first[row] + flat.field(1).to_numpy(), minlength=len(edges))
                pairs = search(text, docs, edges)
                doc, start, end = _spans(text, edges)
                spans = _lists(np.bincount(doc, minlength=docs), pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["start", "end"]))
                n = max(1, len(search.names))
                if len(own.flatten()):
                    items = [[] if x is None else x for x in own.to_pylist()]
                    for d, k in zip((pairs // n).tolist(), (pairs % n).tolist(), strict=True):
                        items[d].append(search.names[k])
                    found = pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))
                else:
                    found = _lists(np.bincount(pairs // n, minlength=docs), pa.array(search.names, pa.string()).take(pa.array(pairs % n)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "text")), pa.array(text.count), spans, found], ["doc_id", "text", "n_words", "spans", "items"])

    return lean(run)


def benchmark_hits(docs: DataFrame, items: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items): for each document the runs of words, from 0, that lie in windows of items, and the
    ids of these items as sorted texts."""
    spark = docs.sparkSession
    bound_batches(spark)
    given = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    total = given.agg(F.sum(F.octet_length("text") + F.octet_length("id") + 64)).first()[0] or 0
    groups = -(-total // item_bytes) or 1
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    schema = found.schema
    for g in range(groups):
        rows = given.where(F.pmod(F.xxhash64("id", "text"), F.lit(groups)) == g).collect() if groups > 1 else given.collect()
        rows.sort()
        search = spark.sparkContext.broadcast(Search([r["id"] for r in rows], [r["text"] for r in rows]))
        found = found.mapInArrow(_searcher(search), schema)
        if g < groups - 1:
            found = materialize(found, "hits")
    return found.drop("text")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document."""
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    found = benchmark_hits(docs, items).select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)
