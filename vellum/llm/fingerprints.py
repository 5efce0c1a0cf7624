"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the smallest of its inner s-mers lies at its first or last place. That
depends on the k-mer alone, so that equal passages choose equal anchors whatever stands around them, and the anchors'
places line two texts up. A fingerprint keeps the smallest anchor hash of each of 64 bins with its place, and a digest
of the whole text. Two texts are as like as many of their bins agree in an order that both texts have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vellum.llm.common import U64, lean, mix, partitions, row_key, slices, texts as plain_texts

#: Code points of an anchor and of the inner substring; bins of a fingerprint; documents of a bucket of neighbours, as a mean; most buckets.
K, S, BINS, BUCKET_ROWS, MAX_BUCKETS = 20, 8, 64, 100, 1_000_000
#: Largest place that a fingerprint writes; later places count as this one, so that in texts of more than 16.7 million code
#: points anchors beyond it agree by their hashes alone, not in order, and equal ones there do not add to the likeness.
LAST_PLACE = 0xFFFFFF

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

_EMPTY, _M = U64(2**64 - 1), U64(0x9E3779B97F4A7C15)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-32-le") for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    return np.frombuffer(b"".join(raw), "<u4"), np.concatenate([[0], np.cumsum(size)])


def _runs(values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(values) - n + 1), U64)
    for j in range(n):
        out = out * _M + values[j : j + len(out)]
    return out


def anchors(texts: list[str], k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of every closed syncmer of the texts; a text without any has its whole as one anchor."""
    codes, off = _codes(texts)
    value = mix(codes.astype(U64) + _M)
    inner = mix(_runs(value, s))
    w = k - s + 1
    n = max(0, len(codes) - k + 1)
    least, span = inner, 1
    while 2 * span <= w:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[w - span : w - span + n])
    at = np.flatnonzero((least == inner[:n]) | (least == inner[w - 1 : w - 1 + n]))
    text = np.searchsorted(off[1:], at, side="right")
    within = at + k <= off[text + 1]
    at, text = at[within], text[within]
    h = np.zeros(len(at), U64)
    for j in range(k):
        h = h * _M + value[at + j]
    bare = np.flatnonzero((np.bincount(text, minlength=len(texts)) == 0) & (np.diff(off) > 0))
    if len(bare):
        whole = [int.from_bytes(hashlib.blake2b(texts[i].encode(), digest_size=8).digest(), "little") for i in bare.tolist()]
        text, at, h = np.concatenate([text, bare]), np.concatenate([at, off[bare]]), np.concatenate([h, np.array(whole, U64)])
    return text, at - off[text], mix(h)


@dataclass
class Sketch:
    """Fingerprints of some texts: of each bin 16 bits of the smallest anchor hash (-1: none) and its first place; of each text 16 bits of a digest (-1: empty)."""

    mark: np.ndarray
    place: np.ndarray
    digest: np.ndarray

    def take(self, rows: np.ndarray) -> Sketch:
        return Sketch(self.mark[rows], self.place[rows], self.digest[rows])

    def strings(self) -> list[str]:
        """Four hex digits of the digest, then four and six for hash and place of each bin, dashes for a bin without an anchor; nothing for an empty text."""
        digits = np.frombuffer(b"0123456789abcdef", np.uint8)
        hexed = lambda x, n: digits[(x[..., None] >> np.arange(4 * n - 4, -1, -4)) & 15]
        bins = np.concatenate([hexed(self.mark, 4), hexed(self.place, 6)], axis=-1)
        bins[self.mark < 0] = ord("-")
        rows = np.concatenate([hexed(self.digest, 4), bins.reshape(len(bins), -1)], axis=-1)
        return ["" if d < 0 else row.tobytes().decode() for row, d in zip(rows, self.digest.tolist(), strict=True)]


def parse(fingerprints: list[str]) -> Sketch:
    """The sketch that fingerprints were written from."""
    n = len(fingerprints)
    mark, place, digest = np.full((n, BINS), -1), np.zeros((n, BINS), np.int64), np.full(n, -1)
    for i, f in enumerate(fingerprints):
        if f:
            bins = [f[4 + 10 * j : 14 + 10 * j] for j in range(BINS)]
            digest[i], mark[i], place[i] = int(f[:4], 16), [-1 if x[0] == "-" else int(x[:4], 16) for x in bins], [0 if x[0] == "-" else int(x[4:], 16) for x in bins]
    return Sketch(mark, place, digest)


def sketch(texts: list[str]) -> Sketch:
    """For each text and bin the smallest anchor hash, and the first place that has it."""
    table, place = np.full(len(texts) * BINS, _EMPTY, U64), np.full(len(texts) * BINS, LAST_PLACE)
    text, at, h = anchors(texts)
    cell = text * BINS + (h >> U64(58)).astype(np.int64)
    np.minimum.at(table, cell, h)
    least = h == table[cell]
    np.minimum.at(place, cell[least], at[least])
    none = table == _EMPTY
    place[none] = 0
    mark = np.where(none, -1, ((table >> U64(16)) & U64(0xFFFF)).astype(np.int64))
    digest = [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=2).digest(), "big") if t else -1 for t in texts]
    return Sketch(mark.reshape(-1, BINS), place.reshape(-1, BINS), np.array(digest, np.int64))


def longest_chains(x: np.ndarray, y: np.ndarray, on: np.ndarray) -> np.ndarray:
    """For each row the most of its marked places that rise in x and y alike."""
    order = np.argsort(np.where(on, x, np.int64(2**62)), axis=1, kind="stable")
    y, on = np.take_along_axis(y, order, axis=1), np.take_along_axis(on, order, axis=1)
    out = on.sum(axis=1)
    crossed = np.flatnonzero(((np.diff(y, axis=1) <= 0) & on[:, 1:]).any(axis=1))
    if len(crossed):
        y, n = y[crossed], out[crossed]
        best = np.zeros(y.shape, np.int64)
        for j in range(int(n.max())):
            before = np.where(y[:, :j] < y[:, j : j + 1], best[:, :j], 0)
            best[:, j] = np.where(j < n, before.max(axis=1, initial=0) + 1, 0)
        out[crossed] = best.max(axis=1)
    return out


def likeness(a: Sketch, b: Sketch) -> np.ndarray:
    """Share of the bins filled on either side, and of the digest, that agree and lie in one order; 1 for equal texts, 0 for an empty one and another."""
    filled = ((a.mark >= 0) | (b.mark >= 0)).sum(axis=1)
    chain = longest_chains(a.place, b.place, (a.mark == b.mark) & (a.mark >= 0))
    return (chain + (a.digest == b.digest)) / (filled + 1)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every whole text; one narrow pass. Null texts are empty, null doc_ids stay null, equal texts
    and repeated rows have equal fingerprints, an empty table gives an empty result, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sketch(b.column("text").to_pylist()).strings(), pa.string())], names=["doc_id", "fingerprint"])

    return plain_texts(docs).mapInArrow(lean(run), "doc_id long, fingerprint string")


def document_anchors(docs: DataFrame) -> DataFrame:
    """doc_id, place (code points) and hash of every anchor, for positional matching of texts by joins on the hash. Texts
    shorter than an anchor, null ones too, give no row; repeated rows give theirs again; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                text, at, h = anchors(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(text)), pa.array(at), pa.array(h.view(np.int64))], names=["doc_id", "place", "anchor"])

    return plain_texts(docs).mapInArrow(lean(run), "doc_id long, place long, anchor long")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, own, key, doc_id, text), each bucket sorted by doc_id and text within its partition, donors first.

    A bucket holds a range of ids. The document that comes next in descending order is the row before; for a bucket's
    first row that is its donor, the last document of the bucket before (of the last bucket for the first one). The
    bounds are ids that a hash chooses, one of ``BUCKET_ROWS`` while that gives at most ``MAX_BUCKETS``: 8 MB on the
    driver at most. Texts are shuffled once, and a partition's buckets go through sorting one after the other. Rows of
    one doc_id are in one bucket."""
    spark = docs.sparkSession
    keyed = plain_texts(docs).withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    found = keyed.agg(F.count("*").alias("n"), F.max("key").alias("top")).first()
    step = max(BUCKET_ROWS, -(-found["n"] // MAX_BUCKETS))
    chosen = keyed.where(F.pmod(F.xxhash64("key"), F.lit(step)) == 0).select("key").distinct().toArrow()["key"].to_numpy()
    shared = spark.sparkContext.broadcast(np.union1d(chosen, [found["top"] or 0]).astype(np.int64))

    @F.arrow_udf("array<long>")
    def places(key: pa.Array) -> pa.Array:
        """The bucket of an id; if the id is its bound, the bucket that it is the donor of too, counted from -1 down."""
        bounds, key = shared.value, key.to_numpy(zero_copy_only=False)
        at = np.searchsorted(bounds, key)
        last = bounds[at] == key
        both = np.stack([at, -1 - (at + 1) % len(bounds)], axis=1)[np.stack([np.ones(len(key), bool), last], axis=1)]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(1 + last)]), pa.int32()), pa.array(both, pa.int64()))

    rows = keyed.select("doc_id", "key", "text", F.explode(places("key")).alias("to"))
    own = F.col("to") >= 0
    placed = rows.select(F.when(own, F.col("to")).otherwise(-1 - F.col("to")).alias("bucket"), own.alias("own"), "key", "doc_id", "text")
    return placed.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "own", "key", "text")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text and the same text with its second half replaced by the start of the next document.

    The next document is the one with the next smaller doc_id, after the last the first. Null texts are empty and have
    an empty fingerprint; two empty texts are alike (1), an empty and another one are not (0). A text shorter than an
    anchor has itself as its only one. A null doc_id counts as smaller than all others, several in an order by hashes of
    their texts; rows with one doc_id follow each other in the order of their texts; an empty table gives an empty result; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = sketch([""])
        bucket, before, before_row = None, "", none
        for whole in batches:
            for b in slices(whole):
                texts, own = b.column("text").to_pylist(), b.column("own").to_pylist()
                table = sketch(texts)
                every = Sketch(*(np.concatenate([getattr(table, f), getattr(before_row, f), getattr(none, f)]) for f in ("mark", "place", "digest")))
                nexts, rows, last = [], [], b.num_rows  # the row that holds what came before this slice; the one after it is an empty text
                for i, at in enumerate(b.column("bucket").to_pylist()):
                    if at != bucket:
                        bucket, before, last = at, "", b.num_rows + 1
                    nexts.append(before)
                    rows.append(last)
                    before, last = texts[i], i
                before_row, after = every.take(np.array([last])), every.take(np.array(rows))
                keep = np.flatnonzero(own)
                edited = [(t := texts[i])[: len(t) - len(t) // 2] + nexts[i][: len(t) // 2] for i in keep.tolist()]
                mine, other = table.take(keep), sketch(edited)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(pa.array(keep)), pa.array([len(texts[i]) for i in keep.tolist()], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                        pa.array(mine.strings(), pa.string()), pa.array(other.strings(), pa.string()), pa.array(likeness(mine, other)), pa.array(likeness(mine, after.take(keep))),
                    ],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    return with_next(docs).select("bucket", "own", "doc_id", "text").mapInArrow(lean(run), SCHEMA)
