"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix with its transpose.

Rows of the matrix are distinct shingle sets. Columns are ordered by document frequency, counted over all documents in a
sketch of fixed size; of each row only as many of its rarest columns enter the first product as its size requires of any
set that is near enough. A block is the set of columns of one bucket: it accumulates what rows share and discards pairs
that sizes and places rule out. The survivors' exact overlaps come from a second product over whole sets.

Only components are asked for, so pairs inside one need no product: each column first proposes its most central row
against the others; what these links leave apart is proposed pair by pair in further rounds. The last round, which
leaves out no pair, always runs, whether or not an earlier one proposed any. Rows meet by column and class of size, so
that a frequent column makes no pairs of sets whose sizes or places rule each other out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from vellum.llm.common import U64, Words, as_row, grams, lean, materialize, mix, partitions, row_key, scratch, slices, texts as plain_texts

#: Words of a shingle; least Jaccard similarity in percent.
SHINGLE, PERCENT = 5, 80
#: Counters of the frequency sketch, as a power of two, and of those that one row of it carries.
SKETCH_BITS, PART_BITS = 22, 12
#: Ratio of the bounds of a class of sizes.
SIZE_STEP = 1.1
#: Rows of a column that the others meet, round by round; None: all.
PIVOTS: tuple[int | None, ...] = (1, 8, None)
#: Up to so many rows of (node, doc_id), 16 bytes each, texts are picked by a broadcast join; beyond, by a shuffle.
BROADCAST_ROWS = 500_000
#: Entries that a task of the first product holds before it passes on what repeats.
HELD = 3_000_000

SETS = "key long, kh long, doc_id long, n_shingles long, node long, part int, counts binary"
ENTRY = "bucket int, body binary"


def shingle_sets(col: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of every distinct shingle of each text, sorted by row, then shingle. A text of fewer words than a shingle has its whole sequence as one."""
    w = Words(col, fold=True)
    h = w.hashes()
    g = grams(h, n)
    at = np.flatnonzero(w.doc[n - 1 :] == w.doc[: len(g)]) if len(g) else np.zeros(0, np.int64)
    row, value = w.doc[at], g[at]
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        whole = np.array([mix(_whole(h[w.first[i] : w.first[i + 1]]))[0] for i in short.tolist()], U64)
        row, value = np.concatenate([row, short]), np.concatenate([value, whole])
        order = np.argsort(row, kind="stable")
        row, value = row[order], value[order]
    ends = [0, *np.cumsum(np.bincount(row, minlength=len(w.count))).tolist()]
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        value[a:b].sort()  # a text's own shingles: many small sorts cost far less than one large one
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _whole(h: np.ndarray) -> np.ndarray:
    out = U64(len(h))
    with np.errstate(over="ignore"):
        for x in h:
            out = out * U64(0xAF251AF3B0F025B5) + x
    return np.array([out ^ U64(0x5851F42D4C957F2D)], U64)


def set_ids(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, id) of each row's set: 64 bits of a strong digest of its sorted shingles, 0 for an empty set."""
    count = np.bincount(row, minlength=rows)
    ends = np.cumsum(count)
    body = value.astype("<u8").tobytes()
    ids = [int.from_bytes(hashlib.blake2b(body[8 * (e - c) : 8 * e], digest_size=8).digest(), "little", signed=True) if c else 0 for e, c in zip(ends.tolist(), count.tolist(), strict=True)]
    return count, np.array(ids, np.int64)


def _planes(a: np.ndarray) -> bytes:
    """Numbers of 32 bits by byte planes: small ones pack to almost nothing."""
    return zstandard.ZstdCompressor(level=1).compress(a.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unplanes(body: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(4, -1).T.copy().view("<i4").reshape(-1).astype(np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each text; at the end of the task, how often it has met the columns of each counter."""
    names = [x.split()[0] for x in SETS.split(", ")]
    counts = np.zeros(1 << SKETCH_BITS, np.int32)
    for whole in batches:
        for b in slices(whole):
            row, value = shingle_sets(b.column("text"))
            size, node = set_ids(row, value, b.num_rows)
            counts += np.bincount((value >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("kh"), b.column("doc_id"), pa.array(size, pa.int64()), pa.array(node), pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())], names=names)
    parts = counts.reshape(-1, 1 << PART_BITS)
    some = np.flatnonzero(parts.any(axis=1)).tolist()
    for i in range(0, len(some), 128):
        own = some[i : i + 128]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(own), pa.int64()) for _ in range(5)), pa.array(own, pa.int32()), pa.array([_planes(parts[k]) for k in own], pa.binary())], names=names)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, counts in zip(b.column("part").to_pylist(), b.column("counts").to_pylist(), strict=True):
            total[part] = total.get(part, 0) + _unplanes(counts)
    # a tier is the frequency's logarithm; what chance collisions explain is tier 0
    for part, counts in total.items():
        usual = np.median(counts)
        tier = np.where(counts <= usual + 6 * np.sqrt(usual) + 4, 0, np.log2(np.maximum(1, counts - usual)) * 4).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([tier.tobytes()], pa.binary())], names=["part", "tiers"])


def frequency_tiers(described: DataFrame) -> np.ndarray:
    """A tier of document frequency for every counter of the sketch: 4 MB, whatever the corpus.

    The tasks' counters are summed part by part, 1,024 parts of 4,096 counters, packed; the driver gets the tiers only."""
    sketches = described.where("part is not null").select("part", "counts")
    found = sketches.repartition(partitions(described.sparkSession), "part").mapInArrow(lean(_add), "part int, tiers binary").collect()
    tiers = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in found:
        tiers[r["part"] << PART_BITS : (r["part"] + 1) << PART_BITS] = np.frombuffer(r["tiers"], np.uint8)
    return tiers


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of its rarest columns a set of n shows: two near sets share one of these at least."""
    return n - -(-n * percent // 100) + 1


def _incidence(shared, percent: int, buckets: int):
    """Entries (column, row, size, place of the column in the row's order) to the bucket of the column. A slice that
    has a set twice sends it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiers = shared.value
        for whole in batches:
            for b in slices(whole):
                row, value = shingle_sets(b.column("text"))
                size, node = set_ids(row, value, b.num_rows)
                _, one = np.unique(node, return_index=True)
                chosen = np.zeros(b.num_rows, bool)
                chosen[one] = size[one] > 0
                on = chosen[row]
                row, value = row[on], value[on]
                tier = tiers[(value >> U64(64 - SKETCH_BITS)).astype(np.int64)]
                own = np.flatnonzero(np.diff(row, prepend=-1))
                count, shown = np.diff(np.append(own, len(row))), prefix_length(size, percent)[row[own]]
                first = [a + np.argsort(tier[a : a + n], kind="stable")[:k] for a, n, k in zip(own.tolist(), count.tolist(), shown.tolist(), strict=True)]
                at = np.concatenate(first) if first else np.zeros(0, np.int64)
                row, value = row[at], value[at]
                place = np.arange(len(at)) - np.repeat(np.cumsum(shown) - shown, shown)
                to = (value % U64(buckets)).astype(np.int64)
                by = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[by], np.arange(buckets + 1))
                rows = [(k, _pack(value[i], node[row[i]], size[row[i]], place[i])) for k in np.flatnonzero(np.diff(cut)).tolist() for i in [by[cut[k] : cut[k + 1]]]]
                cols = list(zip(*rows, strict=True)) or [[], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary())], names=["bucket", "body"])

    return run


def _pack(value: np.ndarray, node: np.ndarray, size: np.ndarray, place: np.ndarray) -> bytes:
    """Nodes are written once for the entries that follow each other."""
    new = np.ones(len(node), bool)
    new[1:] = node[1:] != node[:-1]
    first = np.flatnonzero(new)
    small = np.concatenate([np.diff(np.append(first, len(node))), size[first], place])
    return np.array([len(value), len(first)], np.int64).tobytes() + value.tobytes() + node[first].tobytes() + _planes(small)


def _unpack(body: bytes) -> tuple[np.ndarray, ...]:
    n, m = np.frombuffer(body, np.int64, 2).tolist()
    value, node = np.frombuffer(body, U64, n, 16), np.frombuffer(body, np.int64, m, 16 + 8 * n)
    small = _unplanes(body[16 + 8 * (n + m) :])
    run, size, place = small[:m], small[m : 2 * m], small[2 * m :]
    return value, np.repeat(node, run), np.repeat(size, run), place


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of columns that two or more different rows have. A column's entries stream through: what is held is one
    entry of each column and a run of new ones."""
    held = tuple(np.zeros(0, t) for t in (U64, np.int64, np.int64, np.int64))
    many = np.zeros(0, U64)  # columns that were passed on

    def settle(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        nonlocal held, many
        value, node, size, place = (np.concatenate(c) for c in zip(held, *parts, strict=True))
        order = np.lexsort((node, value))
        value, node, size, place = value[order], node[order], size[order], place[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (node[1:] != node[:-1])
        value, node, size, place = value[new], node[new], size[new], place[new]
        _, where, count = np.unique(value, return_inverse=True, return_counts=True)
        on = count[where] > 1
        if len(many):
            on |= many[np.minimum(np.searchsorted(many, value), len(many) - 1)] == value
        many = np.union1d(many, value[on])
        held = value[~on], node[~on], size[~on], place[~on]
        for at in range(0, int(on.sum()), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[on][at : at + 200_000]) for x in (value.view(np.int64), node, size, place)], names=["column", "node", "size", "place"])

    parts, n = [], 0
    for b in batches:
        for body in b.column("body").to_pylist():
            parts.append(_unpack(body))
            n += len(parts[-1][0])
            if n >= HELD:
                yield from settle(parts)
                parts, n = [], 0
    if parts:
        yield from settle(parts)


def _class(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(SIZE_STEP))).cast("int")


def open_rows(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of columns that have rows of two components or more, with ``part`` and the column's ``largest`` one."""
    own = lists.drop("part", "largest").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    counted = own.groupBy("column", "part").agg(F.count("*").alias("n"))
    several = counted.groupBy("column").agg(F.max_by("part", F.struct("n", "part")).alias("largest"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    return materialize(own.join(materialize(several, "open"), "column"), "marked")


def propose(out: DataFrame, some: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of rows of ``out`` and ``some`` that share a column and may be near, of different components.

    Pairs whose sizes or places rule out enough overlap are discarded: at the first column that two sets share, all they
    share lies from there on. That bounds the partner's size on either side, so that rows of a column meet by classes of
    sizes. Either side goes through a shuffle of its own, so that a frequent column can be split; none is gathered."""
    fields = lambda df, s, *more: df.select(F.col("column"), *(F.col(c).alias(f"{c}_{s}") for c in ("node", "size", "place", "part")), *more)
    size, rest = F.col("size"), F.col("size") - F.col("place")
    least = F.ceil(size * percent / 100)
    most = F.least(F.floor(size * 100 / percent), F.floor(rest * (100 + percent) / percent) - size)
    x = fields(out.where(least <= most), "x", F.explode(F.sequence(_class(least) - 1, _class(most) + 1)).alias("class"))  # logarithms are rounded: a class more on either side
    y = fields(some, "y", _class(size).alias("class"))
    need = F.ceil((F.col("size_x") + F.col("size_y")) * percent / (100 + percent))
    sizes = 100 * F.least("size_x", "size_y") >= percent * F.greatest("size_x", "size_y")
    places = F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y")) >= need
    pairs = x.join(y, ["column", "class"]).where((F.col("part_x") != F.col("part_y")) & sizes & places)
    return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def first_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """All rows of a column against its most central one, which shows the column earliest."""
    central = lists.groupBy("column").agg(F.min(F.struct("place", "node", "size")).alias("s")).select("column", "s.*")
    own = F.col("node").alias("part")
    return propose(lists.select("*", own), materialize(central, "pivots").select("*", own), percent)


def further_pairs(marked: DataFrame, pivots: int | None, percent: int) -> DataFrame:
    """The rows outside a column's largest component against its ``pivots`` most central rows, or all."""
    by = Window.partitionBy("column").orderBy("place", "node")
    some = marked if pivots is None else marked.withColumn("r", F.row_number().over(by)).where(F.col("r") <= pivots)
    return propose(marked.where("part <> largest"), some, percent)


def _check(percent: int):
    """Exact overlaps of whole sets, of the texts that come with the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        known: dict[int, np.ndarray] = {}

        def load(ids: list[int], bodies: list[bytes]) -> None:
            new = {i: x for i, x in zip(ids, bodies, strict=True) if i not in known}
            if len(known) + len(new) > 2000:
                known.clear()
                new = dict(zip(ids, bodies, strict=True))
            if new:
                row, value = shingle_sets(pa.array([opener.decompress(x).decode() for x in new.values()], pa.string()))
                known.update(zip(new, np.split(value, np.cumsum(np.bincount(row, minlength=len(new)))[:-1]), strict=True))

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                x = whole.slice(at, 500)
                a, b = x.column("a").to_pylist(), x.column("b").to_pylist()
                load(a + b, x.column("text_a").to_pylist() + x.column("text_b").to_pylist())
                near = []
                for i, j in zip(a, b, strict=True):
                    u, v = known[i], known[j]
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    near.append(100 * both >= percent * (len(u) + len(v) - both))
                yield pa.RecordBatch.from_arrays([x.column("a").filter(pa.array(near)), x.column("b").filter(pa.array(near))], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, part): the smallest node that each node of the edges reaches, itself included, by alternating large-star and small-star steps.

    Every step is a join and a minimum by node with a map-side part; no node's neighbours are gathered. Ends when a
    round changes nothing."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            found = edges.groupBy("u").agg(F.min("v").alias("part")).withColumnRenamed("u", "node")
            return found.unionByName(found.select(F.col("part").alias("node"), "part").distinct())
        seen = state


def near_components(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(sets, parts): key, kh, doc_id, n_shingles and node of every document; node and component of the nodes that have links."""
    with scratch(docs.sparkSession):
        return _near_components(docs, percent)


def _near_components(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    n = partitions(spark)
    texts = plain_texts(docs)
    described = materialize(_named(docs).mapInArrow(lean(_describe), SETS), "sets", lasting=True)
    sets = described.where("part is null").drop("part", "counts")
    shared = spark.sparkContext.broadcast(frequency_tiers(described))
    lists = texts.select("text").mapInArrow(lean(_incidence(shared, percent, n)), ENTRY).repartitionById(n, "bucket").mapInArrow(lean(_lists), "column long, node long, size long, place long")
    lists = materialize(lists, "columns")
    homes = sets.where("node <> 0").groupBy("node").agg(F.min("key").alias("key"))
    parts, bodies, checked, marked = spark.createDataFrame([], "node long, part long"), None, None, None
    for pivots in PIVOTS:
        if checked is None:
            proposed = materialize(first_pairs(lists, percent), "proposed")
        else:
            if marked is None:  # components are new
                lists = marked = open_rows(lists, parts)
            proposed = materialize(further_pairs(marked, pivots, percent).join(checked, ["a", "b"], "left_anti"), "proposed")
        checked = proposed if checked is None else checked.unionByName(proposed)
        if proposed.isEmpty():  # what pivots leave out may still be near: only the last round is exact
            continue
        wanted = proposed.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if bodies is not None:
            wanted = wanted.join(bodies.select("node"), "node", "left_anti")
        more = materialize(_packed(docs, materialize(homes.join(wanted, "node"), "wanted")), "bodies")
        bodies = more if bodies is None else bodies.unionByName(more)
        pairs = proposed.join(bodies.select(F.col("node").alias("b"), F.col("body").alias("text_b")), "b").join(bodies.select(F.col("node").alias("a"), F.col("body").alias("text_a")), "a")
        near = materialize(pairs.select("a", "b", "text_a", "text_b").mapInArrow(lean(_check(percent)), "a long, b long"), "near")
        if not near.isEmpty():
            parts, marked = merged(parts, near), None
    return sets, parts


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links, found among the components that these join."""
    side = lambda c: parts.select(F.col("node").alias(c), F.col("part").alias(f"part_{c}"))
    joined = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b"))
    more = components(joined).select(F.col("node").alias("part"), F.col("part").alias("new"))
    old = parts.join(more, "part", "left").select("node", F.coalesce("new", "part").alias("part"))
    return materialize(old.unionByName(more.select(F.col("part").alias("node"), F.col("new").alias("part")).join(parts, "node", "left_anti")), "parts", lasting=True)


def _named(docs: DataFrame) -> DataFrame:
    """(key, kh, doc_id, text): key and kh, a hash of the text, name a row."""
    return plain_texts(docs).select(row_key(F.col("doc_id"), F.col("text")).alias("key"), F.xxhash64("text").alias("kh"), "doc_id", "text")


def _packed(docs: DataFrame, homes: DataFrame) -> DataFrame:
    """(node, body): the compressed text of a document that stands for each node of ``homes`` (node, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for b in slices(whole):
                _, node = set_ids(*shingle_sets(b.column("text")), b.num_rows)
                mine = np.flatnonzero(node == b.column("node").to_numpy(zero_copy_only=False))  # several texts may share a doc_id
                bodies = b.column("text").take(pa.array(mine)).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(node[mine]), pa.array([packer.compress(t.encode()) for t in bodies], pa.binary())], names=["node", "body"])

    side = F.broadcast(homes) if homes.count() <= BROADCAST_ROWS else homes
    named = _named(docs).select("key", "text").join(side, "key")
    return named.select("node", "text").mapInArrow(lean(run), "node long, body binary").dropDuplicates(["node"])


def with_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, kh, doc_id, n_shingles, node, component_id, first) of every document; see ``jaccard_components``.

    ``first``: whether the row's key and kh are those of the component's first row, that of the smallest doc_id, then
    of the smallest kh; a null doc_id is the last. What a component or a node shares is a table of its own before it
    is joined to many rows, so that a large group can be split."""
    sets, parts = near_components(docs, percent)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "kh")
    by_node = sets.where("node <> 0").groupBy("node").agg(F.min(rank).alias("least"), F.count("*").alias("n")).join(parts, "node", "left")
    by_part = materialize(by_node.where("part is not null").groupBy("part").agg(F.min("least").alias("head")), "heads")
    heads = by_node.join(by_part, "part", "left").where("n > 1 or part is not null").select("node", F.coalesce("head", "least").alias("head"))
    joined = sets.join(materialize(heads, "labels"), "node", "left")
    first = F.coalesce((F.col("head.key") == F.col("key")) & (F.col("head.kh") == F.col("kh")), F.lit(True))
    return joined.select("key", "kh", "doc_id", "n_shingles", "node", F.coalesce("head.doc_id", "doc_id").alias("component_id"), first.alias("first"))


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """For each document the size of its shingle set and the smallest doc_id that links reach from it, itself included.

    Two documents link when their sets have a Jaccard similarity of ``percent`` or more, exactly: equal sets are one
    node, all pairs of nodes that may link are either checked on whole sets or already joined by other links. Null and
    empty texts, and such of white space only, have an empty set and link with nothing; a text under a shingle's length
    has its whole as its only shingle. Repeated rows link with each other. A null doc_id is never the smallest. An empty
    table gives an empty result; other columns are ignored."""
    return with_components(docs, percent).select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with its columns: that of the smallest doc_id, then of the smallest text hash.

    A null doc_id stays only where no other document of its component has one. Rows that repeat the doc_id and text of
    the one that stays are one document, of which one row stays. Documents without words (null, empty or white space)
    have no component and all stay, repeated ones too. Very long texts are taken whole. An empty table stays empty.
    Rows travel in one column, so that names of the table's columns may be any."""
    found = materialize(with_components(docs, percent).where("node <> 0"), "found")
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = as_row(docs).withColumn("key", row_key(F.col("row.doc_id"), text)).withColumn("kh", F.xxhash64(text))
    kept = rows.join(found.where("not first").select("key", "kh").distinct(), ["key", "kh"], "left_anti")
    again = materialize(found.where("first").groupBy("key", "kh").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "again")
    if not again.isEmpty():
        order = F.row_number().over(Window.partitionBy("key", "kh").orderBy(F.to_json("row")))
        one = kept.join(again, ["key", "kh"]).withColumn("r", order).where("r = 1").drop("r")
        kept = kept.join(again, ["key", "kh"], "left_anti").unionByName(one)
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
