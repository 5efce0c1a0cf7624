"""The trie of conversations' prefixes: a node for every distinct sequence of first turns, with figures of its subtree.

Each conversation becomes a string of digests, one of each of its prefixes (16 bytes of SHA-256 over the former and the
turn), so that a digest names a node. Conversations are sorted by their strings over all tasks, in blocks, equal ones
split between blocks if need be. The turns that neighbours have in common (LCP) are an array whose Cartesian tree, equal
values merged, is the trie without its nodes of one child: a node spans the conversations between the nearest smaller
values on both sides. Each block finds these by a stack, for all its values at once; only its prefix and suffix minima
have their nearest smaller value in another block. These minima, a few pieces a block, are what blocks hand on: an array
of pieces is swept like an array of conversations, in rounds of ``FAN`` blocks, until one block is left. Nodes carry sums
over their interval; the depths that a node spans become rows at the end, where each row finds its parent by digest.

Null roles and texts are empty; turns without a number come first; equal numbers in the order of role and of the text's
first 64 characters, then of the digest, so that repeated rows stay repeated. Rows without a conv_id are left out, as
such has no decimal form. Empty tables give no nodes, not even a root. Very long texts count by their digest, and a
conversation is a row of 16 bytes a turn. The ids that end at a node are hashed as they stream by; of one node that is
one task's work, as a SHA-256 cannot be put together from parts. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vellum.llm.common import lean, materialize, partitions

#: Blocks whose pieces one task takes in a round.
FAN = 256
#: Bytes of a digest; conversation ids of a chunk of those that end at a node.
D, CHUNK = 16, 100_000
#: Rows of a batch that a task gives out.
ROWS = 20_000
#: Parents of more children are sent to all tasks, if they are no more than so many, so that no task gets all children of one.
MANY_KIDS, SENT = 200, 500_000

_ELEMENT = "block long, seq long, lcp int, depth int, key binary, sizes array<long>, n long, least long, saved long, leaves long, kids long, ends binary"
#: ``what``: 0 a node, 1 a piece, 2 a chunk of the ids that end at a node.
_SWEPT = f"what int, top int, parent binary, ids binary, {_ELEMENT}"
_TYPES = pa.schema([("what", pa.int32()), ("top", pa.int32()), ("parent", pa.binary()), ("ids", pa.binary()), ("block", pa.int64()), ("seq", pa.int64()), ("lcp", pa.int32()), ("depth", pa.int32()), ("key", pa.binary()), ("sizes", pa.list_(pa.int64())), ("n", pa.int64()), ("least", pa.int64()), ("saved", pa.int64()), ("leaves", pa.int64()), ("kids", pa.int64()), ("ends", pa.binary())])


def common_turns(a: bytes, b: bytes) -> int:
    """How many first turns two conversations share: as a digest stands for a prefix, by bisection."""
    lo, hi = 0, min(len(a), len(b)) // D
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[D * (mid - 1) : D * mid] == b[D * (mid - 1) : D * mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Node:
    """An interval of conversations that share ``depth`` turns, from one whose LCP with the one before is ``lcp``.

    ``sizes``: bytes of the first 0, 1, ... turns' texts; ``saved``: bytes that each but the first shares with the one before it."""

    __slots__ = ("lcp", "depth", "key", "sizes", "n", "least", "saved", "leaves", "kids", "ends")

    def __init__(self, lcp, depth, key, sizes, n=0, least=None, saved=0, leaves=0, kids=0, ends=None):
        self.lcp, self.depth, self.key, self.sizes, self.n, self.least, self.saved, self.leaves, self.kids, self.ends = lcp, depth, key, sizes, n, least, saved, leaves, kids, ends

    def add(self, other: Node) -> None:
        """Take in the interval that follows."""
        if not self.n:
            self.lcp, self.n, self.least, self.saved, self.leaves = other.lcp, other.n, other.least, other.saved, other.leaves
        elif other.n:
            self.saved += other.saved + int(other.sizes[other.lcp])
            self.n, self.least, self.leaves = self.n + other.n, min(self.least, other.least), self.leaves + other.leaves


class Sweep:
    """Nearest smaller values of the LCP array by a stack, and the nodes between them.

    Open at both ends: a node that may go on in the block before or after stays, as a piece."""

    def __init__(self, closed: bool):
        self.stack: list[Node] = []
        self.left: list[Node] = []  # pieces at the prefix minima, all but the last
        self.closed = closed

    def _pop(self, lcp: int) -> Iterator[tuple[int, Node]]:
        """Ends the nodes deeper than ``lcp``; gives each with the depth of its parent."""
        while self.stack and self.stack[-1].depth > lcp:
            node = self.stack.pop()
            below = self.stack[-1].depth if self.stack else -1
            if not self.stack and not self.closed:  # may have begun in the block before
                self.left.append(node)
                self.stack.append(Node(lcp, lcp, node.key, node.sizes))
                return
            parent = max(lcp, below)
            if parent > below:
                self.stack.append(Node(node.lcp, parent, node.key, node.sizes))
            node.leaves = node.leaves or 1
            yield parent, node
            if self.stack:
                self.stack[-1].add(node)
                self.stack[-1].kids += 1

    def take(self, node: Node) -> Iterator[tuple[int, Node]]:
        """The next interval, with its ``lcp``; gives the nodes that it ends."""
        yield from self._pop(node.lcp)
        if self.stack and self.stack[-1].depth == node.depth:
            top = self.stack[-1]
            top.add(node)
            top.kids += node.kids
            if node.ends is not None:
                top.ends = node.ends
        else:
            self.stack.append(node)

    def finish(self) -> Iterator[tuple[int, Node]]:
        yield from self._pop(-1)

    def pieces(self) -> list[Node]:
        return self.left + self.stack


class Rows:
    """Collects rows and gives them out in batches."""

    def __init__(self):
        self.rows: list[tuple] = []

    def node(self, parent: int, x: Node) -> None:
        cut = lambda d: None if d < 0 else x.key[D * (d - 1) : D * d] if d else b""
        self.rows.append((0, parent + 1, cut(parent), None, None, None, None, x.depth, cut(x.depth), [0 if d < 0 else int(x.sizes[d]) for d in range(parent, x.depth + 1)], x.n, x.least, x.saved, x.leaves, x.kids, x.ends))

    def piece(self, block: int, seq: int, x: Node) -> None:
        self.rows.append((1, None, None, None, block, seq, x.lcp, x.depth, x.key[: D * x.depth], [int(s) for s in x.sizes[: x.depth + 1]], x.n, x.least, x.saved, x.leaves, x.kids, x.ends))

    def chunk(self, key: bytes, block: int, seq: int, ids: list[int]) -> None:
        self.rows.append((2, None, None, ",".join(map(str, ids)).encode(), block, seq, None, None, key, None, None, None, None, None, None, None))

    def flush(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), _TYPES, strict=True)], schema=_TYPES)
            self.rows = []


def _hashed(ids: list[int]) -> bytes:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest().encode()


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweeps a block of sorted conversations: (block, conv_id, key, sizes) to nodes, pieces and chunks of ids.

    The ids of equal conversations are hashed here if the run of them lies inside the block, else handed on in chunks."""
    sweep, out = Sweep(closed=False), Rows()
    before, block, seq = None, 0, 0
    ids: list[int] = []  # of the run of equal conversations so far
    owner: Node | None = None
    opened = False  # the run began in this block and not at its start
    for batch in batches:
        for block, conv, key, sizes in zip(*(batch.column(c).to_pylist() for c in ("block", "conv_id", "key", "sizes")), strict=True):
            if before is not None and key == before:
                lcp = len(key) // D
                if len(ids) >= CHUNK:  # too many to wait for: hand them on
                    out.chunk(key[-D:], block, seq, ids)
                    seq, ids, opened = seq + 1, [], False
            else:
                if before is None:
                    lcp = 0
                else:
                    lcp = common_turns(before, key)
                    if opened:
                        owner.ends = _hashed(ids)
                    else:
                        out.chunk(before[-D:], block, seq, ids)
                        seq += 1
                ids, opened = [], before is not None
            node = Node(lcp, len(key) // D, key, sizes, 1, conv)
            for parent, done in sweep.take(node):
                out.node(parent, done)
            owner = sweep.stack[-1]
            ids.append(conv)
            before = key
        yield from out.flush(ROWS)
    if before is not None:
        out.chunk(before[-D:], block, seq, ids)
        for i, x in enumerate(sweep.pieces()):
            out.piece(block, i, x)
    yield from out.flush()


def _joined(closed: bool):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sweeps the pieces of blocks that follow each other; LCPs between blocks come from the strings at their edges."""
        sweep, out, before, at = Sweep(closed), Rows(), None, None
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["block"], r["seq"]))
        for r in rows:
            if r["block"] != at:
                lcp = 0 if before is None else common_turns(before, r["key"])
            else:
                lcp = r["lcp"]
            at = r["block"]
            if r["n"]:
                for parent, done in sweep.take(Node(lcp, r["depth"], r["key"], r["sizes"], r["n"], r["least"], r["saved"], r["leaves"], r["kids"], r["ends"])):
                    out.node(parent, done)
            before = r["key"]
            yield from out.flush(ROWS)
        if closed:
            for parent, done in sweep.finish():
                out.node(parent, done)
        else:
            for i, x in enumerate(sweep.pieces()):
                out.piece(key[0].as_py(), i, x)
        yield from out.flush()

    return run


def _family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations as strings of digests, each with the bytes of its texts up to every turn."""
    for batch in batches:
        ids, keys, sizes = [], [], []
        for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
            state, key, sums = b"", [], [0]
            for t in turns:
                state = hashlib.sha256(state + t["digest"]).digest()[:D]
                key.append(state)
                sums.append(sums[-1] + t["size"])
            ids.append(conv)
            keys.append(b"".join(key))
            sizes.append(sums)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.list_(pa.int64()))], ["conv_id", "key", "sizes"])


def _turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn with what orders it, its digest and size) of the rows that have a conv_id; whole texts go no further."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text")).where("conv_id is not null")
    told = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", F.substring("text", 1, 64).alias("start"), F.unhex(F.sha2(told.cast("binary"), 256)).alias("digest"), F.octet_length("text").alias("size"))
    return rows.select("conv_id", turn.alias("t"))


def conversation_strings(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, sizes) of the conversations as they are."""
    own = _turn_rows(conversations).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return own.mapInArrow(lean(_family), "conv_id long, key binary, sizes array<long>")


def rebuilt_strings(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, sizes) of conversations rebuilt: each begins with the first turns of the one whose id ends its row of
    five, as many as a checksum of its own id says, and goes on with its own turns after as many."""
    g = F.col("conv_id") - F.col("conv_id") % 5
    families = _turn_rows(conversations).groupBy(g.alias("g")).agg(F.collect_list(F.struct("conv_id", "t")).alias("all"))
    own = lambda c: F.array_sort(F.transform(F.filter("all", lambda x: x["conv_id"] == c), lambda x: x["t"]))
    families = families.withColumn("base", own(F.col("g"))).withColumn("conv_id", F.explode(F.array_distinct(F.transform("all", lambda x: x["conv_id"]))))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    turns = families.select("conv_id", F.slice("base", F.lit(1), h).alias("head"), own(F.col("conv_id")).alias("own"), h.alias("h"))
    turns = turns.select("conv_id", F.concat("head", F.expr("slice(own, h + 1, greatest(size(own), 1))")).alias("turns"))
    return turns.mapInArrow(lean(_family), "conv_id long, key binary, sizes array<long>")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of ids in order, of one node after another, to the hash of each node's."""
    at, state, keys, ends = None, None, [], []
    for batch in batches:
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if at is None or key != at:
                if at is not None:
                    keys.append(at)
                    ends.append(state.hexdigest())
                at, state = key, hashlib.sha256(ids)
            else:
                state.update(b"," + ids)
    if at is not None:
        keys.append(at)
        ends.append(state.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.string())], ["key", "met"])


def _with_parents(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Adds ``parent_least``, null for the root."""
    large, small = parents.where(F.col("kids") > MANY_KIDS).drop("kids"), parents.where(F.col("kids") <= MANY_KIDS).drop("kids")
    if large.count() > SENT:
        return nodes.join(parents.drop("kids"), "parent", "left")
    known = nodes.join(F.broadcast(large), "parent", "left")
    return known.where("parent is null or parent_least is not null").unionByName(known.where("parent is not null and parent_least is null").drop("parent_least").join(small, "parent", "left"))


def prefix_trie(strings: DataFrame, fan: int = FAN) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    spark = strings.sparkSession
    strings = materialize(strings, "strings")
    blocks = partitions(spark)
    ordered = strings.repartitionByRange(blocks, "key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("block", F.spark_partition_id().cast("long"))
    swept = materialize(ordered.select("block", "conv_id", "key", "sizes").mapInArrow(lean(_block), _SWEPT), "swept")
    nodes, pieces, chunks = swept.where("what = 0"), swept.where("what = 1"), swept.where("what = 2")
    while True:
        last = blocks <= fan
        joined = pieces.select((F.lit(0) if last else F.floor(F.col("block") / fan)).cast("long").alias("g"), *pieces.columns).groupBy("g").applyInArrow(_joined(last), _SWEPT)
        joined = materialize(joined, "joined")
        nodes = nodes.unionByName(joined.where("what = 0"))
        if last:
            break
        pieces, blocks = joined.where("what = 1"), -(-blocks // fan)
    met = chunks.repartition(partitions(spark), "key").sortWithinPartitions("key", "block", "seq").select("key", "ids").mapInArrow(lean(_digest), "key binary, met string")
    nodes = nodes.select("top", "parent", "depth", "key", "sizes", "n", "least", "saved", "leaves", "kids", F.col("ends").cast("string").alias("ends"))
    parents = nodes.where("kids > 0").select(F.col("key").alias("parent"), F.col("least").alias("parent_least"), "kids")
    rows = _with_parents(nodes.join(met, "key", "left"), parents).select("*", F.explode(F.sequence("top", "depth")).alias("d"))
    end, deepest = F.coalesce("ends", "met", F.sha2(F.lit("").cast("binary"), 256)), F.col("d") == F.col("depth")
    return rows.select(
        F.col("least").alias("conv_id"), F.col("d").cast("long").alias("depth"), F.when(F.col("d") > F.col("top"), F.col("least")).otherwise(F.col("parent_least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(deepest, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * F.element_at("sizes", F.col("d") - F.col("top") + 1)).alias("saved_tokens"), F.when(deepest, end).otherwise(F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return prefix_trie(rebuilt_strings(conversations))
