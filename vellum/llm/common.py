"""Shared plumbing of the training-data operators: shared storage, Arrow slicing, vectorised words and hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of text that one numpy pass takes at once; a longer single text makes a pass of its own.
SLICE_BYTES = 4 << 20
#: Bytes of a batch that Spark sends to Python.
BATCH_BYTES = 8 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where they are one process, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="vellum-checkpoint-")
        sc.setCheckpointDir(named)
    return named


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


_SCRATCH: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go at the end, but for lasting ones: for work whose result needs them no more."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            _remove(spark, path)


def materialize(df: DataFrame, name: str = "t", lasting: bool = False) -> DataFrame:
    """Cut the lineage of ``df``: write it once as Parquet in the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation. The table goes when the driver ends, or with the
    ``scratch`` around it if it is not ``lasting``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/vellum/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if _SCRATCH and not lasting:
        _SCRATCH[-1].append(path)
    else:
        atexit.register(_remove, spark, path)
    return spark.read.schema(schema).parquet(path)


_TABLES: dict[tuple[str, str], object] = {}


def kept(kind: str, path: str, make: Callable[[str], object]) -> object:
    """A large object of a worker, such as a vocabulary's automaton; a worker holds one at a time, between tasks too."""
    if (kind, path) not in _TABLES:
        _TABLES.clear()
        _TABLES[kind, path] = make(path)
    return _TABLES[kind, path]


def trim() -> None:
    """Give freed memory back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def unburden(keep: str = "") -> None:
    """Drop the large objects of other operators."""
    if any(kind != keep for kind, _ in _TABLES):
        _TABLES.clear()
        gc.collect()
        trim()


def lean(run: Callable, keep: str = "") -> Callable:
    """A task's function that starts without the large objects of other operators and ends without its own garbage."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unburden(keep)
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of a table of documents, null texts as empty ones, to be sent to Python in bounded batches."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


#: Keys of rows without a doc_id lie below this, real doc_ids at or above it.
NO_ID = -(2**62)


def row_key(doc_id: Column, text: Column) -> Column:
    """The doc_id to order and deal rows by; a null one gives a number below all others, by a hash of the text, so that
    rows without an id are neither one group nor one document."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63)) + F.xxhash64(text).bitwiseAND(F.lit(2**62 - 1)))


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts by bytes, not by rows alone, as a task holds a few of them at once: the session's
    limit is lowered, unless it is lower already. It has to last, as the batches are made when a result is read."""
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(_LIMIT) or "")
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


def as_row(docs: DataFrame) -> DataFrame:
    """The table with each row in one column, so that no name of it can clash with those of an operator."""
    return docs.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("row"))


def from_row(rows: DataFrame, docs: DataFrame, changed: Column, text: Column) -> DataFrame:
    """The columns of ``docs`` again; where ``changed``, with another text, and n_chars after it."""
    new = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    own = lambda c: F.col("row").getField(c)
    return rows.select(*((F.when(changed, new[c]).otherwise(own(c)) if c in new else own(c)).alias(c) for c in docs.columns))


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions, which the cluster sizes to its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of at most ``max_bytes`` of text (or one row)."""
    col = pc.fill_null(batch.column(column), "")
    size = pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at, n = 0, batch.num_rows
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(col: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without a copy; null counts as empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    body = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return body, offsets - lo


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_TABLE = np.random.default_rng(20240613).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_M = U64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate([[U64(1)], np.full(255, _M, U64)]), dtype=U64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every bit of a 64-bit value over all bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.concatenate([[U64(1)], np.full(2 * n, _M, U64)]), dtype=U64)
    return _POWERS


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts: start and end byte, document row and 64-bit hash of each."""

    def __init__(self, col: pa.Array, fold: bool = False):
        self.data, self.offsets = raw(col)
        n = len(self.data)
        solid = ~_SPACE[self.data]
        before = np.zeros(n, bool)
        before[1:] = solid[:-1]
        inner = self.offsets[:-1]
        before[inner[inner < n]] = False
        self.starts = np.flatnonzero(solid & ~before)
        after = np.zeros(n, bool)
        after[:-1] = solid[1:]
        last = self.offsets[1:] - 1
        after[last[(last >= 0) & (np.diff(self.offsets) > 0)]] = False
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.doc = np.searchsorted(self.offsets[1:], self.starts, side="right")
        self.count = np.bincount(self.doc, minlength=len(col)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.solid, self.fold = solid, fold

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, U64)
        body = self.data[self.solid]
        length = self.ends - self.starts
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])
        inside = np.arange(len(body), dtype=np.int64) - np.repeat(begin, length)
        terms = (_FOLDED if self.fold else _TABLE)[body] * _powers(int(length.max()))[inside]
        return mix(np.add.reduceat(terms, begin) + length.astype(U64))


def grams(h: np.ndarray, n: int, multiplier: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive values, over the slice as one sequence (callers drop runs that cross texts)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out, mult = np.zeros(m, U64), U64(multiplier)
    for j in range(n):
        out = out * mult + h[j : j + m]
    return mix(out)
