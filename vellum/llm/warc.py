"""A content-addressed WARC archive.

Payload bytes are stored once under a strong digest, the exact headers of each record apart from them. Reading joins the
two, checks the digests and gives the records back, byte for byte.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum.llm.common import bound_batches, lean, materialize

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads under this many bytes are always stored as responses; date of the records (the table has none).
MIN_BYTES, DATE = 0, "1970-01-01T00:00:00Z"

RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(url: str | None) -> str:
    """A URL as a header's value: line ends as percent codes, which name the same characters."""
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def record_head(page_id: int | None, url: str | None, n_bytes: int, sha1: str, first: int | None, revisit: bool) -> bytes:
    """All bytes of a record before its payload: the WARC header and the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {one_line(url)}"]
    lines += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {REVISIT_PROFILE}"] if revisit else []
    lines += [f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else n_bytes)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one whole record; raises ValueError if its lengths do not fit."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    n = int(headers["Content-Length"])
    if version != VERSION or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"not a {VERSION} record of the length it states")
    _, _, payload = rest[:n].partition(b"\r\n\r\n")
    return headers, payload


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct payload of a batch once, compressed, with the smallest page_id that has it."""
    packer = zstandard.ZstdCompressor(level=3)
    for b in batches:
        first: dict[bytes, tuple[int | None, bytes]] = {}
        for page_id, body in zip(b.column("page_id").to_pylist(), b.column("html").cast(pa.binary()).to_pylist(), strict=True):
            key = hashlib.sha256(body := body or b"").digest()
            known = first.get(key, (None, body))[0]
            first[key] = (page_id if known is None else known if page_id is None else min(known, page_id), body)
        ids, bodies = zip(*first.values(), strict=True) if first else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.binary()), pa.array(map(len, bodies), pa.int64()), pa.array(ids, pa.int64()), pa.array(map(packer.compress, bodies), pa.binary())], names=["sha256", "n_bytes", "first", "packed"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bodies = [x or b"" for x in b.column("html").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(map(len, bodies), pa.int64()), pa.array(map(sha1_base32, bodies), pa.string()), pa.array([hashlib.sha256(x).digest() for x in bodies], pa.binary())],
            names=["page_id", "url", "n_bytes", "sha1", "sha256"],
        )


def write_archive(pages: DataFrame, min_bytes: int = MIN_BYTES) -> tuple[DataFrame, DataFrame]:
    """Write the archive to the shared folder; returns its two tables.

    ``payloads`` (sha256, packed, n_bytes, first): each distinct payload once, compressed, with the smallest page_id.
    Copies meet in their batch and in a map-side aggregation before the shuffle, so a payload that a third of the pages
    share sends one row for each task. Payloads are compressed once and travel once; the second pass over the pages takes
    digests only. ``heads`` (page_id, sha256, revisit, head): the exact header bytes of every record."""
    fields = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    bound_batches(pages.sparkSession)
    packed = fields.select("page_id", "html").mapInArrow(lean(_payloads), "sha256 binary, n_bytes long, first long, packed binary")
    payloads = materialize(packed.groupBy("sha256", "n_bytes").agg(F.min("first").alias("first"), F.min("packed").alias("packed")), "payloads")
    digested = fields.mapInArrow(lean(_digests), "page_id long, url string, n_bytes long, sha1 string, sha256 binary")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [record_head(*r) for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "n_bytes", "sha1", "first", "revisit")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("sha256"), b.column("revisit"), pa.array(rows, pa.binary())], names=["page_id", "sha256", "revisit", "head"])

    light = digested.join(payloads.select("sha256", "first"), "sha256")
    revisit = F.coalesce((F.col("page_id") > F.col("first")) & (F.col("n_bytes") >= min_bytes), F.col("first").isNotNull() & (F.col("n_bytes") >= min_bytes))
    return payloads, materialize(light.withColumn("revisit", revisit).mapInArrow(lean(heads), "page_id long, sha256 binary, revisit boolean, head binary"), "heads")


def read_archive(payloads: DataFrame, heads: DataFrame) -> DataFrame:
    """Rebuild every record of the archive: (page_id, record, payload), the payload checked against its digests."""

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for b in batches:
            records, bodies, last, body = [], [], None, b""
            for head, revisit, digest, packed, n in zip(*(b.column(c).to_pylist() for c in ("head", "revisit", "sha256", "packed", "n_bytes")), strict=True):
                if digest != last:
                    body, last = unpacker.decompress(packed, max_output_size=max(n, 1)), digest
                    if hashlib.sha256(body).digest() != digest:
                        raise ValueError("a stored payload does not have its digest")
                records.append(head + (b"" if revisit else body) + b"\r\n\r\n")
                bodies.append(body)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(records, pa.binary()), pa.array(bodies, pa.binary())], names=["page_id", "record", "payload"])

    return heads.join(payloads.select("sha256", "packed", "n_bytes"), "sha256").mapInArrow(lean(rebuild), "page_id long, record binary, payload binary")


def describe_records(records: DataFrame) -> DataFrame:
    """What each record says of itself: length and digest of the full payload, type, and the page that a revisit refers to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for record, payload in zip(b.column("record").to_pylist(), b.column("payload").to_pylist(), strict=True):
                headers, own = parse_record(record)
                kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if sha1_base32(payload) != digest or (kind == "response" and own != payload):
                    raise ValueError("a record's payload does not have its digest")
                refers = headers.get("WARC-Refers-To", "")[len("<urn:page:") : -1]
                rows.append((len(payload), digest, kind, int(refers) if refers else None))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True))], names=[x.split()[0] for x in RECORD.split(", ")])

    return records.mapInArrow(lean(run), RECORD)


INDEX = "page_id long, file string, offset long, length long"


def write_files(records: DataFrame, folder: str) -> DataFrame:
    """Write the records of ``read_archive`` as .warc.gz files, one for each task, each record a gzip member of its own.

    Returns the index: (page_id, file, offset, length) of every record, repeated ones too; no records give no rows. ``folder``: a URI that all executors reach by
    pyarrow's file systems. A file gets its name when it is whole; a task that is run again writes one of another name,
    which the index names alone, as it is written with the task's result. Records of one page_id may be several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        place, rows = 0, []
        with store.open_output_stream(f"{at}/.{name}", compression=None) as out:
            for b in batches:
                for page_id, record in zip(b.column("page_id").to_pylist(), b.column("record").to_pylist(), strict=True):
                    member = gzip.compress(record, 6, mtime=0)
                    out.write(member)
                    rows.append((page_id, name, place, len(member)))
                    place += len(member)
        if not rows:
            store.delete_file(f"{at}/.{name}")
            return
        store.move(f"{at}/.{name}", f"{at}/{name}")
        for i in range(0, len(rows), 50_000):
            cols = zip(*rows[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

    return materialize(records.select("page_id", "record").mapInArrow(lean(run), INDEX), "index", lasting=True)


def read_files(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """(page_id, record) of every record that the index names, read from the files member by member; a null page_id stays
    null, an index of no rows gives none, and a file that is gone is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        now, source = None, None
        for b in batches:
            records = []
            for name, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if name != now:
                    now, source = name, store.open_input_file(f"{at}/{name}")
                records.append(zlib.decompress(source.read_at(length, offset), 31))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(records, pa.binary())], names=["page_id", "record"])

    near = index.repartition("file").sortWithinPartitions("file", "offset")
    return near.mapInArrow(lean(run), "page_id long, record binary")


def archive_round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write every page as a WARC record, read the archive back, and describe each record from what was read.

    Null html is an empty payload, a null url an empty one. Of records with equal payloads of at least ``min_bytes`` the
    one with the smallest page_id is the response, the others revisit it; rows that repeat that page_id are responses
    too; a null page_id is never the smallest, and is a response if no other page has its payload. An empty table gives
    an empty archive; other columns are ignored."""
    return describe_records(read_archive(*write_archive(pages, min_bytes)))
