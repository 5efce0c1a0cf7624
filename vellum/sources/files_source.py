"""Document files as a data source: ``spark.read.format("vellum_files").load(folder)``, and the same as a stream.

Columns: path, name, kind (the ending, lower-case), bytes, text, error_code, error_message, with the rules of
``sources.files``. The driver lists one folder after the other and deals files out by size; a folder below the given one
whose files one task may read goes by its name alone, and its task lists it again, so that the driver does not hold
every file of a tree. Tasks open and read them. With a schema of fewer columns only these are made: without the text and the errors no file is opened. Filters on path and kind are
applied to the list, before a task is made (``spark.sql.python.filterPushdown.enabled``). A stream takes files in the
order of their last change; its offset is the last file taken.

Paths are those that pyarrow's file systems can open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from vellum.sources.files import kind_of, read_file

SCHEMA = "path string, name string, kind string, bytes long, text string, error_code string, error_message string"
#: Bytes of files that one task reads, unless a file has more.
TASK_BYTES = 16 << 20


@dataclass(slots=True)
class File:
    path: str
    size: int
    changed: int

    def listed(self) -> dict[str, object]:
        return {"path": self.path, "name": self.path.rsplit("/", 1)[-1], "kind": kind_of(self.path), "bytes": self.size}


@dataclass(slots=True)
class Folder:
    """A folder's own files, by its name, with the bytes of those that are wanted."""

    path: str
    size: int


Test = tuple[str, str, object]


@dataclass
class Files(InputPartition):
    files: list[File | Folder]
    tests: tuple[Test, ...] = ()


_TESTS: dict[str, Callable] = {"=": lambda x, v: x == v, "in": lambda x, v: x in v, "starts": lambda x, v: x.startswith(v), "ends": lambda x, v: x.endswith(v), "contains": lambda x, v: v in x}


def wanted(f: File, tests: Iterable[Test]) -> bool:
    """Whether a file passes the tests on path and kind."""
    return all(_TESTS[op](f.listed()[c], v) for op, c, v in tests)


def own_files(store: fs.FileSystem, place: str) -> tuple[list[File], list[str]]:
    """The files of a folder, and the folders in it, in the order of their paths; none if there is no such folder. Names that begin with a dot or an underline are no documents."""
    found = [x for x in store.get_file_info(fs.FileSelector(place, allow_not_found=True)) if x.base_name[0] not in "._"]
    own = sorted((File(x.path, x.size, x.mtime_ns) for x in found if x.type == fs.FileType.File), key=lambda f: f.path)
    return own, sorted(x.path for x in found if x.type == fs.FileType.Directory)


def listed(folder: str) -> list[File]:
    """The files below a folder, in the order of their paths."""
    store, place = fs.FileSystem.from_uri(folder)
    out, todo = [], [place]
    while todo:
        own, inner = own_files(store, todo.pop())
        out += own
        todo += inner
    return sorted(out, key=lambda f: f.path)


def shares(folder: str, tests: Iterable[Test], task_bytes: int) -> Iterator[File | Folder]:
    """What is dealt out: files, or a folder below the given one in place of its own files if one task may read them all."""
    store, place = fs.FileSystem.from_uri(folder)
    todo = [place]
    while todo:
        at = todo.pop()
        own, inner = own_files(store, at)
        own = [f for f in own if wanted(f, tests)]
        size = sum(f.size for f in own)
        yield from [Folder(at, size)] if at != place and len(own) > 1 and size <= task_bytes else own
        todo += reversed(inner)


def dealt(files: Iterable[File | Folder], task_bytes: int, tests: tuple[Test, ...] = ()) -> list[Files]:
    """Files in their order, as many to a task as its bytes allow."""
    out, size = [], 0
    for f in files:
        if not out or size + f.size > task_bytes:
            out.append(Files([], tests))
            size = 0
        out[-1].files.append(f)
        size += f.size
    return out or [Files([])]


def rows(folder: str, part: Files, columns: list[str]) -> Iterator[tuple]:
    store, _ = fs.FileSystem.from_uri(folder)
    opened = bool({"text", "error_code", "error_message"} & set(columns))
    own = lambda f: [f] if isinstance(f, File) else [x for x in own_files(store, f.path)[0] if wanted(x, part.tests)]
    for f in (x for share in part.files for x in own(share)):
        row = f.listed()
        if opened:
            with store.open_input_stream(f.path) as source:
                row |= read_file(f.path, source.read())
        yield tuple(row[c] for c in columns)


class FileReader(DataSourceReader):
    def __init__(self, folder: str, columns: list[str], task_bytes: int):
        self.folder, self.columns, self.task_bytes = folder, columns, task_bytes
        self.tests: list[Test] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes those on path and kind that the list of files can tell; Spark applies the others."""
        names = {EqualTo: "=", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "contains"}
        for f in filters:
            if type(f) in names and f.attribute in (("path",), ("name",), ("kind",)):
                self.tests.append((names[type(f)], f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        return dealt(shares(self.folder, self.tests, self.task_bytes), self.task_bytes, tuple(self.tests))

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows(self.folder, partition, self.columns)


class FileStream(DataSourceStreamReader):
    def __init__(self, folder: str, columns: list[str], task_bytes: int):
        self.folder, self.columns, self.task_bytes = folder, columns, task_bytes

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((f.changed, f.path) for f in listed(self.folder)), default=(-1, ""))
        return {"changed": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        at = lambda o: (o["changed"], o["path"])
        return dealt([f for f in listed(self.folder) if at(start) < (f.changed, f.path) <= at(end)], self.task_bytes)

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows(self.folder, partition, self.columns)

    def commit(self, end: dict) -> None:
        pass


class FileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vellum_files"

    def schema(self) -> str:
        return SCHEMA

    def _arguments(self, schema: StructType) -> tuple[str, list[str], int]:
        known = {c.split()[0] for c in SCHEMA.split(", ")}
        if unknown := [c for c in schema.names if c not in known]:
            raise ValueError(f"no such columns of document files: {', '.join(unknown)}")
        return self.options["path"], schema.names, int(self.options.get("taskBytes", TASK_BYTES))

    def reader(self, schema: StructType) -> FileReader:
        return FileReader(*self._arguments(schema))

    def streamReader(self, schema: StructType) -> FileStream:
        return FileStream(*self._arguments(schema))
