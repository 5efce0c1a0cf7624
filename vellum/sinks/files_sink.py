"""Results as files: ``results.write.format("vellum_reports").option("report", "review").save(folder)``, a file a row.

Reports: ``outline``, ``review`` and ``comparison`` (Word), ``chart`` (PNG), ``json`` (indented) and ``text``. A row has
the file's ``name``, the result in a column of the report's name (for ``json`` and ``text``: ``result``), and for the first
two a ``source``. Tasks draw the files up and write them into a folder of their attempt; when all have ended the driver
moves the files of the attempts that count to their place, so that a task that was tried twice leaves one file, and a job
that fails leaves none. Two rows of one name are an error. Modes: append, which fails where a file is there already, and
overwrite, which clears the folder first.

With the option ``folders`` files stay in folders of a few megabytes below one for each task, which the driver moves as a
whole: it holds nothing of a single file, and names are told apart within a task only.

``writeStream`` does the same batch by batch; there a file replaces one of its name, so that a batch that is done again
after a failure leaves the files it left before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from vellum.sinks import png, word
from vellum.sinks.reports import pretty_json

REPORTS: dict[str, tuple[str, Callable[[Row], bytes]]] = {
    "outline": ("outline", lambda r: word.outline_report(r["outline"].asDict(True), r["source"])),
    "review": ("review", lambda r: word.review_report(r["review"].asDict(True), r["source"])),
    "comparison": ("comparison", lambda r: word.comparison_report(r["comparison"].asDict(True))),
    "chart": ("chart", lambda r: png.chart_png(r["chart"].asDict(True))),
    "json": ("result", lambda r: pretty_json(r["result"]).encode()),
    "text": ("result", lambda r: (r["result"] or "").encode()),
}


#: Bytes of the files of one folder, or one file, where these stay in folders.
FOLDER_BYTES = 4 << 20


@dataclass
class Written(WriterCommitMessage):
    job: str
    attempt: str
    names: list[str]


class ReportWriter(DataSourceWriter):
    def __init__(self, folder: str, report: str, overwrite: bool, folders: bool = False):
        self.folder, self.report, self.overwrite, self.folders = folder.rstrip("/"), report, overwrite, folders
        self.job = f"_unfinished-{uuid.uuid4().hex}"

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder)

    def write(self, iterator: Iterator[Row]) -> Written:
        """On an executor: the files of one attempt at a task, in a folder of its own."""
        store, place = self._place()
        attempt, names = uuid.uuid4().hex, {}  # a list would be searched for each row
        make = REPORTS[self.report][1]
        inner, size, made = f"{place}/{self.job}/{attempt}", 0, 0
        for row in iterator:
            name = row["name"]
            if not name or name.startswith((".", "_")) or "/" in name or name in names:
                raise ValueError(f"no name for a file of its own: {name!r}")
            body = make(row)
            if not names or self.folders and size + len(body) > FOLDER_BYTES:
                inner, size, made = f"{place}/{self.job}/{attempt}" + f"/{made}" * self.folders, 0, made + 1
                store.create_dir(inner)
            with store.open_output_stream(f"{inner}/{name}") as out:
                out.write(body)
            size += len(body)
            names[name] = None
        return Written(self.job, attempt, [""] if self.folders and names else [] if self.folders else list(names))

    def commit(self, messages: list[Written | None]) -> None:
        """On the driver: the files of the attempts that count take their places."""
        store, place = self._place()
        if self.folders:
            done = [(m.attempt, f"tasks-{m.attempt}") for m in messages if m is not None and m.names]
        else:
            done = [(f"{m.attempt}/{n}", n) for m in messages if m is not None for n in m.names]
        names = [n for _, n in done]
        store.create_dir(place)
        there = {x.base_name for x in store.get_file_info(fs.FileSelector(place)) if x.base_name != self.job}
        try:
            if len(set(names)) < len(names):
                raise ValueError("two rows have one file name")
            if self.overwrite:
                for name in there:
                    kind = store.get_file_info(f"{place}/{name}").type
                    (store.delete_dir if kind == fs.FileType.Directory else store.delete_file)(f"{place}/{name}")
            elif clash := there & set(names):
                raise FileExistsError(f"there already: {min(clash)}")
            for made, name in done:
                store.move(f"{place}/{self.job}/{made}", f"{place}/{name}")
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, place = self._place()
        if store.get_file_info(f"{place}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{place}/{self.job}")


class ReportStreamWriter(ReportWriter, DataSourceStreamWriter):
    """The writer that a task has is not the one that commits: messages name the folder of the attempts."""

    def __init__(self, folder: str, report: str):
        super().__init__(folder, report, False)

    def commit(self, messages: list[Written | None], batch: int) -> None:
        """On the driver: the files of a batch take their places, also those of a batch that did so before."""
        store, place = self._place()
        done = [(f"{m.job}/{m.attempt}", n) for m in messages if m is not None for n in m.names]
        try:
            if len({n for _, n in done}) < len(done):
                raise ValueError("two rows of a batch have one file name")
            store.create_dir(place)
            for attempt, name in done:
                if store.get_file_info(f"{place}/{name}").type == fs.FileType.File:  # not all stores move onto a file
                    store.delete_file(f"{place}/{name}")
                store.move(f"{place}/{attempt}/{name}", f"{place}/{name}")
        finally:
            self.abort(messages, batch)

    def abort(self, messages: list[Written | None], batch: int) -> None:
        store, place = self._place()
        for job in {m.job for m in messages if m is not None}:
            if store.get_file_info(f"{place}/{job}").type == fs.FileType.Directory:
                store.delete_dir(f"{place}/{job}")


class ReportSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vellum_reports"

    def _checked(self, schema: StructType) -> tuple[str, str]:
        report = self.options.get("report", "")
        if report not in REPORTS:
            raise ValueError(f"option report: one of {', '.join(REPORTS)}")
        needed = {"name", REPORTS[report][0], *(["source"] if report in ("outline", "review") else [])}
        if lacking := needed - set(schema.names):
            raise ValueError(f"columns needed: {', '.join(sorted(lacking))}")
        return self.options["path"], report

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(*self._checked(schema), overwrite, self.options.get("folders", "false").lower() == "true")

    def streamWriter(self, schema: StructType, overwrite: bool) -> ReportStreamWriter:
        return ReportStreamWriter(*self._checked(schema))
