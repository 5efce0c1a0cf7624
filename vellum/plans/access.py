"""What SQL users need: functions and table functions by name, and the queries' results as views."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Row, SparkSession, functions as F
from pyspark.sql.types import DateType, DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from vellum.functions.numbers import plain_day, plain_number
from vellum.operators.charts import parse_table
from vellum.plans.registry import QUERIES
from vellum.sinks.files_sink import ReportSink
from vellum.sources.files_source import FileSource
from vellum.sources.shared import bounded_batches


@F.arrow_udf(DoubleType())
def text_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """The similarity of two texts, case aside, that comparisons weigh; null if one is null. The order of the two matters."""
    pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
    return pa.array([None if x is None or y is None else SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in pairs], pa.float64())


class ChartRows:
    """The rows of a chart table with their numbers, from 2 on as the header is row 1; none if the table breaks a rule."""

    def eval(self, data_text: str) -> Iterator[tuple[int, list[str]]]:
        for i, row in enumerate(parse_table(data_text)["rows"] or [], 2):
            yield i, row


class ChartErrors:
    """The first rule that a chart table breaks, if any."""

    def eval(self, data_text: str) -> Iterator[tuple[str, str]]:
        found = parse_table(data_text)
        if found["error_code"]:
            yield found["error_code"], found["error_message"]


class ChartTable:
    """The rows of all chart tables of one header, with the header's names as columns: the first a text, those after it
    numbers, or days for a Gantt chart; null where a cell is none. Other columns of the given table go along.

    ``chart_table(TABLE(t), 'Type,Count', 'Bar Chart')``, where ``t`` has a column data_text; tables of another header or
    that break a rule give no rows."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, header: AnalyzeArgument, chart_type: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or "data_text" not in rows.dataType.names:
            raise ValueError("the first argument is a table with a column data_text")
        names, own = header_of(header.value), [f for f in rows.dataType.fields if f.name != "data_text"]
        if clash := {f.name.lower() for f in own} & {n.lower() for n in [*names, "row_number"]} or len({n.lower() for n in names}) < len(names):
            raise ValueError(f"columns of one name: {clash or names}")
        kind = DateType() if chart_type.value == "Gantt Chart" else DoubleType()
        return AnalyzeResult(StructType([*own, StructField("row_number", IntegerType()), *(StructField(n, kind if i else StringType()) for i, n in enumerate(names))]))

    def eval(self, row: Row, header: str, chart_type: str) -> Iterator[tuple]:
        found = parse_table(row["data_text"])
        if found["error_code"] or found["headers"] != header_of(header):
            return
        own, typed = tuple(v for k, v in row.asDict().items() if k != "data_text"), plain_day if chart_type == "Gantt Chart" else plain_number
        for i, cells in enumerate(found["rows"], 2):
            yield (*own, i, cells[0], *map(typed, cells[1:]))


def header_of(line: str) -> list[str]:
    return [c.strip() for c in next(csv.reader([line]))]


def register_functions(spark: SparkSession) -> None:
    """``text_similarity(a, b)``; table functions ``chart_rows(data_text)``, ``chart_errors(data_text)`` and ``chart_table(TABLE(t), header, chart_type)``."""
    spark.udf.register("text_similarity", text_similarity)
    spark.udtf.register("chart_rows", F.udtf(ChartRows, returnType="row_number int, cells array<string>"))
    spark.udtf.register("chart_table", F.udtf(ChartTable))
    spark.udtf.register("chart_errors", F.udtf(ChartErrors, returnType="error_code string, error_message string"))


def register_sources(spark: SparkSession) -> None:
    """The formats ``vellum_files`` to read and ``vellum_reports`` to write; filters reach the former's list of files, and
    results go to the latter in batches bounded by bytes."""
    bounded_batches(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileSource)
    spark.dataSource.register(ReportSink)


def register_views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """The results of the named queries, or of all, as temporary views of the same names. Nothing runs before a view is read."""
    for name in names or tuple(QUERIES):
        QUERIES[name](spark, sf_dir).createOrReplaceTempView(name)
