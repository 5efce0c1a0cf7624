"""Tables in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A table is dealt out if its files are fewer than this part of the tasks it should have, by so many bytes a task.
SPARE, TASK_BYTES = 4, 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bytes_of(rows: DataFrame) -> int:
    """Spark's guess of the bytes of a plan's rows."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # a number or a Scala object


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table in far fewer files than it should have tasks: a row group is one task's work, however large.

    That is one shuffle of what the query takes of it, to all cores, and to more tasks as the table grows, so that the
    longest does not grow with it; a table of more files is read as it lies. No filter on what is made of the rows is moved
    before the shuffle, where a row group would be one task: they pass an explode of one row each."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-bytes_of(rows) // TASK_BYTES))
    if len(rows.inputFiles()) * SPARE > tasks:
        return rows
    dealt = rows.repartition(tasks).select(F.explode_outer(F.array(F.struct(*(F.col(f"`{c}`") for c in rows.columns)))).alias("row"))
    return dealt.select("row.*")
