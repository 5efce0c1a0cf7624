"""Document-local operators on streams: they keep no state, so that a stream gives what a batch does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def run_available(rows: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Apply an operator to what is there and append the results; a restart goes on from the checkpoint, without repeats."""
    operator(rows).writeStream.format(fmt).option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
