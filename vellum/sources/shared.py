"""A folder for what a query writes and reads again."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Bytes of a batch that Spark sends to Python.
BATCH_BYTES = 8 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Batches of the session's Python functions hold ``BATCH_BYTES`` at most, or one row; a lower limit stays."""
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(_LIMIT) or "")
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share, or a temporary one where they are one process; it goes
    when the driver ends."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="vellum-work-")
    path = f"{shared.rstrip('/')}/vellum/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, path)
    return path


def _remove(path: str) -> None:
    from pyarrow import fs

    try:
        store, place = fs.FileSystem.from_uri(path)
        store.delete_dir(place)
    except Exception:  # noqa: BLE001  the folder may be gone, or never have been
        pass
