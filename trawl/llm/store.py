"""Tables that cut lineage: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from trawl.scratch import Files, new_path

#: Arrow batches are bounded by rows and by bytes, so a run of very long texts can't fill a Python worker.
ARROW_ROWS, ARROW_BYTES = 1024, 16 << 20
#: Folders that this thread has written.
_own = threading.local()


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches. Spark reads these settings when a plan runs, so they stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def written(path: str) -> str:
    """Notes a folder, to be deleted by temporary() or settle() if it is written while they run."""
    _own.paths = [*getattr(_own, "paths", []), path]
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df below the shared folder and reads it again. Unlike a cache it survives the loss of executors."""
    spark = df.sparkSession
    path = written(new_path(spark, name))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that were written inside, for what leaves no lazy result behind."""
    before = getattr(_own, "paths", [])
    _own.paths = []
    try:
        yield
    finally:
        gone, _own.paths = _own.paths, before
        files = Files(spark)
        for path in gone:
            files.delete(path)


def settle(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s result, written; then the tables that make wrote on its way are deleted, as nothing refers to them."""
    path = new_path(spark, name)
    with temporary(spark):
        df = make()
        df.write.parquet(path)
    written(path)
    return spark.read.schema(df.schema).parquet(path)
