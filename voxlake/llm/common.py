"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handled at once inside a Python task; bounds memory when texts are long.
SLICE_ROWS = 256
SLICE_BYTES = 8 << 20
#: Input rows for each file of a table that an operator keeps between its steps.
FILE_ROWS = 1 << 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    Only where the session names none and all runs on this machine is a temporary one made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="voxlake-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/voxlake-{tag}-{uuid.uuid4().hex}"


def files_for(spark: SparkSession, rows: int) -> int:
    """Files for a table that grows with so many rows: one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))


def materialise(df: DataFrame, tag: str, files: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    files: how many at most; if not told, one for each partition. Where Hadoop's native library is missing, an executor
    starts a process for each file and folder that it makes in a local file system.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df = df.coalesce(files) if files else df
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that an operator wrote and no longer needs, through Hadoop's file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def table_path(df: DataFrame) -> str:
    """The folder that materialise() wrote."""
    return os.path.dirname(df.inputFiles()[0]) if df.inputFiles() else ""


def dropped(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote. Only for those that nothing reads any more: what came of them is written."""
    for df in tables:
        if path := table_path(df):
            remove_path(df.sparkSession, path)


def keyed_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and text only, whatever else the input carries."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], size_of: str | None = None, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of bounded rows and (most) bytes (a single larger row stays whole)."""
    for batch in batches:
        n, start = batch.num_rows, 0
        rows = SLICE_ROWS
        if size_of is not None and n:
            mean = max(1, batch.column(batch.schema.get_field_index(size_of)).nbytes // n)
            rows = max(1, min(SLICE_ROWS, most // mean))
        while start < n:
            yield batch.slice(start, rows)
            start += rows


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def give_back() -> None:
    """Free memory that the allocators of a Python worker hold goes back to the machine, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class Kept:
    """What a Python worker keeps from task to task, until no task has used it for `wait` seconds.

    Idle workers live on beside the JVM's own work, and what they keep counts as the executor's memory.
    """

    def __init__(self, forget: Callable[[], None], wait: float = 2.0):
        self.forget, self.wait = forget, wait
        self.lock, self.tasks, self.timer = threading.Lock(), 0, None

    @contextmanager
    def used(self) -> Iterator[None]:
        with self.lock:
            self.tasks += 1
            if self.timer:
                self.timer.cancel()
        try:
            yield
        finally:
            with self.lock:
                self.tasks -= 1
                self.timer = threading.Timer(self.wait, self._end)
                self.timer.daemon = True
                self.timer.start()

    def _end(self) -> None:
        with self.lock:  # a task that begins meanwhile waits
            if not self.tasks:
                self.forget()
                gc.collect()
                give_back()
