"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text, and rows, that a task works on at once; a longer text is worked on alone.
TEXT_BYTES, TEXT_ROWS = 4 << 20, 512


class _Blocks(threading.local):
    """Folders that ``materialize`` and ``new_path`` made in each open ``temporary`` block of a thread, the innermost last."""

    def __init__(self):
        self.made: list[list[str]] = []

    def __getitem__(self, n: int) -> list[str]:
        return self.made[n]


_open = _Blocks()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a session that runs in one process uses a folder of its own; any
    other raises an error, since machines share no temporary folder.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='ridgeline-')}"
    spark.sparkContext.setCheckpointDir(made)
    return made


def new_path(spark: SparkSession, kind: str = "ridgeline") -> str:
    """A new folder's name within the shared one, deleted with the open ``temporary`` block."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    if _open.made:
        _open[-1].append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back, which cuts its lineage.

    The table survives the loss of executors, and its rows stay the same for all
    later readers even where the plan that made them would not repeat them.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._ridgeline_path = path
    return read


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df._ridgeline_path)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete at the end all tables that operators wrote within the block, in its thread.

    Results are lazy and read such tables, so write or collect them inside the block.
    """
    _open.made.append([])
    try:
        yield
    finally:
        for path in _open.made.pop():
            delete(spark, path)


@contextmanager
def small_batches(spark: SparkSession, most: int = 8 << 20) -> Iterator[None]:
    """Bound the bytes of Arrow batches of what runs within the block; the setting comes back after it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Hand memory that this worker has freed back to the machine; a worker serves many tasks and keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of at most ``TEXT_ROWS`` rows and about ``TEXT_BYTES`` of text.

    Arrow batches of Spark are bounded by ``spark.sql.execution.arrow.maxRecordsPerBatch`` and
    ``maxBytesPerBatch``, which stay as the session has them; what a task derives from texts is
    many times their size, and is bounded here.
    """
    # What the task before left in this worker.
    give_back()
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist()
        at, total = 0, 0
        for n, size in enumerate(sizes):
            if n > at and (n - at >= TEXT_ROWS or total + size > TEXT_BYTES):
                yield b.slice(at, n - at)
                at, total = n, 0
            total += size
        if b.num_rows > at or not b.num_rows:
            yield b.slice(at)
    give_back()
