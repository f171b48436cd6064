"""Tables and files in the folder that the driver and all executors share, and what workers give back."""

from __future__ import annotations

import ctypes
import posixpath
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmine.session import scratch_path

#: A table may be broadcast up to this many rows; callers bound the width of a row.
BROADCAST_ROWS = 200_000


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if its counted rows are few, as it is otherwise."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most ``rows`` rows in the batches that travel to Python: whole texts are wide, and both sides hold a batch at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def give_back() -> None:
    """Returns a worker's free memory to the machine; workers live on, idle, while other stages need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def fresh_folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS, S3, GCS) and the path inside it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


class AttemptFile:
    """A file with a name of its own for each task attempt.

    A task that is repeated or speculated writes another file; readers take only the files named in the
    rows that the successful attempt returned, so nothing is read twice or in part.
    """

    def __init__(self, folder: str, partition: int, suffix: str):
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{partition:06d}-{uuid.uuid4().hex}{suffix}"
        self.path = posixpath.join(folder, name)
        self.size = 0
        self._out = fs.open_output_stream(posixpath.join(base, name), compression=None)

    def write(self, data: bytes) -> int:
        """Appends ``data`` and returns where it starts."""
        at = self.size
        self._out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self._out.close()


def open_file(path: str):
    """A seekable input file; pyarrow reads only the ranges asked for."""
    fs, inner = filesystem(path)
    return fs.open_input_file(inner)
