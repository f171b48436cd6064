"""Fixed-width record files as a Spark data source.

``spark.read.format("fixed_records").option("width", 2352).load(path)`` gives
``src STRING, pos BIGINT, raw BINARY``.  A file is split into byte ranges, so one
large file is read by many tasks; a trailing partial record is dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan,
                                    GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage)

SCHEMA = "src string, pos bigint, raw binary"
SPLIT_BYTES = 128 << 20
BATCH_BYTES = 8 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def open_filesystem(path: str):
    """File system and path of a URI or a local path."""
    from pyarrow import fs
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def list_files(path: str) -> list[tuple[str, int]]:
    """Data files at or below ``path`` with their sizes; hidden and marker files are skipped."""
    from pyarrow import fs
    system, inner = open_filesystem(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    files = [(f.path, f.size) for f in found if f.type == fs.FileType.File]
    visible = lambda p: not any(part.startswith(("_", ".")) for part in p[len(inner):].split("/"))
    return sorted(f for f in files if visible(f[0]))


class RecordRange(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class RecordReader(DataSourceReader):
    """Plans byte ranges and reads them as Arrow batches."""

    def __init__(self, path: str, width: int, offset: int, split_bytes: int):
        self.path, self.width, self.offset, self.split_bytes = path, width, offset, split_bytes
        self.low, self.high = 0, None

    def partitions(self) -> list[RecordRange]:
        step = max(1, self.split_bytes // self.width)
        out = []
        for path, size in list_files(self.path):
            records = max(0, size - self.offset) // self.width
            last = records if self.high is None else min(records, self.high + 1)
            out += [RecordRange(path, first, min(first + step, last))
                    for first in range(self.low, last, step)]
        return out

    def read(self, part: RecordRange) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        system, _ = open_filesystem(self.path)
        per_batch = max(1, BATCH_BYTES // self.width)
        with system.open_input_file(part.path) as handle:
            for first in range(part.first, part.last, per_batch):
                n = min(per_batch, part.last - first)
                data = handle.read_at(n * self.width, self.offset + first * self.width)
                raw = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(self.width), n, [None, pa.py_buffer(data)]).cast(pa.binary())
                pos = pa.array(range(first, first + n), pa.int64())
                src = pa.array([part.path] * n, pa.string())
                yield pa.RecordBatch.from_arrays([src, pos, raw], names=["src", "pos", "raw"])


class BoundedRecordReader(RecordReader):
    """The same with bounds on ``pos`` applied to the byte ranges."""

    def pushFilters(self, filters: list[Filter]):
        """Position bounds decide which byte ranges are read at all."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("pos",):
                if isinstance(f, EqualTo):
                    self.low = max(self.low, f.value)
                    self.high = f.value if self.high is None else min(self.high, f.value)
                    continue
                if isinstance(f, GreaterThanOrEqual):
                    self.low = max(self.low, f.value)
                    continue
                if isinstance(f, GreaterThan):
                    self.low = max(self.low, f.value + 1)
                    continue
                if isinstance(f, (LessThanOrEqual, LessThan)):
                    high = f.value if isinstance(f, LessThanOrEqual) else f.value - 1
                    self.high = high if self.high is None else min(self.high, high)
                    continue
            yield f


class Written(WriterCommitMessage):
    """Files of one task attempt: path below the staging folder, and number of records."""

    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class RecordWriter(DataSourceArrowWriter):
    """Writes a binary column as records laid end to end, one file per task and folder.

    Every attempt writes files of its own below a hidden folder of the job.  The commit moves those of the successful attempts to
    their places and deletes the rest, so repeated or lost attempts leave nothing.
    """

    def __init__(self, path: str, by: str | None, width: int | None):
        self.path, self.by, self.width = path, by, width
        self.staging = f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext
        system, root = open_filesystem(self.path)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        out, folder, files, width = None, None, [], self.width
        try:
            for batch in iterator:
                for value, rows in self._pieces(batch):
                    lengths = pc.unique(pc.binary_length(rows)).to_pylist()
                    if self.width is None and (out is None or value != folder):
                        width = lengths[0]
                    if lengths != [width] or not width:
                        raise ValueError(f"records of {lengths} bytes among records of {width}")
                    if out is None or value != folder:
                        if out is not None:
                            out.close()
                        folder = value
                        below = f"{value}/{name}" if value else name
                        system.create_dir(f"{root}/{self.staging}/{value}".rstrip("/"), recursive=True)
                        out = system.open_output_stream(f"{root}/{self.staging}/{below}", compression=None)
                        files.append((below, 0))
                    out.write(b"".join(rows.to_pylist()))
                    files[-1] = (files[-1][0], files[-1][1] + len(rows))
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def _pieces(self, batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
        """Runs of rows of one folder; rows come sorted by it."""
        raw = batch.column("raw")
        if not batch.num_rows:
            return
        if self.by is None:
            yield "", raw
            return
        values = batch.column("folder").to_pylist()
        first = 0
        for k in range(1, len(values) + 1):
            if k == len(values) or values[k] != values[first]:
                shown = "__HIVE_DEFAULT_PARTITION__" if values[first] is None else quote(values[first], safe=" ")
                yield f"{self.by}={shown}", raw.slice(first, k - first)
                first = k

    def commit(self, messages: list[Written | None]) -> None:
        system, root = open_filesystem(self.path)
        for below, _ in sorted(f for m in messages if m for f in m.files):
            if "/" in below:
                system.create_dir(f"{root}/{below.rsplit('/', 1)[0]}", recursive=True)
            system.move(f"{root}/{self.staging}/{below}", f"{root}/{below}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs
        system, root = open_filesystem(self.path)
        if system.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staging}")


class FixedRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        pushdown = self.options.get("pushdown", "false").lower() == "true"
        kind = BoundedRecordReader if pushdown else RecordReader
        return kind(self.options["path"], int(self.options["width"]), int(self.options.get("offset", 0)),
                    int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        if overwrite:
            raise ValueError("fixed_records only appends")
        width = self.options.get("width")
        return RecordWriter(self.options["path"].rstrip("/"), self.options.get("by"), int(width) if width else None)


def read_records(spark: SparkSession, path: str, width: int, offset: int = 0,
                 split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of all files at or below ``path``; record n starts at byte ``n*width + offset``.

    With ``spark.sql.python.filterPushdown.enabled`` bounds on ``pos`` limit what is read.
    """
    spark.dataSource.register(FixedRecords)
    return (spark.read.format("fixed_records").option("width", width).option("offset", offset)
            .option("split_bytes", split_bytes).option("pushdown", spark.conf.get(PUSHDOWN, "false")).load(path))


def write_records(df: DataFrame, raw: str, path: str, partition_by: str | None = None, order: Sequence[str] = (),
                  width: int | None = None) -> None:
    """Writes binary values, any bytes and equally long in each file, one after the other into files below ``path``, which must hold none yet.

    With ``order`` the files, taken by name, hold the rows in that order, as ranges of it that are written side by side;
    without it rows keep the order of their partitions.  ``partition_by`` gives a folder to each of its values, with lengths of its own.  Null, empty
    and differently long values (than ``width``, if given) are refused, and then nothing is written.
    """
    spark = df.sparkSession
    system, root = open_filesystem(path)
    if system.get_file_info(root).type.name != "NotFound" and list_files(path):
        raise ValueError(f"{path} already holds files")
    columns = [F.col(raw).cast("binary").alias("raw")]
    if partition_by:
        columns.append(F.col(partition_by).cast("string").alias("folder"))
    keys = [f"_o{i}" for i in range(len(order))]
    rows = df.select(*columns, *[F.col(c).alias(k) for c, k in zip(order, keys)])
    if keys:
        rows = rows.repartitionByRange(*keys)
    if keys or partition_by:
        rows = rows.sortWithinPartitions(*(["folder"] if partition_by else []), *keys)
    spark.dataSource.register(FixedRecords)
    writer = rows.drop(*keys).write.format("fixed_records").mode("append")
    for option, value in (("by", partition_by), ("width", width)):
        if value is not None:
            writer = writer.option(option, value)
    writer.save(path)


def export_range(df: DataFrame, low: int, high: int, pos: str = "pos") -> DataFrame:
    """Records ``low`` to ``high``, both included."""
    return df.where(F.col(pos).between(low, high))
