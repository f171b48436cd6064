"""Token ids in binary files: byte or bit planes of fixed blocks, each compressed, with an index.

Layout of a file, all integers little-endian::

    magic "TPLANES1"
    chunks: for each block of at most ``block`` ids, its planes one after another (zstandard frames)
    index (zstandard): JSON with plane kind, block size, and arrays
        chunks     [offset, ids, [size of each plane]]   a size of 0 means that the plane is all zeros
        documents  [[key, first id, ids], ...]           positions are counted from the file's first id
    8 bytes: where the index starts

Byte planes: the first, second, third and fourth bytes of all ids of a block.  Bit planes: bit 0 of all ids, bit 1, ... 31.
Equal neighbours meet in a plane, and the high planes of a small vocabulary are zero and cost nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqmine.llm.storage import AttemptFile, fresh_folder, open_file, written
from seqmine.llm.tokens import default_tokenizer, encoder, text_batches

MAGIC = b"TPLANES1"
BLOCK = 1 << 16
LEVEL = 3
#: Documents of one file that a reading task takes on at a time.
READ_DOCUMENTS = 4096


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of a block; an all-zero plane is an empty string."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    planes = []
    for b in range(4):
        column = np.ascontiguousarray(raw[:, b])
        if kind == "byte":
            planes.append(column.tobytes() if column.any() else b"")
        else:
            bits = np.unpackbits(column.reshape(-1, 1), axis=1, bitorder="little")
            planes += [np.packbits(bits[:, k], bitorder="little").tobytes() if bits[:, k].any() else b"" for k in range(8)]
    return planes


def from_planes(planes: list[bytes], count: int, kind: str) -> np.ndarray:
    raw = np.zeros((count, 4), dtype=np.uint8)
    if kind == "byte":
        for b, plane in enumerate(planes):
            if plane:
                raw[:, b] = np.frombuffer(plane, dtype=np.uint8)
    else:
        for k, plane in enumerate(planes):
            if plane:
                raw[:, k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=count, bitorder="little") << (k % 8)
    return raw.view("<u4").reshape(-1)


class Writer:
    """Appends documents to a file; at most one block is held in memory."""

    def __init__(self, out: AttemptFile, kind: str, block: int):
        self.out, self.kind, self.block = out, kind, block
        self.chunks, self.documents = [], []
        self.held: list[np.ndarray] = []
        self.n_held = self.total = 0
        self._zstd = zstandard.ZstdCompressor(level=LEVEL)
        out.write(MAGIC)

    def add(self, key, ids: np.ndarray) -> None:
        self.documents.append([key, self.total, len(ids)])
        self.total += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            ids = np.concatenate(self.held)
            cut = len(ids) - len(ids) % self.block
            for at in range(0, cut, self.block):
                self._chunk(ids[at:at + self.block])
            self.held, self.n_held = [ids[cut:]], len(ids) - cut

    def _chunk(self, ids: np.ndarray) -> None:
        packed = [self._zstd.compress(p) if p else b"" for p in to_planes(ids, self.kind)]
        self.chunks.append([self.out.write(b"".join(packed)), len(ids), [len(p) for p in packed]])

    def close(self) -> None:
        if self.n_held:
            self._chunk(np.concatenate(self.held))
        index = {"kind": self.kind, "block": self.block, "chunks": self.chunks, "documents": self.documents}
        at = self.out.write(self._zstd.compress(json.dumps(index).encode()))
        self.out.write(at.to_bytes(8, "little"))
        self.out.close()


class Reader:
    """Random access to the documents of a file; keeps the last chunk it unpacked."""

    def __init__(self, path: str):
        self.file = open_file(path)
        size = self.file.size()
        self.file.seek(0)
        if self.file.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"not a token file: {path}")
        self.file.seek(size - 8)
        at = int.from_bytes(self.file.read(8), "little")
        self.file.seek(at)
        self._zstd = zstandard.ZstdDecompressor()
        index = json.loads(self._zstd.decompress(self.file.read(size - 8 - at)))
        self.kind, self.block = index["kind"], index["block"]
        self.chunks, self.documents = index["chunks"], index["documents"]
        self._last: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def chunk(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            offset, count, sizes = self.chunks[k]
            self.file.seek(offset)
            data, planes = self.file.read(sum(sizes)), []
            for n in sizes:
                planes.append(self._zstd.decompress(data[:n]) if n else b"")
                data = data[n:]
            self._last = (k, from_planes(planes, count, self.kind))
        return self._last[1]

    def ids(self, first: int, count: int) -> np.ndarray:
        parts = []
        for k in range(first // self.block, (first + count - 1) // self.block + 1 if count else 0):
            low = k * self.block
            parts.append(self.chunk(k)[max(0, first - low):first + count - low])
        return np.concatenate(parts) if parts else np.empty(0, "<u4")

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", end_id: int | None = 0,
          planes: str = "byte", block: int = BLOCK, tokenizer: str | None = None,
          files: int | None = None) -> DataFrame:
    """Encodes ``docs`` and writes them in ascending order of the key, one file per range of keys.

    Returns the written list of files: ``part``, ``path``, ``documents``, ``ids``, ``start`` (ids in all files before).
    A null text gives the end id alone; null keys come first; rows with one key stand side by side, ordered by
    a hash of their text; an empty table gives no files; other columns are not read.  Rows are shuffled once, by
    ranges of (key, hash), so rows that share a key are split as well.
    """
    if planes not in ("byte", "bit"):
        raise ValueError("planes must be byte or bit")
    path = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    tail = np.array([] if end_id is None else [end_id], dtype="<u4").tobytes()
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("h", F.xxhash64("t")).repartitionByRange(n, "k", "h").sortWithinPartitions("k", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, part = encoder(path), None, TaskContext.get().partitionId()
        for batch in batches:
            keys, texts = batch.column("k").to_pylist(), batch.column("t").to_pylist()
            for piece in text_batches(texts):
                if writer is None:
                    writer = Writer(AttemptFile(folder, part, ".tpl"), planes, block)
                for k, ids in zip(keys[piece], enc.encode(texts[piece])):
                    writer.add(k, np.frombuffer(ids + tail, dtype="<u4"))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [writer.out.path],
                                              "documents": [len(writer.documents)], "ids": [writer.total]})

    made = written(rows.mapInArrow(run, "part long, path string, documents long, ids long"), "token-files")
    # The list has one short row for each writing task, so its running sum fits in one task.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of the written ``files``: key, ``start`` (ids of all documents before), ``ids`` (little-endian 32-bit).

    A file is read by several tasks, a range of its documents each; a task unpacks only the chunks that it needs.
    """
    ranges = files.select("part", "path", "start", "documents", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("documents") - 1, F.lit(READ_DOCUMENTS).cast("long"))).alias("first"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base, first in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "first"))):
                reader = Reader(path)
                todo = reader.documents[first:first + READ_DOCUMENTS]
                for at in range(0, len(todo), 256):
                    part = todo[at:at + 256]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d[0] for d in part], pa.int64()), pa.array([base + d[1] for d in part], pa.int64()),
                         pa.array([reader.ids(d[1], d[2]).tobytes() for d in part], pa.binary())], [key, "start", "ids"])
                reader.close()

    return ranges.repartition(n, "part", "first").mapInArrow(run, f"{key} long, start long, ids binary")


def write_and_read(docs: DataFrame, **options) -> DataFrame:
    """A round trip through a fresh folder below the shared one."""
    return read(write(docs, fresh_folder(docs.sparkSession, "token-ids"), **options))
