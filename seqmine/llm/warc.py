"""Web archives: writing records with revisits, and a splittable reader.

Each record is a gzip member of its own, so an archive can be entered at any member.  A reading task owns the
members that start inside its byte range.  It looks for the gzip magic bytes, takes a place for a member only if the
data there inflates to a complete record (version line, headers, block of the stated length, check sum), whatever follows, and then
walks from member to member, past its range's end for the last.  Bytes of no whole record are skipped; ``damaged`` lists them.
"""

from __future__ import annotations

import hashlib
import zlib
from base64 import b16encode, b32decode, b32encode
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as RowWindow
from pyspark.sql import functions as F

from seqmine.llm.storage import AttemptFile, fresh_folder, open_file, written

MAGIC = b"\x1f\x8b\x08"
#: Bytes of an archive that one reading task owns, and that it fetches at a time.
SPLIT_BYTES = 32 << 20
READ_BYTES = 1 << 20
#: Records with payloads of at least this size become revisits of an equal one.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digest(hex_sha1: str) -> str:
    return "sha1:" + b32encode(bytes.fromhex(hex_sha1)).decode()


def _record(fields: dict[str, str | None], block: bytes, level: int) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    data = b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _name(key: int | None) -> str:
    """A record's id; a page without one gets an id that names no page."""
    return f"<urn:x-page:{'' if key is None else key}>"




def page_record(key: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, date: str,
                level: int) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone, as one gzip member."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    again = refers_to is not None
    fields = {"WARC-Type": "revisit" if again else "response", "WARC-Record-ID": _name(key), "WARC-Date": date,
              "WARC-Target-URI": quote(url, safe="".join(map(chr, range(33, 127)))) if url is not None else None,
              "WARC-Payload-Digest": _digest(sha1), "WARC-Profile": PROFILE if again else None,
              "WARC-Refers-To": _name(refers_to) if again else None,
              "Content-Type": "application/http;msgtype=response"}
    return _record(fields, head if again else head + payload, level)


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html",
          revisit_bytes: int = REVISIT_BYTES, level: int = 6, date: str | None = None) -> DataFrame:
    """Writes a record per row and returns the written list of archives: ``path``, ``bytes``, ``records``.

    Of equal payloads of at least ``revisit_bytes`` bytes the row with the largest key is the response (all rows that
    share it are); the others revisit it.  A null body is empty, a null url leaves out the target, a row with a null
    key is a response nothing refers to; an empty table gives no archives; other columns are not read.

    Only digests are grouped, partially before the shuffle; digests met once drop out, and the rest joins the rows by
    digest, where adaptive execution splits the rows of a frequent payload.
    """
    stamp = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"),
                        F.encode(F.coalesce(F.col(body).cast("string"), F.lit("")), "utf-8").alias("b"))
    rows = rows.withColumn("sha1", F.sha1("b"))
    last = (rows.where((F.octet_length("b") >= revisit_bytes) & F.col("k").isNotNull())
            .groupBy("sha1").agg(F.max("k").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    rows = rows.join(last, "sha1", "left").withColumn("to", F.expr("if(k < last, last, null)"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = None, 0
        for batch in batches:
            for k, u, b, sha1, to in zip(*(batch.column(c).to_pylist() for c in ("k", "u", "b", "sha1", "to"))):
                if out is None:
                    out = AttemptFile(folder, TaskContext.get().partitionId(), ".warc.gz")
                    out.write(_record({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:x-archive:info>", "WARC-Date": stamp,
                                       "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n", level))
                out.write(page_record(k, u, b, sha1, to, stamp, level))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [out.path], "bytes": [out.size], "records": [n]})

    made = rows.select("k", "u", "b", "sha1", "to").mapInArrow(run, "path string, bytes long, records long")
    return written(made, "warc-files")


class Window:
    """A file seen through a buffer that moves forward."""

    def __init__(self, path: str):
        self.file = open_file(path)
        self.size = self.file.size()
        self.start, self.data = 0, b""

    def at(self, place: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``place`` on."""
        if not self.start <= place or place + n > self.start + len(self.data) and self.start + len(self.data) < self.size:
            self.file.seek(place)
            self.start, self.data = place, self.file.read(max(n, READ_BYTES))
        return self.data[place - self.start:place - self.start + n]


def _headers(data: bytes) -> dict[str, str] | None:
    lines = data.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        return None
    pairs = [line.partition(":") for line in lines[1:] if line]
    return {k.strip().lower(): v.strip() for k, colon, v in pairs if colon}


def member(window: Window, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and end of the record whose gzip member starts at ``at``, or None if there is none."""
    if window.at(at, 3) != MAGIC:
        return None
    inflate, data, place, headers = zlib.decompressobj(31), bytearray(), at, None
    try:
        while not inflate.eof:
            raw = window.at(place, READ_BYTES if headers else 4096)
            if not raw:
                return None
            data += inflate.decompress(raw)
            place += len(raw)
            if headers is None and (end := data.find(b"\r\n\r\n")) >= 0:
                headers = _headers(bytes(data[:end]))
                if headers is None or not headers.get("content-length", "").isdigit():
                    return None
            elif headers is None and not data[:7].startswith(b"WARC/1."[:len(data[:7])]):
                return None
    except zlib.error:
        return None
    place -= len(inflate.unused_data)
    if headers is None:
        return None
    start = data.find(b"\r\n\r\n") + 4
    length = int(headers["content-length"])
    return (headers, bytes(data[start:start + length]), place) if len(data) >= start + length else None


def records(path: str, start: int, end: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Place, end, headers and block of the records that start in ``[start, end)``."""
    window, at = Window(path), start
    while at < end:
        found = member(window, at)
        if found is None:
            while True:  # look for the next candidate
                chunk = window.at(at + 1, READ_BYTES)
                hit = chunk.find(MAGIC)
                if hit >= 0 or len(chunk) < len(MAGIC):
                    break
                at += len(chunk) - len(MAGIC) + 1
            if hit < 0:
                break
            at += 1 + hit
        else:
            yield at, found[2], found[0], found[1]
            at = found[2]
    window.file.close()


def read(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of archives (``path``, ``bytes``): path, ``place``, ``record_type``, ``record_id``, ``target_uri``,
    ``refers_to_id``, ``payload_digest`` (hex SHA-1), ``payload_bytes``, ``payload`` (null for revisits).

    The payload is the HTTP body of a response; of a revisit, digest and length are those that its headers state.
    """
    schema = ("path string, place long, record_type string, record_id string, target_uri string, refers_to_id string, "
              "payload_digest string, payload_bytes long, payload binary")
    names = [c.split()[0] for c in schema.split(", ")]

    def row(path: str, place: int, fields: dict[str, str], block: bytes) -> tuple:
        head, _, payload = block.partition(b"\r\n\r\n")
        kind = fields.get("warc-type")
        if kind == "response":
            digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
        else:
            stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
            digest = b16encode(b32decode(stated)).decode().lower() if len(stated) == 32 else None
            lengths = [line[15:] for line in head.decode("latin-1").split("\r\n") if line.lower().startswith("content-length:")]
            size, payload = (int(lengths[0]) if lengths else None), None
        return (path, place, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"),
                digest, size, payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start"))):
                held, weight = [], 0
                for place, _, fields, block in records(path, start, min(start + split_bytes, size)):
                    held.append(row(path, place, fields, block))
                    weight += len(block)
                    if weight > READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
                        held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

    return _ranges(archives, split_bytes).mapInArrow(run, schema)


def damaged(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Byte ranges of archives (``path``, ``bytes``) that no whole record holds: path, ``start``, ``end`` (exclusive).

    These are members that were cut or altered, and foreign bytes or padding between or behind members; neighbouring ones are one range.
    Whole archives and empty ones give no rows.  The archives are read once more; only range summaries are brought together by path.
    """
    schema = "path string, bytes long, start long, first long, stop long, hole long, till long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start"))):
                first = stop = None
                for place, end, _, _ in records(path, start, min(start + split_bytes, size)):
                    if first is None:
                        first = place
                    elif stop < place:
                        found.append((path, size, start, None, None, stop, place))
                    stop = end
                found.append((path, size, start, first, stop, None, None))
            kinds = [pa.string(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], [c.split()[0] for c in schema.split(", ")])

    seen = written(_ranges(archives, split_bytes).mapInArrow(run, schema), "archive-ranges")
    parts = seen.where("hole is null")
    before = F.coalesce(F.max("stop").over(RowWindow.partitionBy("path").orderBy("start").rowsBetween(RowWindow.unboundedPreceding, -1)), F.lit(0))
    between = parts.select("path", before.alias("start"), F.col("first").alias("end"))
    behind = parts.groupBy("path").agg(F.coalesce(F.max("stop"), F.lit(0)).alias("start"), F.max("bytes").alias("end"))
    inside = seen.where("hole is not null").select("path", F.col("hole").alias("start"), F.col("till").alias("end"))
    return inside.unionByName(between).unionByName(behind).where(F.col("start") < F.col("end"))


def _ranges(archives: DataFrame, split_bytes: int) -> DataFrame:
    """Ranges of the archives, ``path``, ``bytes``, ``start``, over all tasks."""
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    return archives.select("path", "bytes", F.explode(starts).alias("start")).repartition(n, "path", "start")


def page_number(name: str) -> Column:
    """The page behind a record id that ``write`` gave."""
    return F.regexp_extract(name, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")


def write_and_read(pages: DataFrame, **options) -> DataFrame:
    """A round trip through a fresh folder below the shared one: the page records, with ``page_id`` and ``refers_to``."""
    found = read(write(pages, fresh_folder(pages.sparkSession, "warc"), **options))
    return (found.where(F.col("record_type").isin("response", "revisit"))
            .withColumn("page_id", page_number("record_id")).withColumn("refers_to", page_number("refers_to_id")))
