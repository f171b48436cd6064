"""Structures of any length inside the joined text of islands.

The records of an island (consecutive positions) are one stream of characters, cut into windows of bounded size.  A window is looked at with
some characters beyond its end, taken from as many records as that needs.  A match is final if no way of matching runs into
the end of the text at hand; this is asked of the pattern followed by something that never matches, which tries every way and reports a
partial match if one of them needed more text.  Offsets that do are looked at again with eight times as much text, until the text suffices or the
island ends.  So hits equal those of the pattern on the whole island, and no task holds more than a window or the
text that one structure asks for.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from seqmine.plans.blocks import Run, stream_offsets
from seqmine.session import cut

#: Characters of a window, and those beyond its end that are looked at first.
WINDOW, REACH = 1 << 14, 1 << 10
GROWTH = 8


class Pattern:
    """A pattern and the question whether a text is too short for it."""

    def __init__(self, pattern: str):
        self.found = regex.compile(pattern, regex.DOTALL)
        self._every_way = regex.compile(f"(?:{pattern})(?!)", regex.DOTALL)

    def undecided(self, text: str, limit: int) -> list[int]:
        """Starts below ``limit`` from which some way of matching runs into the end of ``text``."""
        starts, at = [], 0
        while at < limit and (m := self._every_way.search(text, at, partial=True)) and m.start() < min(limit, len(text)):
            starts.append(m.start())
            at = m.start() + 1
        return starts

    def needs_more(self, text: str) -> bool:
        return self._every_way.match(text, partial=True) is not None


def _record(starts: list[int], offset: int) -> int:
    """Number of the piece that holds an offset."""
    return bisect_right(starts, offset) - 1


def _look(batches: Iterator[pa.RecordBatch], pattern: str, step: int, window: int, reach: int,
          schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Hits that start in the rows' windows, and with a null ``found`` the offsets that need more text."""
    ask = Pattern(pattern)
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("row", "ofs", "start", "offset", "end", "found")}
        columns = [batch.column(c).to_pylist() for c in ("w", "text", "o", "p", "at")]
        for row, (w, text, o, p, at) in enumerate(zip(*columns)):
            base = w * window
            aligned = lambda s: (base + s) % step == 0
            # Text that does not fill the window and its reach ends where the island does.
            whole = len(text) < window + reach
            open_ = set() if whole else {s for s in ask.undecided(text, window) if aligned(s)}
            hits = [(s, None) for s in open_]
            for m in ask.found.finditer(text, overlapped=True):
                if m.start() >= window:
                    break
                if aligned(m.start()) and m.start() not in open_ and m.end() > m.start():
                    hits.append((m.start(), m.group()))
            for s, found in hits:
                first = _record(o, base + s)
                out["row"].append(row)
                out["ofs"].append(base + s)
                out["start"].append(p[first])
                out["offset"].append(base + s - at[first])
                out["end"].append(None if found is None else p[_record(o, base + s + len(found) - 1)])
                out["found"].append(found)
        rows = pa.array(out.pop("row"), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("isle").take(rows), *[pa.array(v, schema.field(c).type) for c, v in out.items()]], schema=schema)


def _windows(placed: DataFrame, text: str, pos: str, window: int, reach: int) -> DataFrame:
    """One row per window: its text with ``reach`` characters beyond, and per piece its offset, position and record offset."""
    end = F.col("at") + F.length(text)
    first = F.greatest(F.floor((F.col("at") - F.lit(reach)) / F.lit(window)), F.lit(0))
    pieces = (placed.where(F.length(text) > 0)
              .withColumn("w", F.explode(F.sequence(first, F.floor((end - 1) / F.lit(window)))))
              .withColumn("_lo", F.greatest(F.col("at"), F.col("w") * window))
              .withColumn("_hi", F.least(end, (F.col("w") + 1) * window + reach)))
    piece = F.struct(F.col("_lo").alias("o"), F.col(pos).cast("bigint").alias("p"), F.col("at"),
                     F.substring(F.col(text), (F.col("_lo") - F.col("at") + 1).cast("int"), (F.col("_hi") - F.col("_lo")).cast("int")).alias("t"))
    return (pieces.where("_hi > _lo").groupBy("isle", "w").agg(F.sort_array(F.collect_list(piece)).alias("_x"))
            .select("isle", "w", F.array_join("_x.t", "").alias("text"), F.col("_x.o").alias("o"), F.col("_x.p").alias("p"),
                    F.col("_x.at").alias("at")))


def _follower(pattern: str, window: int, size: int):
    """Looks at one offset with ``size`` characters, given the texts of its windows."""
    def followed(table: pa.Table) -> pa.Table:
        table = table.sort_by("w")
        first, pieces = table.slice(0, 1).to_pylist()[0], table.select(["o", "p"]).to_pylist()
        o, p = ([x for row in pieces for x in row[c]] for c in ("o", "p"))
        text = "".join(table.column("text").to_pylist())[first["ofs"] - first["w"] * window:][:size]
        ask = Pattern(pattern)
        m = ask.found.match(text)
        more = len(text) == size and ask.needs_more(text)
        n = 1 if more or (m and m.end()) else 0
        end = None if more or not n else p[_record(o, first["ofs"] + m.end() - 1)]
        out = table.select(["isle", "ofs", "start", "offset"]).slice(0, n)
        return out.append_column("end", pa.array([end] * n, pa.int64())).append_column(
            "found", pa.array([None if more or not n else m.group()] * n, pa.string()))
    return followed


def carve(df: DataFrame, run: Run, *, text: str, pattern: str, reach: int = REACH, step: int = 4, pos: str = "pos",
          window: int = WINDOW) -> DataFrame:
    """Structures that start at an aligned offset of an island, of any length and over any number of records.

    Offsets count the characters of the island's joined records and are aligned to ``step``.  Overlapping hits are all reported; a
    structure cut off by the end of its island is none, nor is an empty match.  ``pattern`` is a ``regex`` pattern in which a dot
    matches line feeds; it must not look behind its start or ask for the end of the text.  Records with a null or empty text take up
    a position but no room.  ``window`` and ``reach`` bound what is looked at first and change no result.
    Gives the run's keys, ``start`` and ``end`` (positions of the first and last record), ``offset`` in the first one, and ``found``.
    """
    window = max(window, reach)
    placed = stream_offsets(df.select(*run.keys, *run.block, pos, text), run, F.coalesce(F.length(text), F.lit(0)), pos)
    placed = placed.select(F.struct(*run.keys, "seg").alias("isle"), pos, "at", text)
    long = lambda name: StructField(name, LongType())
    schema = StructType([StructField("isle", placed.schema["isle"].dataType), long("ofs"), long("start"), long("offset"), long("end"),
                         StructField("found", StringType())])

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        for batch in batches:
            arrow = arrow or pa.schema([batch.schema.field("isle"), *[pa.field(c, pa.int64()) for c in ("ofs", "start", "offset", "end")],
                                        pa.field("found", pa.string())])
            yield from _look(iter([batch]), pattern, step, window, reach, arrow)

    found = cut(_windows(placed, text, pos, window, reach).mapInArrow(looked, schema))
    hits, open_, size = found.where("found is not null"), found.where("found is null"), window
    texts = None
    while not open_.isEmpty():
        texts = texts or cut(_windows(placed, text, pos, window, 0))
        size *= GROWTH

        asked = open_.drop("end", "found").withColumn("w", F.explode(F.sequence(
            F.floor(F.col("ofs") / window), F.floor((F.col("ofs") + size - 1) / window))))
        found = cut(asked.join(texts.drop("at"), ["isle", "w"]).groupBy("isle", "ofs").applyInArrow(
            _follower(pattern, window, size), schema))
        hits, open_ = hits.unionByName(found.where("found is not null")), found.where("found is null")
    return hits.select(*[F.col("isle")[k].alias(k) for k in run.keys], "start", "offset", "end", "found")
