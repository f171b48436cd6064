"""Segments and pairs of a stream, one small state per key.

Rows wait in the state until the watermark has passed them, so they are handled in
position order whatever order they arrive in; what the watermark has already passed
is dropped by the engine and shows in its ``numRowsDroppedByWatermark`` metric.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType, IntegralType, LongType, StructField, StructType


def stream_gap_segments(sdf: DataFrame, *, keys: Sequence[str] = ("src",), ts: str = "ts",
                        gap: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Segments split by pure gaps: the engine's own session windows."""
    return (sdf.withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, gap).alias("_s"))
            .agg(F.count(F.lit(1)).alias("records"), F.min(ts).alias("start"), F.max(ts).alias("end"))
            .drop("_s"))


class _Ordered(StatefulProcessor):
    """Holds rows back until the watermark has passed them, then hands them on in order.

    Waiting rows are bounded by the watermark delay and lie in buckets of event time, as Arrow tables; a timer reads the buckets that
    are due and leaves the others alone.  A key has one timer, for its next bucket or for the time after which its open result is
    given out.
    """

    def __init__(self, columns: StructType, opened: str, out: StructType, bucket_ms: int):
        self.names, self.opened, self.out, self.bucket_ms = columns.names, opened, out, bucket_ms
        self.arrow = to_arrow_schema(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long, part long", "rows binary")
        self.open = handle.getValueState("open", self.opened)
        self.timer = handle.getValueState("timer", "at long, parts long")

    def _wake(self, at: int | None, parts: int) -> None:
        """One timer at ``at`` (none if null) in place of the one that was set."""
        before = self.timer.get()[0] if self.timer.exists() else None
        if before != at:
            if before is not None:
                self.handle.deleteTimer(int(before))
            if at is not None:
                self.handle.registerTimer(int(at))
        if at is None:
            self.timer.clear()
        else:
            self.timer.update((int(at), parts))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, parts = tuple(self.timer.get()) if self.timer.exists() else (None, 0)
        for pdf in rows:
            if not len(pdf):
                continue
            table = pa.Table.from_pandas(pdf[self.names], schema=self.arrow, preserve_index=False)
            bucket = table.column("at").to_numpy() // self.bucket_ms
            for b in np.unique(bucket).tolist():
                part = table.filter(pa.array(bucket == b))
                self.waiting.updateValue((b, parts), (_packed(part),))
                parts += 1
                soon = int(part.column("at").to_numpy().min()) + 1
                at = soon if at is None else min(at, soon)
        if at is not None:
            self._wake(at, parts)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Everything up to the watermark has arrived, so one timer handles all of it.
        now = timerValues.getCurrentWatermarkInMs()
        parts = self.timer.get()[1] if self.timer.exists() else 0
        due, later = [], []
        for b, n in sorted(tuple(k) for k in self.waiting.keys()) if self.waiting.exists() else []:
            if b * self.bucket_ms > now:
                later.append(b * self.bucket_ms)
                continue
            table = pa.ipc.open_stream(self.waiting.getValue((b, n))[0]).read_all()
            ready = table.column("at").to_numpy() <= now
            due.append(table.filter(pa.array(ready)))
            if ready.all():
                self.waiting.removeKey((b, n))
            else:
                rest = table.filter(pa.array(~ready))
                self.waiting.updateValue((b, n), (_packed(rest),))
                later.append(int(rest.column("at").to_numpy().min()))
        state = tuple(self.open.get()) if self.open.exists() else None
        before = state
        out = []
        if due:
            table = pa.concat_tables(due).sort_by([("at", "ascending"), ("pos", "ascending")])
            for row in zip(*(table.column(c).to_pylist() for c in self.names)):
                state = self.step(key, state, row, out)
        if state is not None and self.deadline(state) <= now:
            self.emit(key, state, out)
            state = None
        if state is None:
            if before is not None:
                self.open.clear()
        elif state != before:
            self.open.update(state)
        wake = [min(later) + 1] if later else []
        wake += [self.deadline(state)] if state is not None else []
        self._wake(min(wake, default=None), parts)
        if out:
            yield self.frame(out)

    def frame(self, out) -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=self.out.names, dtype=object)
        return pdf.astype({f.name: "Int64" for f in self.out if isinstance(f.dataType, IntegralType)})

    def close(self) -> None:
        """Nothing is held outside the state store."""


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


class StrideProcessor(_Ordered):
    """Constant-stride streams; the rules of the batch operator, one record at a time."""

    def __init__(self, columns: StructType, out: StructType, legal: Sequence[int], unit_ms: int, bucket_ms: int):
        kind = columns["fmt"].dataType.simpleString()
        super().__init__(columns, f"at long, start long, end long, records long, stride long, fmt {kind}, sounding long", out, bucket_ms)
        self.legal, self.unit_ms = frozenset(legal), unit_ms

    def deadline(self, state) -> int:
        # One unit past the furthest position that could still continue the stream.
        reach = state[4] if state[4] > 0 else max(self.legal)
        return int(state[0]) + (reach + 1) * self.unit_ms

    def step(self, key, state, row, out):
        at, pos, stream, end_mark, fmt, silent = row
        if stream:
            if state is not None:
                gap = pos - state[2]
                if fmt != state[5] or gap not in self.legal or state[4] not in (-1, gap):
                    self.emit(key, state, out)
                    state = None
                else:
                    state = (at, state[1], pos, state[3] + 1, gap, fmt, state[6] + int(not silent))
            if state is None:
                state = (at, pos, pos, 1, -1, fmt, int(not silent))
        if end_mark and state is not None:
            self.emit(key, state, out)
            state = None
        return state

    def emit(self, key, state, out) -> None:
        _, start, end, records, stride, fmt, sounding = state
        if records > 1 or sounding > 0:
            out.append((key[0], key[1], start, end, records, None if stride < 0 else stride, fmt, sounding))


class PairProcessor(_Ordered):
    """A left row waits for the right row at the next position."""

    def __init__(self, columns: StructType, out: StructType, unit_ms: int, bucket_ms: int):
        super().__init__(columns, f"at long, pos long, value {columns['value'].dataType.simpleString()}", out, bucket_ms)
        self.unit_ms = unit_ms

    def deadline(self, state) -> int:
        return int(state[0]) + 2 * self.unit_ms

    def step(self, key, state, row, out):
        at, pos, is_left, value = row
        if is_left:
            if state is not None:
                self.emit(key, state, out)
            return (at, pos, value)
        if state is not None and state[1] + 1 == pos:
            out.append((key[0], state[1], pos, state[2], value))
            return None
        if state is not None:
            self.emit(key, state, out)
        out.append((key[0], None, pos, None, value))
        return None

    def emit(self, key, state, out) -> None:
        out.append((key[0], state[1], None, state[2], None))


def _typed(fields: Sequence[tuple[str, DataType]]) -> StructType:
    return StructType([StructField(n, t) for n, t in fields])


def _rows(sdf: DataFrame, keys: Sequence[str], columns: Sequence[str], ts: str, delay: str) -> tuple[DataFrame, StructType]:
    """The watermarked rows with ``at`` in milliseconds, and the columns that wait in the state."""
    rows = sdf.withWatermark(ts, delay).select(*keys, ts, F.unix_millis(ts).alias("at"), F.col("pos").cast("long").alias("pos"), *columns)
    return rows, _typed([(n, rows.schema[n].dataType) for n in ("at", "pos", *columns)])


def stream_segments(sdf: DataFrame, *, legal: Sequence[int] = tuple(range(1, 9)), unit_ms: int,
                    ts: str = "ts", delay: str = "1 hour", bucket_ms: int | None = None) -> DataFrame:
    """Constant-stride segments of a stream of ``src, channel, pos, stream, end_mark, fmt, silent``.

    ``unit_ms`` is the event time between neighbouring positions, ``bucket_ms`` that of a bucket of waiting rows (16 positions).
    ``src``, ``channel`` and ``fmt`` may have any type and keep it.
    """
    rows, columns = _rows(sdf, ("src", "channel"), ("stream", "end_mark", "fmt", "silent"), ts, delay)
    whole = LongType()
    out = _typed([("src", sdf.schema["src"].dataType), ("channel", sdf.schema["channel"].dataType), ("start", whole), ("end", whole),
                  ("records", whole), ("stride", whole), ("fmt", sdf.schema["fmt"].dataType), ("sounding", whole)])
    return rows.groupBy("src", "channel").transformWithStateInPandas(
        statefulProcessor=StrideProcessor(columns, out, legal, unit_ms, bucket_ms or 16 * unit_ms), outputStructType=out,
        outputMode="Append", timeMode="EventTime")


def stream_pairs(sdf: DataFrame, *, unit_ms: int, ts: str = "ts", delay: str = "1 hour", bucket_ms: int | None = None) -> DataFrame:
    """Adjacent left/right pairs of a stream of ``src, pos, is_left, value``; ``src`` and ``value`` keep their types."""
    rows, columns = _rows(sdf, ("src",), ("is_left", "value"), ts, delay)
    value, whole = sdf.schema["value"].dataType, LongType()
    out = _typed([("src", sdf.schema["src"].dataType), ("left_pos", whole), ("right_pos", whole), ("left_value", value), ("right_value", value)])
    return rows.groupBy("src").transformWithStateInPandas(
        statefulProcessor=PairProcessor(columns, out, unit_ms, bucket_ms or 16 * unit_ms), outputStructType=out,
        outputMode="Append", timeMode="EventTime")
