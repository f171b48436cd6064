"""Streams that arrive in several batches, out of order and late."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqmine.operators.segment import segment_constant_stride
from seqmine.session import RECOMMENDED
from seqmine.streaming import segments as ss

SCHEMA = "src long, channel long, pos long, stream boolean, end_mark boolean, fmt boolean, silent boolean"
UNIT_MS = 60_000
LEGAL = (1, 2, 3)


@pytest.fixture
def feed(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, RECOMMENDED[key])

    def run(batches, build, schema=SCHEMA):
        source = tmp_path / "in"
        source.mkdir()
        for i, rows in enumerate(batches):
            path = str(tmp_path / f"batch{i}")
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
            part = next(f for f in os.listdir(path) if f.endswith(".parquet"))
            target = source / f"{i}.parquet"
            target.write_bytes(open(os.path.join(path, part), "rb").read())
            os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
        stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
                  .withColumn("ts", F.timestamp_millis(F.lit(UNIT_MS) * (F.col("pos") + 1000))))
        query = (build(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
                 .option("checkpointLocation", str(tmp_path / "progress")).outputMode("append")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")), query
    return run


def test_batches_match_the_batch_operator(spark, feed):
    rng = random.Random(12)
    rows = []
    for src in range(4):
        for channel in range(2):
            pos = rng.randint(0, 5)
            while pos < 200:
                kind = rng.random()
                rows.append((src, channel, pos, kind < 0.92, kind >= 0.92, rng.random() < 0.05, rng.random() < 0.4))
                pos += rng.choice([1, 2, 2, 2, 3, 6])
    # Positions are out of order by up to 5 between batches, less than the watermark delay.
    arrival = sorted(rows, key=lambda r: r[2] + rng.randint(0, 5))
    batches = [arrival[k:k + 90] for k in range(0, len(arrival), 90)]
    batches.append([(-1, -1, 5000, False, True, False, True)])
    got, _ = feed(batches, lambda s: ss.stream_segments(s, legal=LEGAL, unit_ms=UNIT_MS, delay="10 minutes"))
    want = segment_constant_stride(spark.createDataFrame(rows, SCHEMA), legal=LEGAL)
    cols = ["src", "channel", "start", "end", "records", "stride", "fmt", "sounding"]
    plain = lambda df: sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
    assert plain(got) == plain(want)


def test_rows_behind_the_watermark_are_dropped_and_counted(feed):
    row = lambda pos: (1, 0, pos, True, False, False, False)
    batches = [[row(100), row(101)], [row(200)], [row(50), row(201)], [(-1, -1, 5000, False, True, False, True)]]
    got, query = feed(batches, lambda s: ss.stream_segments(s, legal=LEGAL, unit_ms=UNIT_MS, delay="10 minutes"))
    assert sorted((r.start, r.end) for r in got.collect()) == [(100, 101), (200, 201)]
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert dropped == 1


def test_names_of_any_type(feed):
    schema = SCHEMA.replace("src long", "src string").replace("channel long", "channel string").replace("fmt boolean", "fmt string")
    rows = [("disc", "left", p, True, False, "a" if p < 6 else "b", False) for p in range(0, 12, 2)] + [(None, "left", 3, True, False, None, False)]
    batches = [rows[::2], rows[1::2], [("end", "end", 5000, False, True, "a", True)]]
    got, _ = feed(batches, lambda s: ss.stream_segments(s, legal=LEGAL, unit_ms=UNIT_MS, delay="20 minutes"), schema)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [("disc", "left", 0, 4, 3, 2, "a", 3), ("disc", "left", 6, 10, 3, 2, "b", 3), (None, "left", 3, 3, 1, None, None, 1)], key=str)


class _Store(dict):
    """A state that counts what is read from it."""

    reads = 0

    def exists(self):
        return bool(self)

    def getValue(self, key):
        self.reads += 1
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def get(self):
        return self[0]

    def update(self, value):
        self[0] = value


class _Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getMapState(self, name, *_):
        return self.states.setdefault(name, _Store())

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class _Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def test_a_timer_reads_only_what_is_due():
    columns = StructType.fromDDL("at long, pos long, is_left boolean, value long")
    out = StructType.fromDDL("src long, left_pos long, right_pos long, left_value long, right_value long")
    handle, work = _Handle(), ss.PairProcessor(columns, out, unit_ms=10, bucket_ms=100)
    work.init(handle)
    pdf = pd.DataFrame({"at": range(0, 10_000, 10), "pos": range(1000), "is_left": [k % 2 == 0 for k in range(1000)], "value": range(1000)})
    list(work.handleInputRows((1,), iter([pdf]), None))
    found = []
    for now in range(50, 10_100, 100):
        due = [t for t in handle.timers if t <= now]
        assert len(handle.timers) <= 1
        for t in due:
            found += list(work.handleExpiredTimer((1,), _Clock(now), None))
            handle.timers.discard(t)
    # Each bucket is read at most twice: cut at a watermark, then to its end.
    assert handle.states["waiting"].reads <= 200 and not handle.states["waiting"]
    pairs = pd.concat(found)
    assert len(pairs) == 500 and (pairs.right_pos - pairs.left_pos == 1).all()
