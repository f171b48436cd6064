"""Streaming queries over files that Spark derives from the driver tables.

Each writes to a table in the shared folder and returns that table.  A closing row
far in the future moves the watermark past all data, as the end of input does not.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seqmine.demo import conventions as c
from seqmine.demo import segments
from seqmine.session import RECOMMENDED, scratch_path
from seqmine.streaming import counts, segments as ss

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
DAY_MS = 86_400_000
FAR = 50_000
# Day 0 of the conventions is 2024-01-01; positions must lie after the initial watermark.
DAY_ZERO = 19_723


def _feed(spark, rows, name):
    """``rows`` as a file stream; ``pos`` in days becomes the event time ``ts``."""
    path = scratch_path(spark, name)
    rows.write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return stream.withColumn("ts", F.timestamp_seconds((F.col("pos") + DAY_ZERO) * 86_400))


def _drain(spark, sdf, name):
    spark.conf.set(STATE_PROVIDER, RECOMMENDED[STATE_PROVIDER])
    path = scratch_path(spark, name)
    query = (sdf.writeStream.format("parquet").option("path", path)
             .option("checkpointLocation", scratch_path(spark, name + "-progress"))
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(path)


def _closing(rows, **values):
    """One row at position ``FAR`` with nulls or the given values in the other columns."""
    spark = rows.sparkSession
    cols = [F.lit(FAR if f.name == "pos" else values.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema]
    return rows.unionByName(spark.range(1).select(*cols))


def stride(spark, d):
    rows = _closing(c.day_events(spark, d), src=-1, channel=-1, stream=False, end_mark=True, fmt=False, silent=True)
    return _drain(spark, ss.stream_segments(_feed(spark, rows, "stride"), legal=c.LEGAL_STRIDES, unit_ms=DAY_MS), "stride-out")


def gaps(spark, d):
    rows = _closing(c.day_events(spark, d).select("src", "pos"), src=-1)
    out = ss.stream_gap_segments(_feed(spark, rows, "gaps"), gap="36 hours")
    day = lambda x: F.floor(F.unix_seconds(x) / 86_400) - DAY_ZERO
    return _drain(spark, out.select("src", "records", day("start").alias("start"), day("end").alias("end")), "gaps-out")


def class_counts(spark, d):
    e = c.table(spark, d, "events").select(F.expr("timestampdiff(DAY, timestamp_ntz'2024-01-01 00:00:00', ts)").alias("pos"),
                                           F.col("event_type").alias("class"))
    out = counts.stream_counts(_feed(spark, _closing(e, **{"class": "end"}), "counts"), window="2 days")
    day = (F.floor(F.unix_seconds("window_start") / 86_400) - DAY_ZERO).alias("day")
    return _drain(spark, out.select(day, "class", "records"), "counts-out")


def pairs(spark, d):
    t = c.turns(spark, d).where(F.col("role").isin("user", "assistant")).select(
        "src", "pos", (F.col("role") == "user").alias("is_left"), F.length("text").cast("bigint").alias("value"))
    rows = _closing(t, src=-1, is_left=True, value=0)
    return _drain(spark, ss.stream_pairs(_feed(spark, rows, "pairs"), unit_ms=DAY_MS), "pairs-out")


QUERIES = {
    "stream_segments": stride,
    "stream_gap_segments": gaps,
    "stream_counts": class_counts,
    "stream_pairs": pairs,
}

ORACLES = {
    "stream_segments": segments.ORACLES["segment_constant_stride"],
    "stream_gap_segments": c.with_(c.DAY_EVENTS) + """
, p AS (SELECT src, pos FROM day_events),
g AS (SELECT src, pos, sum(CASE WHEN before IS NULL OR pos > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY pos) AS seg
      FROM (SELECT src, pos, lag(pos) OVER (PARTITION BY src ORDER BY pos) AS before FROM p))
SELECT src, count(*) AS records, min(pos) AS "start", max(pos) AS "end" FROM g GROUP BY src, seg""",
    "stream_counts": """
SELECT epoch_us(ts) // 86400000000 // 2 * 2 - 19723 AS "day", event_type AS class, count(*) AS records FROM events GROUP BY 1, 2""",
    "stream_pairs": segments.ORACLES["pair_adjacent"],
}
