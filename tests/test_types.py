"""Operators keep the types of sources, ids and payloads."""

from pyspark.sql import functions as F

from seqmine.operators import intervals, items, segment
from seqmine.plans.blocks import by_position


def test_binary_payload(spark):
    rows = [("a", 0, bytes([0xFF, 0, 1])), ("a", 1, bytes([0xFE, 2])), ("b", 0, b"")]
    df, run = by_position(spark.createDataFrame(rows, "src string, pos long, payload binary"), ["src"])
    found = {r.src: r.payload for r in segment.concat_payload(df, run).collect()}
    assert {k: bytes(v) for k, v in found.items()} == {"a": bytes([0xFF, 0, 1, 0xFE, 2]), "b": b""}


def test_string_sources_in_reports(spark):
    named = spark.createDataFrame([("file.bin", 3)], "src string, pos long")
    numbered = spark.createDataFrame([(7, 4)], "src long, pos long")
    parts = [items.anomalies("x", df, src="src", pos="pos", detail=F.lit("d")) for df in (named, numbered)]
    assert {(r.src, r.pos) for r in items.anomaly_report(parts).collect()} == {("file.bin", 3), ("7", 4)}


def test_string_ids_of_disjoint_items(spark):
    rows = [("s", "f", 1, 5, "p", 0), ("s", "f", 4, 8, "q", 0), ("s", "f", 9, 12, "r", 0), ("s", "g", 1, 3, "t", 0)]
    df = spark.createDataFrame(rows, "src string, fmt string, start long, end long, id string, past long")
    for limit in (0, 4096):
        found = intervals.longest_disjoint(df, parent=["src"], fmt="fmt", past="past", fold_limit=limit)
        assert sorted(r.id for r in found.collect()) == ["p", "r"]
