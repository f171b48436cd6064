"""Rows whose keys are null form a run like any other; null positions are refused."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seqmine.demo import conventions
from seqmine.operators import intervals, segment
from seqmine.plans.blocks import (by_density, by_position, catch_up, dense_index, last_where, Run, run_totals, running, segment_groups,
                                  shifted)
from test_blocks import runs

WIDTHS = (3, 17, 1000)


def both(spark, channel):
    """The same rows under a null key and under a key of their own."""
    rows = [(pos, v, f) for src, pos, v, f in runs(5, n_src=1)]
    df = spark.createDataFrame(rows, "pos long, v long, f boolean")
    keyed = lambda src: df.select(F.lit(src).cast("string").alias("src"), F.lit(channel).cast("long").alias("channel"), "*")
    return keyed(None).unionByName(keyed("a")).unionByName(keyed("b")), len(rows)


def agree(df, n=None):
    """Rows of the null key equal those of ``a``; returns their number."""
    rest = [c for c in df.columns if c not in ("src", "blk", "sub")]
    found = {None: [], "a": [], "b": []}
    for r in df.collect():
        found[r.src].append(repr([r[c] for c in rest]))
    assert sorted(found[None]) == sorted(found["a"]) == sorted(found["b"]) and found[None]
    assert n is None or len(found[None]) == n


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("channel", (None, 1))
def test_block_functions(spark, width, channel):
    base, n = both(spark, channel)
    df, run = by_position(base, ["src", "channel"], width=width)
    agree(running(df, run, sums={"s": F.col("v")}, maxes={"m": F.col("v")}, lasts={"l": F.when(F.col("f"), F.col("pos"))}), n)
    agree(run_totals(df, run, mins={"lo": F.col("v")}, maxes={"hi": F.col("v")}), n)
    agree(shifted(df, run, ["v"], reverse=True), n)
    agree(last_where(df, run, ["v"], {"seg": (lambda p, c: c("v") < p("v"), True)}, index="i"), n)
    agree(catch_up(df, run, F.col("pos"), F.lit(1).cast("bigint")), n)
    agree(segment_groups(df, run, ["v"], lambda p, c: c("v") < p("v"), sums={"rows": F.lit(1).cast("bigint")}))
    agree(segment.islands(df, run, "f"))
    agree(segment.segment_by_gap(df, run, gap=3), n)
    stream = base.select("src", "channel", "pos", (F.col("v") > 0).alias("stream"), (F.col("v") == 0).alias("end_mark"),
                         F.lit(False).alias("fmt"), F.lit(False).alias("silent"))
    agree(segment.segment_constant_stride(stream, width=width))
    cells, block = by_density(base, ["src", "channel"], "v", "pos", width)
    agree(dense_index(cells, Run(("src", "channel"), ("v", "pos"), block)), n)
    items = base.select("src", F.col("pos").alias("start"), (F.col("pos") + 2).alias("end"), "v")
    agree(intervals.flag_content(items, base, {"flagged": F.col("f")}, width=width), n)


def test_null_position(spark):
    df, run = by_position(spark.createDataFrame([("a", 1), ("a", None)], "src string, pos long"), ["src"])
    with pytest.raises(PySparkException, match="null position"):
        dense_index(df, run).collect()


def test_demo_tables_keep_every_event(spark):
    d = "/root/testdata/sf0.001"
    events = conventions.table(spark, d, "events").count()
    for rows, keys in ((conventions.hour_events(spark, d), ["src", "pos"]), (conventions.day_events(spark, d), ["src", "channel", "pos"])):
        assert rows.count() == rows.select(*keys).distinct().count() == events
