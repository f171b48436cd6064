"""What a task holds is bounded where the number of rows is known, with the same results."""

import random

import pytest

from seqmine.operators import intervals
from seqmine.plans import blocks


@pytest.fixture
def small_tasks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "TASK_ROWS", 50)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_silent_pieces_in_tasks_of_bounded_size(spark, small_tasks):
    rng = random.Random(4)
    pieces = [(rng.choice([None, 1, 2]), rng.randrange(4), s, s + rng.randrange(30)) for s in [rng.randrange(400) for _ in range(120)]]
    sounding = [(rng.choice([None, 1, 2]), rng.randrange(4), rng.randrange(430)) for _ in range(300)]
    held = spark.createDataFrame(pieces, "src long, id long, start long, end long")
    at = spark.createDataFrame(sounding, "src long, id long, pos long")
    found = intervals.mark_silent_pieces(held, at, width=64, size=300)
    want = sorted((s or 0, i, a, b, not any(x == s and y == i and a <= p <= b for x, y, p in sounding)) for s, i, a, b in pieces)
    assert sorted((r.src or 0, r.id, r.start, r.end, r.silent) for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffles and all(", 6), REPARTITION_BY_NUM" in line for line in shuffles), plan
    plain = intervals.mark_silent_pieces(held, at, width=64)
    assert sorted((r.src or 0, r.id, r.start, r.end, r.silent) for r in plain.collect()) == want
    assert "REPARTITION_BY_NUM" not in plain._jdf.queryExecution().executedPlan().toString()


def test_split_items_in_tasks_of_bounded_size(spark, small_tasks):
    rng = random.Random(6)
    audio = [(rng.choice([None, 1, 2, 3]), i, a, a + rng.randrange(500), 1 + i % 7) for i, a in enumerate(rng.randrange(900) for _ in range(90))]
    video = [(rng.choice([None, 1, 2, 3]), rng.randrange(1200)) for _ in range(120)]
    items = spark.createDataFrame(audio, "src long, id long, start long, end long, stride long")
    cuts = spark.createDataFrame(video, "src long, start long")
    rows = lambda df: sorted((r.src or 0, r.id, r.start, r.end) for r in df.collect())
    bounded = intervals.split_intervals(items, cuts, size=300)
    assert rows(bounded) == rows(intervals.split_intervals(items, cuts)) == rows(intervals.split_intervals(items, cuts, few=5, size=300))
    plan = bounded._jdf.queryExecution().executedPlan().toString()
    shuffles = [line.strip(" :+-") for line in plan.splitlines() if "Exchange" in line]
    assert all("REPARTITION_BY_NUM" in line for line in shuffles), shuffles
    assert bounded.rdd.getNumPartitions() == 6
