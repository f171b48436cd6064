"""Rates over several rounds of gaps, hypotheses left by each round, templates, null keys."""

import random

import pytest

from seqmine.operators import rates
from seqmine.operators.rates import Template
from seqmine.plans.blocks import Run, by_position
from seqmine.session import cut


def frames_of(rng, count, step, jitter, broken=None):
    """Frames about ``step`` apart; number ``broken`` is one position late for every interval."""
    at, out = rng.randint(0, 3), []
    for k in range(count):
        start = at + k * step + rng.randint(0, jitter) + (jitter + step // 2 if k == broken else 0)
        out.append((start, start + rng.randint(0, max(0, step - jitter - 2))))
    return [(s, min(e, out[i + 1][0] - 1) if i + 1 < count else e) for i, (s, e) in enumerate(out)]


def gaps_of(frames):
    return [(a[1] + 1, b[0]) for a, b in zip(frames, frames[1:])]


def alive(gaps, upto):
    """All (p, n) longer than the shortest later gap that hold in gaps 2 to ``upto``, by trial."""
    sure = min(hi - lo + 1 for lo, hi in gaps[1:])
    return {(p, n) for p in range(gaps[0][0], gaps[0][1] + 1) for n in range(max(2, sure + 1), gaps[1][1] - p + 1)
            if all((hi - p) // n * n >= lo - p for lo, hi in gaps[1:upto])}


@pytest.fixture
def small_rounds(monkeypatch):
    monkeypatch.setattr(rates, "GROWTH", 3)
    monkeypatch.setattr(rates, "WORD", 5)
    monkeypatch.setattr(rates, "LISTED", 8)


def test_hypotheses_left_by_each_round(spark, small_rounds):
    rng = random.Random(5)
    runs = {k: frames_of(rng, rng.choice([3, 4, 9, 30, 50]), rng.randint(3, 30), rng.choice([0, 1, 2]), rng.choice([None, None, 7, 25])) for k in range(16)}
    runs[99] = [(0, 0), (40, 40), (41, 41), (90, 90), (1000, 1000), (100_000, 100_000)]
    runs = {k: f for k, f in runs.items() if all(s <= e for s, e in f) and all(a[1] < b[0] for a, b in zip(f, f[1:]))}
    assert len(runs) > 8
    rows = [(k if k else None, s, e) for k, f in runs.items() for s, e in f]
    df, run = by_position(spark.createDataFrame(rows, "src long, start long, end long"), ["src"], "start", 64)
    run = Run(("src",), ("start",))
    gaps = cut(rates.frame_gaps(df, run))
    left = rates.hypotheses(rates.first_gaps(gaps, ["src"]), ["src"])
    low, high, counts = 2 + rates.EARLY, rates.EARLY * rates.GROWTH, []
    reached = 2 + rates.EARLY
    for _ in range(4):
        found = left.collect()
        want = {(k, p, n) for k, f in runs.items() for p, n in alive(gaps_of(f), reached - 1)}
        assert sorted((r.src or 0, r.p, r.n) for r in found) == sorted(want)
        counts.append(len(found))
        left = cut(rates.survivors(left, gaps, ["src"], low, high))
        reached, low, high = high, high, high * rates.GROWTH
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[-1] > 0
    got = {r.src or 0: r.interval for r in rates.infer_interval(df, run).collect()}
    for k, f in runs.items():
        gaps_k = gaps_of(f)
        best = [n for p in range(gaps_k[0][0], gaps_k[0][1] + 1) for n in range(2, gaps_k[1][1] - p + 1)
                if all((hi - p) // n * n >= lo - p for lo, hi in gaps_k[1:])]
        assert got[k] == max(best, default=1), k


def test_templates_and_null_keys(spark):
    templates = [Template("loop", 15, 2, ((0, 6), (7, 14), (7, 9)), 15), Template("once", 8, 1, ((0, 7), (8, 15), (16, 23)))]
    runs = {1: [(100, 102), (107, 110), (115, 115), (122, 129)], None: [(5, 5), (13, 14), (21, 22)], 3: [(0, 0), (7, 15)], 4: [(9, 9)],
            5: [(0, 1), (16, 18), (40, 41)]}
    rows = [(k, s, e) for k, f in runs.items() for s, e in f]
    df, _ = by_position(spark.createDataFrame(rows, "src long, start long, end long"), ["src"], "start", 16)
    found = {r.src: (r.method, r.num, r.den) for r in rates.choose_rate(df, Run(("src",), ("start",)), templates).collect()}
    assert found[1] == ("template", 15, 2) and found[None] == ("template", 8, 1) and found[4] == ("each", 1, 1)
    assert found[3][0] == "average" and found[5][0] in ("interval", "average")
    relative = df.join(df.groupBy("src").min("start"), "src").selectExpr("src", "start - `min(start)` AS start", "end - `min(start)` AS end")
    plan = rates.match_template(cut(relative), templates)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize("reach", [4, 64])
def test_hypotheses_are_tested_where_they_are_listed(spark, small_rounds, monkeypatch, reach):
    """Runs shorter than ``reach`` leave one row per row of starts, longer ones all that holds; small arrays change nothing."""
    monkeypatch.setattr(rates, "REACH", reach)
    rng = random.Random(8)
    runs = {k: frames_of(rng, rng.choice([3, 5, 20]), rng.randint(3, 40), rng.choice([0, 1, 2]), rng.choice([None, 4])) for k in range(12)}
    runs[50] = [(0, 0), (300, 300), (301, 301), (900, 900), (5000, 5000)]
    runs = {k: f for k, f in runs.items() if all(s <= e for s, e in f) and all(a[1] < b[0] for a, b in zip(f, f[1:]))}
    rows = [(k if k else None, s, e) for k, f in runs.items() for s, e in f]
    df, run = by_position(spark.createDataFrame(rows, "src long, start long, end long"), ["src"], "start", 64)
    early = cut(rates.first_gaps(rates.frame_gaps(df, Run(("src",), ("start",))), ["src"]))
    found = rates.hypotheses(early, ["src"], reach, best=True).collect()
    per_run = {}
    for r in found:
        per_run.setdefault(r.src or 0, []).append((r.p, r.n))
    for k, f in runs.items():
        want = alive(gaps_of(f), reach + 1)
        got = set(per_run.get(k, []))
        assert got <= want
        if len(f) - 1 > reach + 1:
            assert got == want
        else:
            width = gaps_of(f)[0][1] - gaps_of(f)[0][0] + 1
            assert len(got) <= -(-width // rates.STARTS) and max((n for _, n in got), default=0) == max((n for _, n in want), default=0)
    monkeypatch.setattr(rates, "TRIED", 7)
    got = {r.src or 0: r.interval for r in rates.infer_interval(df, Run(("src",), ("start",))).collect()}
    for k, f in runs.items():
        gaps_k = gaps_of(f)
        best = [n for p in range(gaps_k[0][0], gaps_k[0][1] + 1) for n in range(2, gaps_k[1][1] - p + 1)
                if all((hi - p) // n * n >= lo - p for lo, hi in gaps_k[1:])]
        assert got[k] == max(best, default=1), k


def test_slices_of_repeated_numbers(monkeypatch):
    """Slices stay small and hold every number, also of an index that alone fills more than one."""
    monkeypatch.setattr(rates, "TRIED", 5)
    count = rates.np.array([2, 0, 9, 1, 4])
    parts = list(rates._repeated(count))
    assert [(i, k) for index, n in parts for i, k in zip(index.tolist(), n.tolist())] == [(i, k) for i, c in enumerate(count) for k in range(c)]
    assert max(len(index) for index, _ in parts) == 9
