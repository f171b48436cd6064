"""Blocked windows against plain-Python simulations, with blocks of a few rows."""

import random

from pyspark.sql import functions as F

from seqmine.operators.segment import segment_constant_stride
from seqmine.plans.blocks import (by_position, catch_up, dense_index, last_where, run_totals,
                                  running, segment_groups, shifted)
from seqmine.plans.chains import reachable
from seqmine.plans.ranges import overlap_pairs


def runs(seed, n_src=6, n=120, step=4):
    rng = random.Random(seed)
    rows = []
    for src in range(n_src):
        pos = 0
        for _ in range(rng.randint(1, n)):
            pos += rng.randint(1, step)
            rows.append((src, pos, rng.randint(0, 5), rng.random() < 0.2))
    return rows


def by_src(rows):
    out = {}
    for r in sorted(rows):
        out.setdefault(r[0], []).append(r)
    return out


def test_running_and_shift(spark):
    rows = runs(1)
    df, run = by_position(spark.createDataFrame(rows, "src long, pos long, v long, f boolean"),
                          ["src"], width=7)
    out = running(df, run, sums={"s": F.col("v")}, maxes={"m": F.col("v")}, mins={"lo": F.col("v")},
                  lasts={"l": F.when(F.col("f"), F.col("v"))})
    out = dense_index(shifted(out, run, ["v", "pos"], "prev"), run)
    got = {(r.src, r.pos): (r.s, r.m, r.lo, r.l, r.prev and r.prev.pos, r.idx) for r in out.collect()}
    back = running(df, run, lasts={"l": F.when(F.col("f"), F.col("pos"))}, mins={"lo": F.col("v")},
                   reverse=True, exclusive=True)
    got_back = {(r.src, r.pos): (r.l, r.lo) for r in shifted(back, run, ["pos"], "n", True).collect()}
    assert len(got) == len(rows)
    for src, rs in by_src(rows).items():
        last = prev = None
        for i, (_, pos, v, f) in enumerate(rs):
            last = v if f else last
            seen = [x[2] for x in rs[:i + 1]]
            assert got[src, pos] == (sum(seen), max(seen), min(seen), last, prev, i)
            after = rs[i + 1:]
            assert got_back[src, pos] == (next((x[1] for x in after if x[3]), None),
                                          min((x[2] for x in after), default=None))
            prev = pos


def test_totals_and_groups(spark):
    rows = runs(7, step=5)
    base = spark.createDataFrame(rows, "src long, pos long, v long, f boolean")
    for width in (4, 1000):
        df, run = by_position(base, ["src"], width=width)
        totals = {(r.src, r.lo, r.hi) for r in run_totals(df, run, mins={"lo": F.col("v")}, maxes={"hi": F.col("pos")}).collect()}
        groups = segment_groups(df, run, ["pos", "f"], lambda prev, cur: (cur("pos") - prev("pos") > 3) | (cur("f") != prev("f")),
                                sums={"n": F.lit(1), "s": F.col("v")}, mins={"a": F.col("pos")}, maxes={"b": F.col("pos")})
        got = sorted((r.src, r.seg, r.n, r.s, r.a, r.b) for r in groups.collect())
        want, edges = [], set()
        for src, rs in by_src(rows).items():
            edges.add((src, min(r[2] for r in rs), rs[-1][1]))
            part = []
            for r in rs + [None]:
                if part and (r is None or r[1] - part[-1][1] > 3 or r[3] != part[-1][3]):
                    want.append((src, part[0][1], len(part), sum(x[2] for x in part), part[0][1], part[-1][1]))
                    part = []
                part.append(r)
        assert got == sorted(want) and totals == edges


def test_segment_by_gap_and_carry(spark):
    rows = runs(2, step=5)
    df, run = by_position(spark.createDataFrame(rows, "src long, pos long, v long, f boolean"),
                          ["src"], width=6)
    rule = lambda prev, cur: (cur("pos") - prev("pos") > 3) | (cur("f") != prev("f"))
    out = last_where(df, run, ["pos", "f", "v"], {"seg": (rule, True)}, carry_fields=["v"], index="i",
                     keep_prev=True)
    got = {(r.src, r.pos): (r.seg, r.seg_v, r.prev and r.prev.pos, r.i, r.seg_i) for r in out.collect()}
    for src, rs in by_src(rows).items():
        seg = prev = None
        for i, r in enumerate(rs):
            if prev is None or r[1] - prev[1] > 3 or r[3] != prev[3]:
                seg, at = r, i
            assert got[src, r[1]] == (seg[1], seg[2], prev and prev[1], i, at)
            prev = r


def stride_simulation(rows, legal):
    """Direct state machine over (src, channel): list of finished streams."""
    out, state = [], {}

    def close(key):
        s = state.pop(key)
        if s["n"] > 1 or s["loud"]:
            out.append((*key, s["start"], s["end"], s["n"], s["stride"], s["fmt"], s["loud"]))

    for src, ch, pos, stream, mark, fmt, silent in sorted(rows):
        key = (src, ch)
        if stream:
            s = state.get(key)
            if s:
                gap = pos - s["end"]
                if fmt != s["fmt"] or gap not in legal or s["stride"] not in (None, gap):
                    close(key)
                else:
                    s.update(end=pos, stride=gap, n=s["n"] + 1, loud=s["loud"] + (not silent))
            if key not in state:
                state[key] = dict(start=pos, end=pos, n=1, stride=None, fmt=fmt, loud=int(not silent))
        if mark and key in state:
            close(key)
    for key in list(state):
        close(key)
    return sorted(out, key=str)


def test_constant_stride_matches_state_machine(spark):
    rng = random.Random(5)
    rows = []
    for src in range(40):
        for ch in range(2):
            pos = rng.randint(0, 3)
            for _ in range(rng.randint(1, 150)):
                kind = rng.random()
                rows.append((src, ch, pos, kind < 0.93, kind > 0.9, int(rng.random() < 0.05), rng.random() < 0.4))
                pos += rng.choice([1, 1, 2, 2, 2, 3, 5] if rng.random() < 0.7 else [2])
    rows.append((99, 255, 4, False, True, 0, True))
    df = spark.createDataFrame(
        rows, "src long, channel int, pos long, stream boolean, end_mark boolean, fmt int, silent boolean")
    want = stride_simulation(rows, {1, 2, 3, 4})
    for width in (1, 40, 1 << 20):
        out = segment_constant_stride(df, legal=(1, 2, 3, 4), width=width)
        got = sorted([(r.src, r.channel, r.start, r.end, r.records, r.stride, r.fmt, r.sounding)
                      for r in out.collect()], key=str)
        assert got == want


def test_catch_up(spark):
    rows = runs(3, step=9)
    df, run = by_position(spark.createDataFrame(rows, "src long, pos long, v long, f boolean"),
                          ["src"], width=11)
    got = {(r.src, r.pos): (r.filler, r.written) for r in catch_up(df, run, F.col("pos"), F.col("v")).collect()}
    for src, rs in by_src(rows).items():
        written = 0
        for _, pos, v, _ in rs:
            fill = max(0, pos - written)
            assert got[src, pos] == (fill, written)
            written += fill + v


def test_overlap_pairs(spark):
    rng = random.Random(9)
    make = lambda n: [(i, rng.randint(0, 2), s := rng.randint(-2500, 2500), s + int(rng.expovariate(1 / rng.choice([1, 20, 900]))))
                      for i in range(n)]
    a, b = make(150), make(150)
    da = spark.createDataFrame(a, "a long, src long, a0 long, a1 long")
    db = spark.createDataFrame(b, "b long, src long, b0 long, b1 long")
    got = sorted((r.a, r.b) for r in overlap_pairs(da, db, ["src"], ("a0", "a1"), ("b0", "b1")).collect())
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    assert got == want


def test_overlap_table(spark):
    cases = [(0, 5, 0), (5, 10, 1), (5, 15, 6), (10, 15, 6), (10, 20, 11), (12, 15, 4), (15, 20, 6),
             (15, 25, 6), (20, 25, 1), (25, 28, 0)]
    a = spark.createDataFrame([(1, 10, 20)], "src long, a0 long, a1 long")
    b = spark.createDataFrame([(1, s, e) for s, e, _ in cases], "src long, b0 long, b1 long")
    size = F.least("a1", "b1") - F.greatest("a0", "b0") + 1
    got = {(r.b0, r.b1): r.n for r in overlap_pairs(a, b, ["src"], ("a0", "a1"), ("b0", "b1"))
           .withColumn("n", size).collect()}
    assert got == {(s, e): n for s, e, n in cases if n}
    flipped = overlap_pairs(b, a, ["src"], ("b0", "b1"), ("a0", "a1")).withColumn("n", size)
    assert {(r.b0, r.b1): r.n for r in flipped.collect()} == got


def test_reachable(spark):
    nodes = [(1, i, i + (2 if i % 3 else 1) if i < 199 else None, i == 0) for i in range(200)]
    got = sorted(r.node for r in reachable(
        spark.createDataFrame(nodes, "src long, node long, next long, root boolean"), ["src"]).collect())
    want, at = [], 0
    nxt = {n: x for _, n, x, _ in nodes}
    while at is not None and at in nxt:
        want.append(at)
        at = nxt[at]
    assert got == want
