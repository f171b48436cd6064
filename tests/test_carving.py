"""Structures in islands against the pattern on the joined text."""

import random

import pytest
import regex
from seqmine.operators.carving import Pattern, carve
from seqmine.plans.blocks import by_position, stream_offsets
from pyspark.sql import functions as F


def frame(spark, rows, width=1):
    return by_position(spark.createDataFrame(rows, "src string, pos long, t string"), ["src"], width=width)


def found(spark, rows, pattern, width=1, **how):
    df, run = frame(spark, rows, width)
    return sorted(((r.src or "", r.start, r.offset, r.end, r.found) for r in carve(df, run, text="t", pattern=pattern, **how).collect()))


def wanted(rows, pattern, step):
    """Every aligned offset of every island's joined text, one by one."""
    isles, last = [], None
    for src, pos, t in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        if last != (src, pos - 1):
            isles.append((src, []))
        isles[-1][1].append((pos, t or ""))
        last = (src, pos)
    out = []
    for src, records in isles:
        whole = "".join(t for _, t in records)
        holder = [(pos, k) for pos, t in records for k in range(len(t))]
        for o in range(0, len(whole), step):
            m = regex.compile(pattern, regex.DOTALL).match(whole, o)
            if m and m.end() > o:
                out.append((src or "", *holder[o], holder[m.end() - 1][0], m.group()))
    return sorted(out)


def test_over_record_ends(spark):
    rows = [("a", 0, "....TI"), ("a", 1, "M!..TITIM!"), ("a", 2, "xxTI")]
    assert [(r[1], r[2], r[3]) for r in found(spark, rows, "TIM!", reach=4, step=2)] == [(0, 4, 1), (1, 6, 1)]
    assert [r[2] for r in found(spark, [("a", 0, "aaaaa")], "aa", step=1)] == [0, 1, 2, 3]


def test_short_records_gaps_and_long_structures(spark):
    assert found(spark, [("a", 0, "xxxxt"), ("a", 1, "h"), ("a", 2, "a"), ("a", 3, "bzzz")], "th[a-e][a-z]", step=1) == [("a", 0, 4, 3, "thab")]
    assert found(spark, [("a", 0, "xxxxt"), ("a", 500, "habzzz")], "th[a-e][a-z]", step=1) == []
    rows = [("a", 0, "startAAAA"), ("a", 1, ""), ("a", 2, None), ("a", 3, "AAAAend")]
    assert found(spark, rows, "start(A+)(end)?", reach=2, window=4) == [("a", 0, 0, 3, "startAAAAAAAAend")]
    assert found(spark, rows, "start(A+)endx") == []


@pytest.mark.parametrize("pattern", ["th[a-e][a-z]*", "s(A+)(e(nd)?)?", "a.*?z", "(ab|a)(c|bcd)*", "[^z]{3}z"])
@pytest.mark.parametrize("window,reach,step,width", [(4, 1, 1, 2), (16, 5, 4, 1000), (1 << 14, 1 << 10, 2, 7)])
def test_random_islands(spark, pattern, window, reach, step, width):
    rng = random.Random(window)
    letters = "thaeAsendzbc"
    rows = []
    for src in (None, "a", "b"):
        pos = 0
        for _ in range(60):
            pos += rng.choice([1, 1, 1, 1, 1, 1, 3])
            rows.append((src, pos, rng.choice(["", None, "s", "A" * rng.randint(1, 30), "".join(rng.choices(letters, k=rng.randint(1, 12)))])))
    assert found(spark, rows, pattern, width, window=window, reach=reach, step=step) == wanted(rows, pattern, step)


def test_text_that_is_too_short():
    ask = Pattern("s(A+)(end)?")
    assert ask.needs_more("sAAAe") and ask.needs_more("s") and ask.needs_more("sAA")
    assert not ask.needs_more("sAAAx") and not ask.needs_more("x") and not ask.needs_more("sAAex")
    assert ask.undecided("sAx sAAe", 8) == [4] and ask.undecided("sAx sAAx", 8) == []


def test_stream_offsets(spark):
    rng = random.Random(2)
    rows, pos = [], 0
    for _ in range(200):
        pos += rng.choice([1, 1, 1, 5])
        rows.append(("a" if pos % 2 else None, pos // 2, "x" * rng.randint(0, 3)))
    df, run = frame(spark, rows, width=9)
    got = {(r.src, r.pos): (r.seg, r["at"]) for r in stream_offsets(df, run, F.length("t")).collect()}
    want, last = {}, None
    for src, p, t in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        if last != (src, p - 1):
            seg, at = p, 0
        want[src, p] = (seg, at)
        at, last = at + len(t), (src, p)
    assert got == want


def test_nothing(spark):
    assert found(spark, [], "a") == [] and found(spark, [("a", 1, None), ("a", 2, "")], "a") == []
