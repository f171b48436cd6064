"""Segmentation cases that the driver tables do not hold."""

import random

from pyspark.sql import functions as F

from seqmine.operators import segment as seg
from seqmine.plans.blocks import Run, by_density, by_position, dense_index


def test_sticky_special_first_frame(spark):
    rng = random.Random(3)
    rows = []
    for src in range(30):
        pos = number = 0
        for _ in range(rng.randint(1, 40)):
            pos += rng.choice([1, 1, 1, 4])
            number += rng.choice([0, 1, 1, 2, -5])
            rows.append((src, pos, pos, number, rng.random() < 0.6))
            pos += 1
    df, run = by_position(spark.createDataFrame(rows, "src long, start long, end long, frame long, special boolean"),
                          ["src"], "start", width=8)
    got = sorted((r.src, r.start, r.end, r.frames) for r in seg.stitch_groups(df, run, gap=2, jump=3).collect())
    want, open_ = [], None
    for src, start, end, number, special in sorted(rows):
        if open_ and open_["src"] == src and not (
                start > open_["end"] + 2 or number < open_["n"] or number > open_["n"] + 3
                or (open_["sticky"] and not special)):
            open_.update(end=end, n=number, frames=open_["frames"] + 1)
        else:
            open_ = dict(src=src, start=start, end=end, n=number, sticky=special, frames=1)
            want.append(open_)
    assert got == sorted((w["src"], w["start"], w["end"], w["frames"]) for w in want)


def test_chunk_beyond_expected_is_corrupt(spark):
    rows = [(1, 1, 5, 0, 3), (1, 2, 5, 1, 3), (1, 3, 5, 9, 3), (1, 4, 5, 2, 3)]
    df, run = by_position(spark.createDataFrame(rows, "src long, pos long, frame long, chunk long, expected long"), ["src"])
    got = sorted((r.start, r.end, r.chunks, r.corrupt) for r in seg.assemble_groups(df, run).collect())
    assert got == [(1, 2, 2, False), (3, 3, 1, True), (4, 4, 1, False)]


def test_same_result_under_repartitioning(spark):
    rng = random.Random(4)
    rows = [(s, p, rng.randint(0, 3)) for s in range(5) for p in sorted(rng.sample(range(500), 120))]
    base = spark.createDataFrame(rows, "src long, pos long, v long")
    results = set()
    for df in (base, base.repartition(7), base.orderBy(F.col("pos").desc()).coalesce(1)):
        for width in (10, 1000):
            cells, run = by_position(df, ["src"], width=width)
            out = seg.segment_by_gap(cells, run, gap=4, same=["v"]).select("src", "pos", "seg").collect()
            results.add(tuple(sorted(tuple(r) for r in out)))
    assert len(results) == 1


def test_density_blocks_split_a_hot_day(spark):
    rows = [(1, 5, k) for k in range(400)] + [(1, d, d) for d in range(20)] + [(2, 7, 1)]
    df = spark.createDataFrame(rows, "src long, day long, k long")
    cells, block = by_density(df, ["src"], "day", "k", rows=50)
    assert cells.groupBy("src", *block).count().agg(F.max("count")).first()[0] < 120
    got = dense_index(cells, Run(("src",), ("day", "k"), block), "i").where("src = 1").orderBy("i").collect()
    assert [r.i for r in got] == list(range(420))
    assert [(r.day, r.k) for r in got] == sorted((d, k) for s, d, k in rows if s == 1)


def test_payload_parts_and_trims(spark):
    rows = [(1, 1, "abcd"), (1, 2, "efg"), (1, 5, "hij"), (2, 1, "xyz"), (3, 1, "ab")]
    df, run = by_position(spark.createDataFrame(rows, "src long, pos long, t string"), ["src"], width=2)
    out = seg.concat_payload(df, run, payload="t", first_trim=1, last_trim=2)
    assert {(r.src, r.t, r.size, r.legal) for r in out.collect()} == {
        (1, "bcdefgh", 7, True), (2, "", 0, True), (3, "", 0, False)}
    parts = seg.concat_payload(df, run, payload="t", part_size=4).where("src = 1").orderBy("part").collect()
    assert "".join(r.t for r in parts) == "abcdefghij" and len(parts) > 1


def test_locate_skips_empty_pieces(spark):
    pieces = spark.createDataFrame([(1, 1, 3), (1, 2, 0), (1, 4, 2)], "src long, pos long, len long")
    asked = spark.createDataFrame([(1, i) for i in range(7)], "src long, at long")
    got = {(r["at"], r.pos, r.inner) for r in seg.locate_offset(pieces, asked, ["src"], width=2).collect()}
    assert got == {(0, 1, 0), (1, 1, 1), (2, 1, 2), (3, 4, 0), (4, 4, 1)}


def test_lookahead_takes_first_complete_group(spark):
    kinds = "F m . L L F m F L F " + ". " * 16 + "L"
    rows = [(1, i, k == "F", k == "m", k == "L") for i, k in enumerate(kinds.split())]
    df, run = by_position(spark.createDataFrame(rows, "src long, pos long, f boolean, m boolean, l boolean"), ["src"], width=4)
    got = sorted((r.pos, r.group_start) for r in
                 seg.claim_lookahead(df, run, first="f", member="m", last="l").collect())
    assert got == [(0, 0), (1, 0), (3, 0), (7, 7), (8, 7)]


def test_lookahead_rejects_groups_with_holes(spark):
    kinds = "F0 m1 L2 F0 m2 L3 F0 . m1 m2 L3 F0 L1 F5 m6 L7 F0 m1 m L3"
    rows = [(None, i, k[0] == "F", k[0] == "m", k[0] == "L", int(k[1]) if k[1:] else None) for i, k in enumerate(kinds.split())]
    df, run = by_position(spark.createDataFrame(rows, "src string, pos long, f boolean, m boolean, l boolean, n long"), ["src"], width=3)
    got = seg.claim_lookahead(df, run, first="f", member="m", last="l", number="n", least=3).collect()
    assert sorted((r.pos, r.group_start) for r in got) == [(0, 0), (1, 0), (2, 0), (6, 6), (8, 6), (9, 6), (10, 6), (13, 13), (14, 13), (15, 13)]
