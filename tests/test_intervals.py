"""Interval cases, including the distributed paths that small groups do not take."""

import random

import pytest
from seqmine.operators import intervals as iv, patch, rates
from seqmine.plans.blocks import Run, by_position


def spans(seed, n, n_src=3, reach=400, mean=40):
    rng = random.Random(seed)
    return [(i, rng.randint(0, n_src - 1), s := rng.randint(0, reach), s + int(rng.expovariate(1 / mean)))
            for i in range(n)]


def test_split_of_known_case(spark):
    audio = spark.createDataFrame([(1, 7, 10, 50, 8)], "src long, id long, start long, end long, stride long")
    video = spark.createDataFrame([(1, 25)], "src long, start long")
    sounding = [([0], (False, True)), ([4], (True, False)), ([0, 4], (False, False))]
    pieces = iv.split_intervals(audio, video, threshold=10)
    assert sorted((r.start, r.end) for r in pieces.collect()) == [(10, 18), (26, 50)]
    for loud, silent in sounding:
        at = spark.createDataFrame([(1, 7, 10 + 8 * k) for k in loud], "src long, id long, pos long")
        got = iv.mark_silent_pieces(pieces, at).orderBy("start").collect()
        assert tuple(r.silent for r in got) == silent


@pytest.mark.parametrize("threshold,tail,offset", [(32, None, 0), (32, 0, 1), (3, 0, 7)])
def test_split_against_one_by_one(spark, threshold, tail, offset):
    rng = random.Random(11)
    audio = [(rng.choice([None, 1]), i, s := rng.randint(0, 200), s + rng.randint(0, 3000), rng.randint(1, 8)) for i in range(40)]
    audio = [(src, i, s, e - (e - s) % stride, stride) for src, i, s, e, stride in audio]
    video = [(s, rng.randint(0, 3200)) for s in (None, 1) for _ in range(120)]
    a = spark.createDataFrame(audio, "src long, id long, start long, end long, stride long")
    v = spark.createDataFrame(video, "src long, start long")
    want = []
    for src, i, start, end, stride in audio:
        s = start
        for at in sorted({x for k, x in video if k == src}):
            if s < at - threshold and end >= at + (threshold if tail is None else tail):
                back = (at - offset - s - 1) % stride
                want.append((i, s, at - offset - back - 1))
                s = at - offset + stride - back - 1
        want.append((i, s, end))
    for few in (0, 1000):
        out = iv.split_intervals(a, v, threshold=threshold, tail=tail, offset=offset, width=300, few=few)
        assert sorted((r.id, r.start, r.end) for r in out.collect()) == sorted(want) and len(want) > 400
    assert iv.split_intervals(a.limit(0), v).count() == 0 and iv.split_intervals(a, v.limit(0)).count() == 40


def test_disjoint_paths_agree(spark):
    rows = [(r[1], r[0], r[2], r[3], "ab"[r[0] % 2], r[0] % 3) for r in spans(5, 300)]
    df = spark.createDataFrame(rows, "parent long, id long, start long, end long, fmt string, past long")
    fold, pointers = (sorted(tuple(r) for r in iv.longest_disjoint(df, fold_limit=n).select(
        "parent", "fmt", "start", "end", "id").collect()) for n in (4096, 0))
    assert fold == pointers and len(fold) > 10


@pytest.mark.parametrize("block", [3, 100000])
def test_lanes(spark, block):
    rows = spans(6, 160, mean=60)
    df = spark.createDataFrame(rows, "id long, src long, start long, end long")
    got = {r.id: r.lane for r in iv.assign_lanes(df, width=50, block=block).collect()}
    lanes = {}
    for i, src, start, end in sorted(rows, key=lambda r: (r[2], r[0])):
        busy = lanes.setdefault(src, [])
        lane = next((k for k, e in enumerate(busy) if e < start), len(busy))
        busy[lane:lane + 1] = [end]
        assert got[i] == lane


def test_tree_with_cycle_and_orphan(spark):
    rows = [(1, i, i - 1 if i else None, f"d{i}", 10, 2049) for i in range(40)]
    rows += [(1, 100, 101, "x", 1, 0), (1, 101, 100, "y", 1, 0), (1, 200, 999, "lost", 1, 0), (1, 300, 3, "..", 1, 0),
             (1, 301, 3, "zero", 0, 5), (1, 302, 3, "empty", 7, 0)]
    df = spark.createDataFrame(rows, "src long, node long, parent long, name string, start long, size long")
    got = {r.node: r for r in iv.resolve_tree(df).collect()}
    assert set(got) == set(range(40)) | {302}
    assert got[39].path == "/".join(f"d{i}" for i in range(40)) and got[39].depth == 40
    assert (got[5].start, got[5].end, got[302].end) == (10, 11, 7)


def test_tree_by_extents(spark):
    rows = [("d", 0, None, "disc", 16, 2048, True)]
    rows += [("d", k, 17 + 3 * k, f"f{k}", 20 + 3 * k, 2 * 2048, True) for k in range(1, 30)]  # a chain, each in the folder before it
    rows[1] = ("d", 1, 16, "f1", 23, 2 * 2048, True)
    rows += [("d", 50, 24, "second", 900, 1, False), ("d", 51, 25, "between", 900, 1, False), ("d", 52, 23, "..", 23, 4096, True),
             ("d", 53, 23, "huge", 5, 1 << 42, False), ("d", 54, 23, "none", 0, 0, False), ("d", 55, 23, "small", 23, 2047, True),
             ("d", 60, 7000, "a", 7100, 2048, True), ("d", 61, 7100, "b", 7000, 2048, True),  # each in the other
             (None, 0, None, "disc", 16, 2048, True), (None, 9, 16, "x", 40, 2049, False)]
    df = spark.createDataFrame(rows, "src string, node long, record long, name string, start long, size long, folder boolean")
    got = {(r.src, r.node): r for r in iv.resolve_extents(df).collect()}
    assert set(got) == {("d", k) for k in [*range(30), 50, 53, 54]} | {(None, 0), (None, 9)}
    assert got["d", 29].path == "/".join(f"f{k}" for k in range(1, 30)) and got["d", 29].depth == 29
    assert got["d", 50].path == "f1/second" and got["d", 0].path == ""
    assert (got["d", 53].fault, got["d", 53].end, got["d", 54].end) == ("impossible size", None, 0)
    assert (got[None, 9].path, got[None, 9].end) == ("x", 41)


def test_parent_prefers_video_and_first(spark):
    children = spark.createDataFrame([(1, 1, 0, 9, "audio"), (1, 2, 0, 9, "file"), (1, 3, 90, 99, "audio"), (2, 4, 0, 9, "audio")],
                                     "src long, c_id long, c_start long, c_end long, c_kind string")
    parents = spark.createDataFrame([(1, 10, 0, 0, 100, "file"), (1, 11, 1, 5, 50, "video"), (1, 12, 2, 5, 50, "video"),
                                     (1, 13, 3, 0, 100, "file")],
                                    "src long, p_id long, p_order long, p_start long, p_end long, p_kind string")
    got = {r.c_id: (r.parent_id, r.rating) for r in iv.assign_parent(children, parents).collect()}
    assert got == {1: (11, 150), 2: (None, 0), 3: (10, 100), 4: (None, 0)}


def test_interval_against_brute_force(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for src in range(25):
        step, at, frames = rng.randint(2, 9), rng.randint(0, 4), []
        for k in range(rng.randint(1, 14)):
            start = at + k * step + rng.randint(0, 1)
            frames.append((start, start + rng.randint(0, step - 2)))
        rows += [(src, s, e) for s, e in frames]
        if len(frames) < 3:
            continue
        gaps = [(a[1] + 1, b[0]) for a, b in zip(frames, frames[1:])]
        alive = [n for p in range(gaps[0][0], gaps[0][1] + 1) for n in range(2, gaps[1][1] - p + 1)
                 if all(any((x - p) % n == 0 for x in range(lo, hi + 1)) for lo, hi in gaps[1:])]
        want[src] = max(alive, default=1)
    df, _ = by_position(spark.createDataFrame(rows, "src long, start long, end long"), ["src"], "start", 16)
    got = {r.src: r.interval for r in rates.infer_interval(df, Run(("src",), ("start",))).collect()}
    assert got == want


def test_patches_are_refused_before_output(spark):
    docs = spark.createDataFrame([(1, 0, bytearray(b"abcdef"))], "src long, pos long, data binary")
    make = lambda *rows: spark.createDataFrame([(1, 0, i, o, bytearray(b)) for i, (o, b) in enumerate(rows)],
                                               "src long, pos long, entry int, offset long, bytes binary")
    touching = patch.apply_patches(docs, make((0, b"XY"), (2, b"Z"), (5, b"!"))).first()
    assert bytes(touching.data) == b"XYZde!" and touching.patches == 3
    for rows in ([(0, b"XY"), (1, b"Z")], [(5, b"!!")], [(-1, b"x")]):
        with pytest.raises(patch.PatchRefused):
            patch.apply_patches(docs, make(*rows))


@pytest.mark.parametrize("in_order", [True, False])
@pytest.mark.parametrize("channel", [None, "channel"])
@pytest.mark.parametrize("reach,few", [(40, 0), (900, 0), (300, 1000), (500, 20)])
def test_parents_against_all_pairs(spark, in_order, channel, reach, few):
    rng = random.Random(reach)
    sources, channels = (None, 1, 2), (None, 0, 1)
    kinds = ["file", "video", "video", "other"]
    parents = [(rng.choice(sources), i, s := rng.randint(0, 1200), s + rng.randint(0, rng.choice([10, 60, 400])), rng.choice(kinds), rng.choice(channels))
               for i in range(220)]
    rank = {p[1]: k for k, p in enumerate(sorted(parents, key=lambda p: (p[2], p[1])))}
    parents = [(src, i, rank[i] if in_order else rng.randint(0, 40) * 1000 + i, s, e, k, ch) for src, i, s, e, k, ch in parents]
    children = [(rng.choice(sources), i, s := rng.randint(0, 1300), s + rng.randint(0, reach), rng.choice(["audio", "audio", "file", "image"]),
                 rng.choice(channels)) for i in range(260)]
    want = {}
    for src, c, s, e, kind, ch in children:
        best = (0, 0, None)
        for psrc, p, order, ps, pe, pkind, pch in parents:
            if psrc != src or (pkind == "file" and kind == "file") or (pkind == "video" and kind != "audio"):
                continue
            if channel and pkind == "video" and pch is not None and pch != ch:
                continue
            pct = max(0, min(e, pe) - max(s, ps) + 1) * 100 // (e - s + 1)
            if pct > 0:
                best = max(best, (pct + 100 * (pkind == "video"), -order, p))
        want[c] = (best[2], best[0])
    a = spark.createDataFrame(children, "src long, c_id long, c_start long, c_end long, c_kind string, channel int")
    b = spark.createDataFrame(parents, "src long, p_id long, p_order long, p_start long, p_end long, p_kind string, channel int")
    got = {r.c_id: (r.parent_id, r.rating) for r in iv.assign_parent(a, b, channel=channel, width=40, rows=60, few=few).collect()}
    assert got == want


def test_staggered_parents_of_one_source(spark):
    """Every child meets thousands of parents; the longest of those inside it are far apart."""
    n = 20_000
    parents = spark.range(n).selectExpr("1L as src", "id as p_id", "id as p_order", "id * 10 as p_start", "id * 10 + 5000 + id % 7 as p_end", "'file' as p_kind")
    children = spark.range(n).selectExpr("1L as src", "id as c_id", "id * 10 + 3 as c_start", "id * 10 + 9003 as c_end", "'audio' as c_kind")
    got = {r.c_id: (r.parent_id, r.rating) for r in iv.assign_parent(children, parents, rows=4000).where("c_id % 997 = 0").collect()}
    for c, (p, rating) in got.items():
        s, e = c * 10 + 3, c * 10 + 9003
        shares = [(max(0, min(e, k * 10 + 5000 + k % 7) - max(s, k * 10) + 1) * 100 // (e - s + 1), -k) for k in range(max(0, c - 800), min(n, c + 1000))]
        best = max(shares)
        assert (p, rating) == (-best[1], best[0])
    assert len(got) == 21
