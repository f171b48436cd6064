"""Source mixing, Merkle manifest and hard negatives against plain simulations."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import database, difference
from seqmine.llm import hard_negatives, merkle, mixing, queries, ranks

LONG = "word " * 30000


# Mixing -----------------------------------------------------------------------------------------------------------------------------

def filled(sizes: dict, weights: dict, budget: float, epochs: float) -> dict:
    """Water-filling by bisection on the level, an independent way to the same targets."""
    caps = {s: epochs * n for s, n in sizes.items()}
    if sum(c for s, c in caps.items() if weights.get(s, 0) > 0) <= budget:
        return {s: caps[s] if weights.get(s, 0) > 0 else 0.0 for s in sizes}
    low, high = 0.0, 1e12
    for _ in range(300):
        level = (low + high) / 2
        if sum(min(caps[s], weights.get(s, 0) * level) for s in sizes) < budget:
            low = level
        else:
            high = level
    return {s: min(caps[s], weights.get(s, 0) * high) for s in sizes}


def mixed(spark, rows, weights, **how):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size string, mix_s string, taken int")
    given = spark.createDataFrame(list(weights.items()), "source string, weight double")
    return mixing.mix(docs, given, **how)


def mix_rows(seed=1, sources=("a", "b", "c", None), n=300):
    rng = random.Random(seed)
    return [(k, rng.choice(sources), " ".join(["w"] * rng.choice([0, 1, 3, 20, 90])), "x", "y", 7) for k in range(n)]


@pytest.mark.parametrize("share,epochs", [(1.5, 2.0), (0.4, 1.0), (3.0, 2.5)])
def test_mix_against_bisection(spark, share, epochs):
    rows, weights = mix_rows(), {"a": 5.0, "b": 2.0, "c": 1.0, None: 0.5}
    found = mixed(spark, rows, weights, share=share, epochs=epochs).collect()
    sizes, taken = Counter(), Counter()
    for r in found:
        assert r.size == len(r.text.split()) and r.taken == r.size * r.copies and r.copies <= math.ceil(epochs)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = filled(sizes, weights, share * sum(sizes.values()), epochs)
    assert len(found) == len(rows)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 90 / 2  # half the shortest document that was passed over


@pytest.mark.parametrize("walked,bits", [(512, 12), (8, 2)])
def test_mix_does_not_depend_on_order_and_narrows_in_passes(spark, monkeypatch, walked, bits):
    monkeypatch.setattr(mixing, "WALKED", walked)
    monkeypatch.setattr(mixing, "PASS_BITS", bits)
    rows, weights = mix_rows(2), {"a": 5.0, "b": 2.0, "c": 1.0, None: 1.0}
    one = mixed(spark, rows, weights).collect()
    random.Random(5).shuffle(rows)
    two = mixed(spark, rows, weights).repartition(3).collect()
    assert sorted((r.doc_id, r.taken) for r in one) == sorted((r.doc_id, r.taken) for r in two)
    size, target, taken = defaultdict(int), {}, Counter()
    for r in one:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 90 for s in target)


def test_mix_of_equal_rows_nulls_and_long_texts(spark):
    # One null key with one text fills most of a source: its rows are counted, and some of them are repeated.
    rows = [(None, "a", "one two three", "x", "y", 1)] * 90 + [(1, "a", None, "x", "y", 1), (2, "a", "", "x", "y", 1), (3, "a", LONG[:500], "x", "y", 1)]
    rows += [(4, "b", LONG, "x", "y", 1), (5, "b", LONG, "x", "y", 1), (6, None, " \t\n", "x", "y", 1), (7, "unweighted", "a b", "x", "y", 1)]
    found = mixed(spark, rows, {"a": 1.0, "b": 1.0, None: 1.0}, share=0.005).collect()
    got = defaultdict(list)
    for r in found:
        got[r.source].append(r)
    assert len(found) == len(rows) and {r.size for r in got["b"]} == {30000}
    a = sum(r.taken for r in got["a"])
    assert abs(a - got["a"][0].target) <= 3 and len({r.copies for r in got["a"] if r.doc_id is None}) == 2
    assert got[None][0].size == 0 and got[None][0].taken == 0
    assert got["unweighted"][0].taken == 0 and got["unweighted"][0].target == 0


def test_mix_of_nothing(spark):
    assert mixed(spark, [], {"a": 1.0}).count() == 0
    none = mixed(spark, [(1, "a", None, "x", "y", 1)], {"a": 1.0}).collect()
    assert [(r.size, r.target, r.taken) for r in none] == [(0, 0.0, 0)]
    assert mixed(spark, mix_rows(), {"a": 0.0}).agg(F.sum("taken")).first()[0] == 0


def test_dealt_weights_follow_code_points(spark):
    df = spark.createDataFrame([("b",), ("é",), (None,), ("B",), ("b",), ("🙂",), ("z",)], "source string")
    found = {r.source: float(r.weight) for r in mixing.dealt(df, "source", (5, 2, 1)).collect()}
    assert found == {"B": 5.0, "b": 2.0, "z": 1.0, "é": 5.0, "🙂": 2.0, None: 1.0}


def test_ranks_of_equal_rows(spark):
    df = spark.createDataFrame([(k % 3,) for k in range(1000)], "v int").repartition(5)
    found = ranks.ranked(df, [F.asc("v")]).collect()
    assert sorted(r.rank for r in found) == list(range(1000))
    assert [v for _, v in sorted((r.rank, r.v) for r in found)] == sorted(k % 3 for k in range(1000))


# Merkle manifest --------------------------------------------------------------------------------------------------------------------

def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def folded_levels(nodes: list[str], fanout: int) -> tuple[str, list[list[str]]]:
    """Root and, per leaf, its siblings from the leaf upwards."""
    paths, holders, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        up, held = [], []
        for at in range(0, len(level), fanout):
            run = level[at:at + fanout]
            for k in range(len(run)):
                for i in holders[at + k]:
                    paths[i] += run[:k] + run[k + 1:]
            up.append(sha("".join(run)))
            held.append(sum(holders[at:at + fanout], []))
        level, holders = up, held
    return level[0], paths


def plain_manifest(rows, fanout):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    ordered, subroots, inner = {}, [], {}
    for g in names:
        ordered[g] = sorted(((r[0] is not None, r[0] or 0, leaf_of(r)) for r in groups[g]))
        top, paths = folded_levels([x[2] for x in ordered[g]], fanout)
        subroots.append(top)
        inner[g] = paths
    root, upper = folded_levels(subroots, fanout)
    return sorted((str(x[1] if x[0] else None), x[2], subroots[i], root, sha("".join(inner[g][k] + upper[i])))
                  for i, g in enumerate(names) for k, x in enumerate(ordered[g]))


def merkle_rows(counts: dict, seed=0):
    rng, rows = random.Random(seed), []
    for source, n in counts.items():
        rows += [(rng.choice([k, k * 1000]), source, rng.choice(["en", None]), rng.choice([3, None]), rng.choice(["a\nb", "", None, "日本 🙂", "x" * 50]))
                 for k in range(n)]
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def built(spark, rows, fanout=3):
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA), fanout=fanout)
    return found.select("doc_id", *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")],
                        merkle.proof_digest(F.col("path")).alias("proof"), merkle.folded(F.col("leaf"), F.col("path")).alias("folded")).collect()


@pytest.mark.parametrize("counts,fanout", [({"a": 1}, 3), ({"a": 4}, 3), ({"a": 100, "b": 1, None: 28}, 3),
                                           ({f"s{k}": k for k in range(1, 15)}, 3), ({"a": 33, "é": 2, "🙂": 9}, 2)])
def test_manifest_against_plain_trees(spark, counts, fanout):
    rows = merkle_rows(counts)
    found = built(spark, rows, fanout)
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof) for r in found) == plain_manifest(rows, fanout)
    assert all(r.folded == r.root for r in found)


def test_manifest_of_equal_rows_null_keys_long_texts_and_nothing(spark):
    rows = [(None, "a", None, None, None)] * 7 + [(5, "a", "en", 1, LONG)] * 5 + [(6, "a", "en", 1, ""), (6, "a", "en", 1, "other")]
    found = built(spark, rows)
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof) for r in found) == plain_manifest(rows, 3)
    assert built(spark, []) == []


def test_manifest_keeps_asked_columns_and_finds_changes(spark):
    rows = merkle_rows({"a": 20, "b": 5})
    df = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit("other")).withColumn("path", F.lit(1)).withColumn("tree", F.lit(2))
    found = merkle.manifest(df, columns=["doc_id", "source", "text"], more=[F.lit(4).alias("given"), F.col("tree").alias("hash")])
    assert found.columns == ["doc_id", "source", "given", "hash", "leaf", "subroot", "root", "path"]
    other = F.unhex(F.sha2(F.lit("changed").cast("binary"), 256))
    bad = found.select((merkle.folded(other, F.col("path")) == F.lower(F.hex("root"))).alias("ok"), "given", "hash").collect()
    assert len(bad) == 25 and not any(r.ok for r in bad) and {(r.given, r.hash) for r in bad} == {(4, 2)}


# Hard negatives ---------------------------------------------------------------------------------------------------------------------

def plain_negatives(rows, every, positives, negatives):
    usable = [(i, k, [c for c in v], l) for i, (k, v, l) in enumerate(rows)
              if k is not None and l is not None and v is not None and None not in v]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, k, v, l in usable:
        if k % every:
            continue
        near = sorted((-score(v, w), j, m) for m, j, w, o in usable if m != i and o == l)[:positives]
        for s, j, _ in near:
            fit = sorted((-score(v, w), n) for _, n, w, o in usable if o != l and 30 * -s <= 100 * score(v, w) <= 90 * -s)[:negatives]
            out += [(k, j, r, n, -s, -t) for r, (t, n) in enumerate(fit, 1)]
    return sorted(out)


def vectors(seed, n, dim, spread, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (labels, dim))
    rows = []
    for k in range(n):
        label = int(rng.integers(labels))
        v = (centres[rng.integers(labels)] + rng.normal(0, spread, dim)).astype(int).tolist()
        rows.append((k, v, label))
    return rows


def mined(spark, rows, every, **how):
    df = spark.createDataFrame([(k, v, l, "x", 1) for k, v, l in rows], "vec_id long, v array<long>, label int, rank string, rid int")
    found = hard_negatives.mine(df, F.col("vec_id") % every == 0, **how).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found)


@pytest.mark.parametrize("seed,dim,spread,block", [(1, 64, 40.0, 1 << 16), (2, 9, 2.0, 50), (3, 3, 1.5, 37), (4, 20, 1e8, 1 << 16)])
def test_negatives_against_all_pairs(spark, seed, dim, spread, block):
    rows = vectors(seed, 260, dim, spread)
    if seed == 4:
        rows = [(k, [c // 10 ** 4 if k % 3 else c for c in v], l) for k, v, l in rows]
    want = plain_negatives(rows, 13, 5, 10)
    assert want and mined(spark, rows, 13, block=block) == want


def test_negatives_with_ties_nulls_and_repeats(spark):
    rng = random.Random(3)
    rows = [(k, [rng.randint(-1, 2) for _ in range(6)], k % 3) for k in range(120)]
    rows += [(200, None, 1), (201, [1, None, 2, 0, 0, 0], 1), (None, [1] * 6, 1), (203, [2] * 6, None), (204, [2, 2], 1), (205, [], 0), (210, [0] * 6, 2)]
    rows += [(30, [2] * 6, 0)] * 3 + [(31, [1] * 6, 1)] * 15
    want = plain_negatives(rows, 30, 5, 10)
    assert want and mined(spark, rows, 30, block=40) == want
    assert mined(spark, rows, 30) == want


def test_negatives_of_nothing(spark):
    assert mined(spark, [], 1) == []
    assert mined(spark, [(0, [1, 2], 1), (1, [1, 2], 1), (2, [-5, -5], 2)], 1) == []
    assert mined(spark, vectors(1, 20, 4, 3.0)[1:], 1000000) == []  # no anchor


@pytest.mark.parametrize("seed", range(6))
def test_index_bounds_lose_no_pair(seed):
    rng = np.random.default_rng(seed)
    scale = np.exp(-np.arange(40) / rng.integers(2, 30)) * 200
    x, y = ((rng.normal(0, 1, (n, 40)) * scale * rng.uniform(0.05, 1, (n, 1))).astype(np.int64) for n in (30, 500))
    scores = x @ y.T
    floors = np.quantile(scores, rng.uniform(0, 1, 30)).astype(np.int64)
    a, b, s = hard_negatives.candidates(x, y, floors, lambda ys: np.ones((30, len(ys)), bool))
    want = {(i, j) for i, j in zip(*np.nonzero(scores >= floors[:, None]))}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want) and (scores[a, b] == s).all()


def test_negatives_broadcast_nothing_that_grows_with_the_anchors(spark, monkeypatch):
    # Files of like vectors are small, and Spark does not see that anchors are repeated for each block of rows.
    rows = [(k, [1 + k % 3] * 32, k % 4) for k in range(400)]
    plans, real = [], hard_negatives.written

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(hard_negatives, "written", noted)
    df = spark.createDataFrame(rows, "vec_id long, v array<long>, label int")
    found = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, block=50)
    got = sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == plain_negatives(rows, 10, 5, 10)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("scale", [1, 10 ** 4, 10 ** 8])  # floats, doubles and Python's integers
@pytest.mark.parametrize("same", [True, False])
def test_block_search_against_all_pairs(monkeypatch, scale, same):
    monkeypatch.setattr(hard_negatives, "TILE", 40)
    monkeypatch.setattr(hard_negatives, "FIRST_TILE", 7)
    monkeypatch.setattr(hard_negatives, "CHUNK", 6)
    rng = random.Random(scale + same)
    y = [(i, rng.randint(0, 60), rng.choice("ab"), [scale * rng.randint(-3, 4) for _ in range(rng.choice([24, 30]))]) for i in range(300)]
    score = lambda v, w: sum(a * b for a, b in zip(v, w))
    asked, want = [], []
    for rid, _, label, v in y[::14]:
        bands = [(p, lo * scale ** 2, (lo + rng.randint(0, 60)) * scale ** 2) for p, lo in enumerate(rng.sample(range(-40, 40), rng.randint(1, 4)))]
        asked.append((rid, label, v, [{"p": p, "lo": lo, "hi": hi} for p, lo, hi in bands]))
        for p, lo, hi in bands:
            fit = sorted((-score(v, w), key) for i, key, other, w in y if (other == label) == same and i != rid and lo <= score(v, w) <= hi)
            want += [(rid, p, key, -s) for s, key in fit[:5]]
    kind = pa.list_(pa.int32() if scale > 1 else pa.int16())
    band = pa.list_(pa.struct([("p", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())]))
    rid, key, label, v = zip(*y)
    rows = pa.table({"rid": rid, "key": key, "label": label, "v": pa.array(v, kind)})
    rid, label, v, bands = zip(*asked)
    queries = pa.table({"rid": rid, "label": label, "v": pa.array(v, kind), "bands": pa.array(bands, band)})
    found = hard_negatives._block_search((), rows, queries, 5, same)
    assert want and sorted(zip(*found.to_pydict().values())) == sorted(want)


def test_queries_equal_their_sql(spark):
    d = "/root/testdata/sf0.001"
    con = database(d)
    for name in ("op11_mixing", "op12_merkle", "op13_hard_negatives"):
        assert difference(queries.queries()[name](spark, d), con, queries.oracles()[name]) is None
