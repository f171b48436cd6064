"""Blocks bounded in rows, and the item operators on them."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F
from seqmine.operators import intervals as iv, items as it, patch
from seqmine.plans.blocks import by_rows


def test_many_items_on_few_starts(spark):
    n, rows = 1_000_000, 100_000
    items = spark.range(n).selectExpr("1L as src", "id", "id % 100 as start", "id % 100 + (id * 7919) % 50 as end",
                                      "element_at(array('audio', 'file', 'video', 'image'), int(id % 4) + 1) as kind")
    cells, _ = by_rows(items.withColumn("_longer", -F.col("end")), ["src"], ["start", "kind", "_longer", "id"], rows)
    sizes = [r["count"] for r in cells.groupBy("blk").count().collect()]
    assert sum(sizes) == n and len(sizes) >= 8 and max(sizes) <= 2 * rows
    level = it.kind_level(F.col("kind"))
    want = items.withColumn("want", F.row_number().over(
        Window.partitionBy("src").orderBy("start", level, "kind", F.desc("end"), "id")) - 1).select("id", "want")
    wrong = it.order_items(items, rows=rows).join(want, "id").where("number <> want")
    assert wrong.isEmpty()


def test_null_sources_and_keys(spark):
    rng = random.Random(1)
    rows = [(src, k, rng.randint(0, 20), rng.choice(["audio", "video"])) for src in (None, 1, 2) for k in range(60)]
    df = spark.createDataFrame(rows, "src long, id long, start long, kind string").withColumn("end", F.col("start") + F.col("id") % 5)
    numbers = {(r.src, r.number) for r in it.order_items(df, rows=20).collect()}
    assert numbers == {(s, k) for s in (None, 1, 2) for k in range(60)}
    more = df.withColumn("fmt", F.lit(1)).withColumn("speed", F.lit(1)).withColumn("first", F.col("start"))
    spaced = more.withColumn("start", F.col("id") * 10).withColumn("end", F.col("id") * 10 + 9)
    assert {(r.src, r.streams, r.accepted) for r in it.union_disjoint(spaced, keys=["src"], rows=20).collect()} == {(s, 60, True) for s in (None, 1, 2)}
    assert not any(r.accepted for r in it.union_disjoint(more, keys=["src"], rows=20).collect())


def test_null_keys_zip(spark):
    a = spark.createDataFrame([(None, k, k * 2, 1) for k in range(50)] + [(1, 0, 0, 1), (2, 0, 0, 1), (3, 0, 0, 1)], "src long, id long, start long, rate int")
    b = spark.createDataFrame([(None, k, k, 1) for k in range(50)] + [(1, 9, 0, 2), (2, 1, 1, 1), (2, 2, 2, 1)], "src long, id long, start long, rate int")
    zipped, refused = patch.zip_positional(a, b, ["src"], ["start", "id"], same=["rate"], rows=7)
    assert sorted((r.n, r.a_id, r.b_id) for r in zipped.collect()) == [(k, k, k) for k in range(50)]
    assert {(r.src, r.reason) for r in refused.collect()} == {(1, "format"), (2, "count"), (3, "missing side")}


def test_patches_of_null_keys(spark):
    docs = spark.createDataFrame([(None, "abcdef"), (1, "abcdef")], "doc long, data string")
    patches = spark.createDataFrame([(None, 1, 0, "XY"), (1, 1, 3, "Z")], "doc long, entry int, offset long, bytes string")
    got = {r.doc: (r.data, r.patches) for r in patch.apply_patches(docs, patches, key=["doc"]).collect()}
    assert got == {None: ("XYcdef", 1), 1: ("abcZef", 1)}
    far = spark.createDataFrame([(None, 1, 5, "XY"), (7, 2, 0, "a")], "doc long, entry int, offset long, bytes string")
    assert {(r.doc, r.fault) for r in patch.check_patches(docs, far, key=["doc"], rows=1).collect()} == {(None, "past end"), (7, "no record")}


def test_longest_disjoint_of_null_parents(spark):
    rows = [(p, k, f, s, s + 5, 0) for p in (None, 1) for k, (f, s) in enumerate([("a", 0), ("a", 3), ("b", 10), ("a", 20)])]
    df = spark.createDataFrame(rows, "parent long, id long, fmt string, start long, end long, past long")
    for limit in (4096, 0):
        got = iv.longest_disjoint(df, fold_limit=limit).collect()
        assert sorted((str(r.parent), r.id) for r in got) == [("1", 0), ("1", 3), ("None", 0), ("None", 3)]


def test_violations_of_null_sources(spark):
    children = spark.createDataFrame([(None, 1, 0, 9, 7), (1, 2, 0, 99, 7)], "src long, c_id long, c_start long, c_end long, parent_id long")
    parents = spark.createDataFrame([(None, 7, 0, 5), (1, 7, 0, 200)], "src long, p_id long, p_start long, p_end long")
    sources = spark.createDataFrame([(None, 5), (1, 50)], "src long, records long")
    got = {(r.fault, r.c_id) for r in iv.boundary_violations(children, parents, sources).collect()}
    assert got == {("outside parent", 1), ("past end", 1), ("past end", 2)}


def test_timeline_range(spark):
    frames = spark.createDataFrame([(1, 5), (1, 9), (None, 3)], "src long, pos long")
    packets = spark.createDataFrame([(1, 2), (1, 30), (2, 4)], "src long, pos long")
    got = {r.src: tuple(r)[1:] for r in it.timeline_range(it.merge_streams(frames, packets)).collect()}
    assert got == {1: (2, 30, 2, 2, 5, 9), None: (3, 3, 1, 0, 3, 3), 2: (4, 4, 0, 1, None, None)}
