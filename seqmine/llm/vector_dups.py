"""Near-duplicate vectors by sorted projection passes.

Equal vectors of a label are merged first and weigh as many as they are.  Then a number of passes each give every vector a
key of random hash bits (the sides of random planes), order all vectors of a label lexicographically by it, and compare
each with a bounded number of its next neighbours.  Similar vectors agree in most bits, so in some pass they stand close
together.  Pairs that reach the threshold are united across passes into components.

A window bounds what a pass compares, not what counts as a link: inside each component all vectors are compared in
square blocks, so links between members that no window held are counted as well.  Planes go through the mean of a label's
unit vectors, and the number of passes follows from the largest label as if every bit halved it.  How far that held is measured: the
bits that a vector shares with the end of its window tell the chance that a pass missed a link of it.  Vectors for which
all passes together leave a chance of ``MISS`` or more, as in dense clouds, are compared with each other in square blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqmine.llm.components import components
from seqmine.llm.storage import written

THRESHOLD = 0.93
#: Next neighbours compared in a pass.
WINDOW = 64
#: Vectors of a task's block in a pass, and of a square block in a component.
BLOCK = 512
SQUARE = 1024
MISS = 1e-4
BITS = 62


def passes_for(largest: int, threshold: float, window: int, miss: float = MISS) -> int:
    """Passes so that a pair at the threshold is missed with a chance below ``miss``.

    Among n vectors, about log2(n / window) leading bits decide whether two stand within a window; each bit agrees with chance 1 - angle / pi.
    """
    bits = max(0.0, math.log2(max(1, largest) / window)) + 1
    met = (1 - math.acos(threshold) / math.pi) ** bits
    return max(2, math.ceil(math.log(miss) / math.log(1 - met)))


def _planes(dim: int, passes: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, passes * BITS))


def _missed(bits: np.ndarray, agree: np.ndarray) -> np.ndarray:
    """Log of the chance that a pass misses a link of a vector whose window ends after ``bits`` common bits (-1: holds all)."""
    met = np.where(bits >= BITS, 0.0, agree ** (bits + 1))
    return np.log(np.maximum(1 - met, 1e-300))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision from a list column; they are scaled first, so that no square over- or underflows."""
    flat = column.flatten() if hasattr(column, "flatten") else column
    x = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class _Forest:
    """Union-find over the vectors of one block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def unite(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _window_links(table: pa.Table, threshold: float, window: int, block: int) -> pa.Table:
    """Stars (``a``, ``b``) that unite the linked pairs among a block's rows, which come in their pass's order.

    Further rows (``rep``, ``space``, ``run``, ``missed``) tell each row's chance of a missed link after it, and before it.
    """
    table = table.sort_by("rank")
    rep, gid = table.column("rep").to_numpy(), table.column("run").to_numpy()
    dims = table.column("dim").to_numpy()
    forest = _Forest(len(rep))
    cuts = [0, *(np.flatnonzero(gid[1:] != gid[:-1]) + 1).tolist(), len(rep)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi - lo < 2:
            continue
        x = _matrix(table.column("x").slice(lo, hi - lo).combine_chunks(), int(dims[lo]))
        for at in range(0, hi - lo, window):
            left, right = x[at:at + window], x[at:at + 2 * window]
            i, j = np.nonzero(left @ right.T >= threshold)
            near = (j > i) & (j - i <= window)
            for p, q in zip((i[near] + lo + at).tolist(), (j[near] + lo + at).tolist()):
                forest.unite(p, q)
    roots = np.array([forest.root(k) for k in range(len(rep))], dtype=np.int64)
    a, b = rep[roots] if len(rep) else rep, rep
    keep = a != b
    rank, h, agree = (table.column(c).to_numpy() for c in ("rank", "h", "agree"))
    n, first = len(rep), int(table.column("block")[0].as_py()) * block
    after, before = np.full(n, -1.0), np.full(n, -1.0)
    if n > window:
        same = gid[window:] == gid[:-window]
        common = BITS - np.array([(int(v)).bit_length() for v in h[window:] ^ h[:-window]], dtype=np.float64)
        after[:-window], before[window:] = np.where(same, common, -1.0), np.where(same, common, -1.0)
    place = rank - first
    tell = [(after, place < block), (before, (place >= window) | (first <= 0))]
    at = np.concatenate([np.flatnonzero(mask) for _, mask in tell])
    missed = np.concatenate([_missed(bits, agree)[mask] for bits, mask in tell])
    none, zeros = pa.nulls(len(at), pa.int64()), pa.nulls(int(keep.sum()), pa.int64())
    return pa.table({
        "a": pa.chunked_array([pa.array(a[keep], pa.int64()), none]), "b": pa.chunked_array([pa.array(b[keep], pa.int64()), none]),
        "rep": pa.chunked_array([zeros, pa.array(rep[at], pa.int64())]),
        "space": pa.chunked_array([zeros, pa.array(table.column("space").to_numpy()[at], pa.int64())]),
        "run": pa.chunked_array([zeros, pa.array(gid[at], pa.int64())]),
        "missed": pa.chunked_array([zeros.cast(pa.float64()), pa.array(missed, pa.float64())])})


def _square_links(table: pa.Table, threshold: float) -> pa.Table:
    """Stars that unite the linked pairs of a pair of blocks, laid out as for ``_square_counts``."""
    side, rep = table.column("side").to_numpy(), table.column("rep").to_numpy()
    x = _matrix(table.column("x").combine_chunks(), int(table.column("dim")[0].as_py()))
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if bool(table.column("own")[0].as_py()):
        two = one
    forest = _Forest(len(rep))
    i, j = np.nonzero(x[one] @ x[two].T >= threshold)
    for p, q in zip(one[i].tolist(), two[j].tolist()):
        forest.unite(p, q)
    roots = np.array([forest.root(k) for k in range(len(rep))], dtype=np.int64)
    keep = rep[roots] != rep
    return pa.table({"a": pa.array(rep[roots][keep], pa.int64()), "b": pa.array(rep[keep], pa.int64())})


def _squares(vectors: DataFrame, group: str, square: int) -> DataFrame:
    """``vectors`` (``rep``, ``x``, ``dim``, ``copies``, the group) once for each pair of blocks (``i``, ``j``) that they are part of."""
    sizes = vectors.groupBy(group).count().select(group, F.ceil(F.col("count") / square).cast("int").alias("parts"))
    rows = (vectors.join(sizes, group).withColumn("own_part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    lo, hi = F.least("own_part", "other"), F.greatest("own_part", "other")
    return rows.select("rep", "x", "dim", "copies", group, lo.alias("i"), hi.alias("j"),
                       F.when(F.col("own_part") == lo, 0).otherwise(1).alias("side"), (lo == hi).alias("own"))


def _means(reps: DataFrame) -> DataFrame:
    """``space`` and ``mean``, the mean of its unit vectors."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            spaces, dims = batch.column("space").to_numpy(), batch.column("dim").to_numpy()
            for space in set(spaces.tolist()):
                at = np.flatnonzero(spaces == space)
                x = _matrix(batch.column("x").take(pa.array(at)), int(dims[at[0]]))
                old = sums.get(space, (0, 0.0))
                sums[space] = (old[0] + len(at), old[1] + x.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v[0] for v in sums.values()], pa.int64()),
                                          pa.array([v[1] for v in sums.values()], pa.list_(pa.float64()))], ["space", "n", "total"])

    def whole(table: pa.Table) -> pa.Table:
        mean = np.sum([np.array(v) for v in table.column("total").to_pylist()], axis=0) / sum(table.column("n").to_pylist())
        return pa.table({"space": table.column("space")[:1], "mean": pa.array([mean], pa.list_(pa.float64()))})

    parts = reps.select("space", "dim", "x").mapInArrow(part, "space long, n long, total array<double>")
    return written(parts.groupBy("space").applyInArrow(whole, "space long, mean array<double>"), "means")


def _square_counts(table: pa.Table, threshold: float) -> pa.Table:
    """Links of each vector of a pair of blocks (``side`` 0 and 1; one block with itself if there is no side 1)."""
    side, weight = table.column("side").to_numpy(), table.column("copies").to_numpy()
    rep, dim = table.column("rep").to_numpy(), int(table.column("dim")[0].as_py())
    x = _matrix(table.column("x").combine_chunks(), dim)
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if len(two) or not bool(table.column("own")[0].as_py()):
        hit = x[one] @ x[two].T >= threshold
        who, n = np.concatenate([one, two]), np.concatenate([hit @ weight[two], weight[one] @ hit])
    else:
        hit = x @ x.T >= threshold
        np.fill_diagonal(hit, False)
        who, n = one, hit @ weight
    return pa.table({"rep": pa.array(rep[who], pa.int64()), "n": pa.array(n.astype(np.int64))})


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD, window: int = WINDOW, block: int = BLOCK, square: int = SQUARE,
                    passes: int | None = None, seed: int = 11) -> DataFrame:
    """One row per row of ``vectors``: key, ``n_links``, ``component_id`` (smallest key reachable), ``kept``.

    Vectors are compared only if labels are equal and not null and lengths are equal.  Null, empty and zero vectors and those with null or
    non-finite components link with nothing, nor do rows with a null key, whose component is null and which are kept.  Equal
    vectors link with each other, also in repeated rows.  Different vectors under one key count as one node.  An empty table gives no
    rows; other columns are not read.
    """
    spark = vectors.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = vectors.schema[vector].dataType.simpleString()
    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("x"), F.col(label).alias("label"))
    fit = (F.col("k").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("x") > 0, F.lit(False))
           & F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))
           & F.coalesce(F.exists("x", lambda v: v != 0), F.lit(False)))
    good = rows.where(fit)
    reps = written(good.groupBy("label", "x").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("copies"))
                   .withColumn("dim", F.size("x")).withColumn("space", F.xxhash64("label", "dim")), "vectors")
    members = written(good.join(reps.select("label", "x", "rep", "copies"), ["label", "x"]).select("k", "rep", "copies"), "members")
    if passes is None:
        largest = reps.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 1
        passes = passes_for(largest, threshold, window)

    far = math.sqrt(max(0.0, 2 - 2 * threshold))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
        for batch in batches:
            out, agree = np.zeros((batch.num_rows, passes), np.int64), np.zeros(batch.num_rows)
            dims = batch.column("dim").to_numpy()
            for dim in set(dims.tolist()):
                if dim not in planes:
                    planes[dim] = _planes(dim, passes, seed)
                at = np.flatnonzero(dims == dim)
                x = _matrix(batch.column("x").take(pa.array(at)), dim)
                x -= np.array(batch.column("mean").take(pa.array(at)).to_pylist())
                # The widest angle, seen from the mean, to a vector at the threshold.
                length = np.sqrt((x * x).sum(axis=1))
                agree[at] = np.where(length > far, 1 - np.arcsin(np.minimum(1.0, far / np.maximum(length, 1e-300))) / math.pi, 0.0)
                out[at] = ((x @ planes[dim]) > 0).reshape(len(at), passes, BITS) @ powers
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * passes), pa.array(out.ravel()))
            names = [c for c in batch.schema.names if c != "mean"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(agree), lists], [*names, "agree", "keys"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n, dtype=np.int64))],
                [*batch.schema.names, "part", "place"])
            at += n

    label_kind = vectors.schema[label].dataType.simpleString()
    base = f"label {label_kind}, x {kind}, rep long, copies long, dim int, space long"
    centred = reps.join(_means(reps), "space").select("label", "x", "rep", "copies", "dim", "space", "mean")
    hashed = centred.mapInArrow(keys, f"{base}, agree double, keys array<long>")
    passed = hashed.select("label", "dim", "rep", "x", "space", "agree", F.posexplode("keys").alias("pass", "h"))
    ordered = (passed.repartitionByRange(shuffles, "pass", "label", "dim", "h", "rep")
               .sortWithinPartitions("pass", "label", "dim", "h", "rep")
               .select(F.xxhash64("pass", "label", "dim").alias("run"), "dim", "rep", "x", "space", "agree", "h"))
    placed = written(ordered.mapInArrow(number, f"run long, dim int, rep long, x {kind}, space long, agree double, h long, part long, place long"), "ordered")
    # One short row per range of the order: its first rank is a running sum over the list of ranges.
    starts = placed.groupBy("part").count().select(
        "part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    ranked = placed.join(starts, "part").select("run", "dim", "rep", "x", "space", "agree", "h", (F.col("first") + F.col("place")).alias("rank"))
    own = F.floor(F.col("rank") / block).cast("long")
    # A block also gets the first rows of the next one, which its last rows' windows reach.
    halo = F.when(F.col("rank") % block < window, F.array(own, own - 1)).otherwise(F.array(own))
    blocks = ranked.select("*", F.explode(halo).alias("block"))
    told = written(blocks.groupBy("block").applyInArrow(
        lambda t: _window_links(t, threshold, window, block), "a long, b long, rep long, space long, run long, missed double"), "told")
    stars = told.where("a is not null").select("a", "b")
    open_ = (told.where("rep is not null").groupBy("rep", "space", "run").agg(F.max("missed").alias("missed"))
             .groupBy("rep", "space").agg(F.sum("missed").alias("missed")).where(F.col("missed") >= math.log(MISS)).select("rep", "space"))
    rest = _squares(written(reps.join(open_, ["rep", "space"]), "open"), "space", square)
    stars = stars.unionByName(rest.groupBy("space", "i", "j").applyInArrow(lambda t: _square_links(t, threshold), "a long, b long"))
    groups = written(components(stars.distinct()), "components")

    # Exact links inside components, by square blocks; a vector's block is a hash, so no component is ever in one task.
    inner = _squares(reps.join(groups, F.col("rep") == F.col("node")).select("rep", "x", "dim", "copies", "root"), "root", square)
    counts = (inner.groupBy("root", "i", "j").applyInArrow(lambda t: _square_counts(t, threshold), "rep long, n long")
              .groupBy("rep").agg(F.sum("n").alias("n")))
    per_rep = written(groups.join(counts, F.col("node") == F.col("rep"), "left").select(F.col("node").alias("rep"), "root", "n"), "links")
    linked = members.join(per_rep, "rep", "left").groupBy("k").agg(
        F.min(F.coalesce("root", "rep")).alias("c"), F.max(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    out = rows.select("k").join(linked, "k", "left")
    component = F.coalesce("c", "k")
    return out.select(F.col("k").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("k") == component, F.lit(True)).alias("kept"))
