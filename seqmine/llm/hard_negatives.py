"""Hard-negative mining by threshold joins on an inverted index with norm bounds.

Anchors are a stated set of queries; every anchor meets every row, in blocks of both.  For each anchor the first rows of its own label by
inner product are its positives, and each positive opens a window of scores in which the first rows of other labels are its hard
negatives.  Both searches are the same threshold join:

A round gives every open window a threshold, high at first, and finds all rows of the window from there up.  Windows with enough rows are
done, the others get a lower threshold and search only the band below the last one, until their lower end is reached.

Inside a pair of blocks, dimensions are ordered by their share in the rows' norms and taken in groups.  A row is indexed only up to the group
from which on its remaining norm times the largest remaining norm of the anchors is below the lowest threshold; a row with nothing to
index is no candidate.  Rows of one indexed length are scored in tiles; half-way and at the end pairs are dropped whose partial score and
product of remaining norms do not reach the anchor's threshold, and what is left is scored whole in integers.  An anchor's threshold rises from
tile to tile to the last score that its windows still need.  The bounds only ever skip pairs that cannot be in a window, so results are exact.

Each pair of blocks returns at most as many rows per window as the window wants; windows are merged by a ranked window, which drops
rows before its shuffle.

Spark sizes a join's sides by their files, which say little of vectors that compress well or are repeated for each block.  So joins whose sides
grow with the anchors are merge joins, and anchors are repeated for the blocks after their joins: nothing of that size meets in the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqmine.llm.storage import written

POSITIVES, NEGATIVES = 5, 10
#: Bounds of a negative's score in per cent of its positive's.
LOW, HIGH = 30, 90
#: Thresholds of the rounds: place between a window's lower (0) and upper end (1); the last round is always 0.
WIDE_STEPS, WINDOW_STEPS = (0.75, 0.6), (0.5, 0.25)
#: Rows and anchors of a block, at least and at most, and most components; in between, so many blocks that all tasks have some.
LEAST_BLOCK, MOST_BLOCK, MOST_CELLS = 1024, 1 << 16, 1 << 22
#: Pairs that are worth a task of their own beyond a few for each core.
TASK_PAIRS = 1 << 25
#: Anchors scored at once in a task, rows that meet them at once (fewer at first, to raise thresholds), and dimensions in a posting list's group.
CHUNK, TILE, FIRST_TILE, GROUP = 256, 2048, 256, 8
#: Pairs scored whole at once.
PAIRS = 1 << 16


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Integer vectors as rows, shorter ones filled with zeros."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    out = np.zeros((len(lists), width), np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _suffix_norms(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Norm of what is left of each row from each start on; one column per start and a last one of zeros."""
    squares = np.add.reduceat(x.astype(np.float64) ** 2, starts, axis=1)
    left = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.hstack([left, np.zeros((len(x), 1))])) * (1 + 1e-9)


class Index:
    """The rows ``y`` of a block with their dimensions in order, and what norm is left of each row from each group of dimensions on."""

    def __init__(self, y: np.ndarray):
        self.dims = np.argsort(-(y.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        self.rows = y[:, self.dims]
        self.starts = np.arange(0, y.shape[1], GROUP)
        self.left = _suffix_norms(self.rows, self.starts)
        self._typed: dict[type, np.ndarray] = {}

    def _values(self, kind: type) -> np.ndarray:
        if kind not in self._typed:
            self._typed = {kind: self.rows.astype(kind)}
        return self._typed[kind]

    def pairs(self, x: np.ndarray, floors: np.ndarray, allowed) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All pairs (row of ``x``, row of ``y``, integer score) with a score of at least the ``floors`` of ``x``'s row, tile by tile of ``y``.

        ``floors`` may rise between two tiles.  ``allowed(ys)`` is a mask of pairs for a choice of rows of ``y``.
        """
        x = x[:, self.dims]
        xs, ys, groups = _suffix_norms(x, self.starts), self.left, len(self.starts)
        # Sums of products stay exact in floats below 2 ** 24 and in doubles below 2 ** 53; beyond that Python's integers are used.
        top = float(xs[:, 0].max(initial=0.0)) * float(ys[:, 0].max(initial=0.0))
        kind = np.float32 if top < 2.0 ** 23 else np.float64 if top < 2.0 ** 52 else object
        real = np.float32 if kind is np.float32 else np.float64
        xf, yf, xr = x.astype(kind), self._values(kind), xs.astype(real)
        slack = 1 + 8 * float(np.finfo(real).eps) * top

        covered = ys * xs.max(axis=0)[None, :] < float(floors.min())  # from this group on nothing can reach any threshold alone
        length = np.where(covered.any(axis=1), covered.argmax(axis=1), groups)
        size = FIRST_TILE
        for upto in range(groups, 0, -1):
            listed, at = np.flatnonzero(length == upto), 0
            while at < len(listed):
                tile = listed[at:at + size]
                at, size = at + len(tile), TILE
                yield from self._tile(tile, upto, xf, yf, xr, floors, (floors - slack).astype(real)[:, None], allowed)

    def _tile(self, tile: np.ndarray, upto: int, xf: np.ndarray, yf: np.ndarray, xr: np.ndarray, floors: np.ndarray, bar: np.ndarray,
              allowed) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The pairs of rows that are all indexed through ``upto`` groups."""
        groups, y = len(self.starts), yf[tile]

        def part(begin: int, end: int) -> np.ndarray:
            cols = slice(begin * GROUP, end * GROUP)
            return xf[:, cols] @ y[:, cols].T

        def reachable(partial: np.ndarray, n: int) -> np.ndarray:
            known = partial.astype(bar.dtype, copy=False)
            return (known if n == groups else known + xr[:, n, None] * self.left[tile, n].astype(bar.dtype)) >= bar

        half = min(upto, groups // 2) if groups > 2 else upto
        partial = part(0, half)
        if half < upto:
            live = reachable(partial, half).any(axis=0)
            if not live.any():
                return
            if not live.all():
                tile, y, partial = tile[live], y[live], partial[:, live]
            partial += part(half, upto)
        hit = reachable(partial, upto)
        if upto < groups and 16 * np.count_nonzero(hit) > hit.size:  # too many to score them one by one
            partial += part(upto, groups)
            upto = groups
            hit = reachable(partial, groups)
        a, b = np.divmod(np.flatnonzero(hit & allowed(tile)), len(tile))
        if not len(a):
            return
        whole = object if xf.dtype == object else np.int64
        if upto == groups:
            score = partial[a, b].astype(whole)
        else:
            score = np.empty(len(a), whole)
            for at in range(0, len(a), PAIRS):
                some = slice(at, at + PAIRS)
                score[some] = (xf[a[some]] * y[b[some]]).sum(axis=1)
        good = score >= floors[a]
        yield a[good], tile[b[good]], score[good]


def candidates(x: np.ndarray, y: np.ndarray, floors: np.ndarray, allowed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of ``Index.pairs`` at once."""
    found = [*Index(y).pairs(x, floors, allowed)]
    return tuple(np.concatenate([np.empty(0, np.int64), *column]) for column in zip(*found)) if found else (np.empty(0, np.int64),) * 3


class Leading:
    """The first ``k`` rows of each window of some anchors so far: higher scores first, then smaller keys.

    Windows are in the order of their anchors, each of which has ``counts`` of them, one at least.  ``floors`` are the least scores that
    an anchor's windows still need; they rise when windows are full.
    """

    def __init__(self, counts: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int):
        self.counts, self.first, self.hi, self.k = counts, np.cumsum(counts) - counts, hi, k
        self.least, self.last = lo.copy(), np.full(len(lo), np.iinfo(np.int64).max)  # score and key of a full window's last row
        self.floors, self.ceilings = np.minimum.reduceat(lo, self.first), np.maximum.reduceat(hi, self.first)
        self.window = self.key = self.score = np.empty(0, np.int64)

    def add(self, a: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        """Rows with the anchors ``a``."""
        inside = score <= self.ceilings[a]
        a, key, score = a[inside], key[inside], score[inside].astype(np.int64)
        n = self.counts[a]
        pair = np.repeat(np.arange(len(a)), n)
        window = np.repeat(self.first[a] - (np.cumsum(n) - n), n) + np.arange(len(pair))
        key, score = key[pair], score[pair]
        fits = (score <= self.hi[window]) & ((score > self.least[window]) | (score == self.least[window]) & (key <= self.last[window]))
        if not fits.any():
            return
        window, key, score = (np.concatenate(x) for x in ((self.window, window[fits]), (self.key, key[fits]), (self.score, score[fits])))
        order = np.lexsort((key, -score, window))
        place = np.arange(len(order)) - np.searchsorted(window[order], window[order], side="left")
        order, place = order[place < self.k], place[place < self.k]
        self.window, self.key, self.score = window[order], key[order], score[order]
        full = np.flatnonzero(place == self.k - 1)
        self.least[self.window[full]], self.last[self.window[full]] = self.score[full], self.key[full]
        self.floors[:] = np.minimum.reduceat(self.least, self.first)


def _block_search(keys: tuple, rows: pa.Table, queries: pa.Table, k: int, same: bool) -> pa.Table:
    """At most the first ``k`` rows of a block for each window of a block of queries."""
    out: list[tuple] = [(np.empty(0, np.int64),) * 4]
    if rows.num_rows and queries.num_rows:
        width = max([1, *(int(np.diff(c.offsets.to_numpy()).max(initial=0)) for t in (rows, queries) for c in t.column("v").chunks)])
        labels = pa.concat_arrays([c for t in (rows, queries) for c in t.column("label").chunks]).dictionary_encode().indices.to_numpy()
        key = rows.column("key").to_numpy()
        order = np.argsort(key, kind="stable")  # of equal scores the first rows are met first
        index = Index(_matrix(rows.column("v"), width)[order])
        key, rid, label = key[order], rows.column("rid").to_numpy()[order], labels[:len(key)][order]
        mine, own = labels[len(key):], queries.column("rid").to_numpy()
        bands = pa.concat_arrays(queries.column("bands").chunks)
        counts = np.diff(bands.offsets.to_numpy()).astype(np.int64)
        p, lo, hi = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in bands.flatten().flatten())
        begin = np.concatenate([[0], np.cumsum(counts)])
        for at in range(0, queries.num_rows, CHUNK):
            some, held = slice(at, at + CHUNK), slice(begin[at], begin[min(at + CHUNK, len(counts))])
            leading = Leading(counts[some], lo[held], hi[held], k)

            def allowed(ys: np.ndarray) -> np.ndarray:
                alike = mine[some, None] == label[ys]
                return alike & (own[some, None] != rid[ys]) if same else ~alike

            for a, b, score in index.pairs(_matrix(queries.column("v").slice(at, CHUNK), width), leading.floors, allowed):
                leading.add(a, key[b], score)
            owner = np.repeat(own[some], counts[some])
            out.append((owner[leading.window], p[held][leading.window], leading.key, leading.score))
    rid, p, key, score = (np.concatenate(x) for x in zip(*out))
    return pa.table({"rid": pa.array(rid, pa.int64()), "p": pa.array(p.astype(np.int32), pa.int32()),
                     "key": pa.array(key, pa.int64()), "score": pa.array(score, pa.int64())})


def search(rows: DataFrame, queries: DataFrame, windows: DataFrame, k: int, steps: Sequence[float], same: bool,
           most: int = MOST_BLOCK) -> DataFrame:
    """The first ``k`` rows of each window: ``rid``, ``p``, ``key``, ``score`` and ``rank`` from 1; higher scores first, then smaller keys.

    ``rows`` and ``queries`` are written tables of ``rid``, ``key``, ``label``, ``v``; ``windows`` has ``rid`` (a query), ``p``, ``lo`` and ``hi``,
    both ends included.  ``same`` takes other rows of the query's label, else rows of other labels.
    """
    spark = rows.sparkSession
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    limits = [F.max(F.size("v")).alias("width"), F.max(F.array_max("v")).alias("high"), F.min(F.array_min("v")).alias("low")]
    asked = queries.agg(F.count(F.lit(1)).alias("n"), *limits).first()
    known = (rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm"), *limits)
             .agg(F.max("n").alias("held"), F.sum("n").alias("n"), F.max("norm").alias("norm"), F.max("width").alias("width"),
                  F.max("high").alias("high"), F.min("low").alias("low")).first())
    if not known.n or not asked.n:
        return spark.createDataFrame([], "rid long, p int, key long, score long, rank int")
    held = known.held if same else known.n
    most = min(most, max(1, MOST_CELLS // max(1, known.width, asked.width)))
    n_queries = math.ceil(asked.n / most)
    tasks = min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")),
                max(4 * spark.sparkContext.defaultParallelism, math.ceil(held * asked.n / TASK_PAIRS)))
    n_rows = math.ceil(held / min(most, max(min(most, LEAST_BLOCK), math.ceil(held * n_queries / tasks))))

    reach = (F.ceil(norm * F.lit(known.norm) * (1 + 1e-9)) + 1).cast("long")
    span = written(windows.join(queries.select("rid", reach.alias("b")).hint("merge"), "rid")
                   .select("rid", "p", F.greatest("lo", -F.col("b")).alias("lo"), F.least("hi", "b").alias("hi"))
                   .where("lo <= hi"), "spans")

    # Vectors travel in the narrowest type that holds all components.
    far = max(abs(x or 0) for x in (known.high, known.low, asked.high, asked.low))
    narrow = F.col("v").cast(f"array<{'smallint' if far < 1 << 15 else 'int' if far < 1 << 31 else 'bigint'}>").alias("v")
    place = lambda n, salt: F.pmod(F.xxhash64("rid", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    group = ["label", "i", "j"] if same else ["i", "j"]
    blocks = rows.select("rid", "key", "label", narrow, place(n_rows, 1).alias("i"), each(n_queries).alias("j"))

    def scored(keys, left: pa.Table, right: pa.Table) -> pa.Table:
        return _block_search(keys, left, right, k, same)

    at = lambda f: F.least("hi", F.col("lo") + F.ceil((F.col("hi") - F.col("lo")).cast("double") * F.lit(float(f))).cast("long"))
    first = Window.partitionBy("rid", "p").orderBy(F.desc("score"), "key")
    found, open_, above = None, span, None
    for f in [*steps, 0.0]:
        low = at(f) if f else F.col("lo")
        high = F.col("hi") if above is None else at(above) - 1
        bands = (open_.select("rid", "p", low.alias("l"), high.alias("h")).where("l <= h").groupBy("rid")
                 .agg(F.collect_list(F.struct("p", F.col("l").alias("lo"), F.col("h").alias("hi"))).alias("bands")))
        if bands.isEmpty():
            if open_.isEmpty():
                break
            above = f
            continue
        dealt = (queries.join(bands.hint("merge"), "rid")
                 .select("rid", "label", "bands", narrow, place(n_queries, 2).alias("j"), each(n_rows).alias("i")))
        new = (blocks.groupBy(*group).cogroup(dealt.groupBy(*group))
               .applyInArrow(scored, "rid long, p int, key long, score long"))
        both = new if found is None else found.drop("rank").unionByName(new)
        found = written(both.withColumn("rank", F.row_number().over(first)).where(f"rank <= {k}"), "found")
        full = found.groupBy("rid", "p").count().where(f"count = {k}").select("rid", "p")
        open_ = written(open_.join(full.hint("merge"), ["rid", "p"], "left_anti"), "open")
        above = f
    if found is None:
        return spark.createDataFrame([], "rid long, p int, key long, score long, rank int")
    return found


def mine(vectors: DataFrame, anchor: Column, *, key: str = "vec_id", vector: str = "v", label: str = "label", positives: int = POSITIVES,
         negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = MOST_BLOCK) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score`` for rows where ``anchor`` holds.

    ``vector`` holds integers; scores are inner products, a missing dimension counts as 0.  Positives are the first ``positives`` other rows of
    the anchor's label, negatives the first ``negatives`` rows of another label with ``low * positive_score <= 100 * negative_score <= high *
    positive_score``.  Higher scores come first, then smaller keys.  Rows with a null key, label, vector or component take no part.  Each
    row counts for itself, so repeated rows are other rows of each other, and a repeated anchor gives its result again.
    Columns besides the three are not read.  An anchor without positives and a positive without negatives give no row, nor does an empty
    table.  A score that does not fit a long stops the query.
    """
    whole = F.coalesce(F.forall(vector, lambda c: c.isNotNull()), F.lit(False))
    rows = written(vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & whole).select(
        F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("key"), F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<bigint>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("asks")), "vectors")
    queries = written(rows.where("asks").drop("asks"), "anchors")
    rows = rows.drop("asks")
    most = (1 << 62)
    wide = queries.select("rid", F.lit(0).alias("p"), F.lit(-most).alias("lo"), F.lit(most).alias("hi"))
    near = search(rows, queries, wide, positives, WIDE_STEPS, True, block)
    near = written(near.select("rid", (F.col("rank") - 1).alias("p"), F.col("key").alias("positive_id"),
                               F.col("score").alias("positive_score")), "positives")
    score = F.col("positive_score")
    share = lambda per_cent, more: F.expr(f"{per_cent} * (positive_score div 100) + ({per_cent} * (positive_score % 100) + {more}) div 100")
    windows = near.where(score >= 0).select("rid", "p", share(low, 99).alias("lo"), share(high, 0).alias("hi"))
    found = search(rows, queries, windows, negatives, WINDOW_STEPS, False, block)
    return (found.join(near.hint("merge"), ["rid", "p"]).join(queries.select("rid", F.col("key").alias("anchor_id")).hint("merge"), "rid")
            .select("anchor_id", "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
