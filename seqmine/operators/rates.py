"""Inferring the rate of a run of frames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from seqmine.functions.rational import rational, whole_div
from seqmine.plans.blocks import Run, last_where, null_safe_join
from seqmine.session import cut

WORD = 62
EARLY = 4
GROWTH = 16
#: Neighbouring intervals of one start that are listed in a row before they are packed.
LISTED = 4096
#: Gaps of a run that are tested in the task that lists its hypotheses.
REACH = 64
#: Starts of one run in a row, and hypotheses that a task holds at a time.
STARTS = 64
TRIED = 1 << 20


@dataclass(frozen=True)
class Template:
    """A known frame pattern: slots ``(start, end)`` repeating after ``loop`` positions."""

    name: str
    num: int
    den: int
    slots: tuple[tuple[int, int], ...]
    loop: int | None = None


def match_template(frames: DataFrame, templates: Sequence[Template], *,
                   keys: Sequence[str] = ("src",)) -> DataFrame:
    """Templates that every frame after the first fits; the smallest numerator wins.

    ``start`` and ``end`` count from the start of the run's first frame.  A frame
    fits if it starts where a slot starts and ends inside one that starts there.  Each template is an array of slot ends by
    phase, a constant of the plan; frames are tested in a projection and only the verdicts are combined per run.
    """
    heads = []
    rows = frames.where(F.col("start") > 0)
    tests = []
    for i, t in enumerate(templates):
        ends = [-1] * (max((a for a, _ in t.slots), default=0) + 1)
        for a, b in t.slots:
            ends[a] = max(ends[a], b)
        # The optimizer turns this into a literal; no frame ends at -1.
        table = F.split(F.lit(",".join(map(str, ends))), ",").cast("array<bigint>")
        phase = F.col("start") if t.loop is None else F.pmod(F.col("start"), F.lit(t.loop).cast("bigint"))
        last = F.when(phase < len(ends), F.get(table, phase.cast("int")))
        fits = F.coalesce(F.col("end") - F.col("start") + phase <= last, F.lit(False))
        tests.append(F.bool_and(fits).alias(f"_ok{i}"))
        heads.append(F.when(F.col(f"_ok{i}"), F.struct(F.lit(t.num).cast("bigint").alias("num"), F.lit(t.den).cast("bigint").alias("den"),
                                                       F.lit(t.name).alias("template"))))
    return (rows.groupBy(*keys).agg(*tests).withColumn("_b", F.array_min(F.array(*heads))).where("_b IS NOT NULL")
            .select(*keys, "_b.num", "_b.den", "_b.template"))


def frame_gaps(frames: DataFrame, run: Run) -> DataFrame:
    """Where each frame after the first may have begun: ``lo`` to ``hi``, and its number."""
    rows = last_where(frames, run, ["end"], {}, index="n", keep_prev=True)
    return (rows.where(F.col("n") > 0)
            .select(*run.keys, "n", (F.col("prev.end") + 1).alias("lo"), F.col("start").alias("hi")))


def first_gaps(gaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per run what the hypotheses start from: gap 1 (``p_lo`` to ``p_hi``), the end of gap 2 (``third``), the width of the shortest later
    gap (``sure``), the narrowest of the ``EARLY`` gaps from gap 2 on (``near``), the ``REACH`` gaps from gap 2 on (``first``, in order) and the
    number of the last gap (``last``); runs of two gaps or more."""
    at = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
    later, close = F.col("n") >= 2, F.col("n").between(2, 1 + EARLY)
    return gaps.groupBy(*keys).agg(
        at(1, "lo").alias("p_lo"), at(1, "hi").alias("p_hi"), at(2, "hi").alias("third"),
        F.min(F.when(later, F.col("hi") - F.col("lo") + 1)).alias("sure"),
        F.min(F.when(close, F.struct((F.col("hi") - F.col("lo") + 1).alias("width"), "lo", "hi"))).alias("near"),
        F.array_sort(F.collect_list(F.when(F.col("n").between(2, 1 + REACH), F.struct("n", "lo", "hi")))).alias("first"),
        F.max("n").alias("last"),
    ).where("third is not null")


def _holds(p: Column, n: Column, lo: Column, hi: Column) -> Column:
    return whole_div(hi - p, n) * n >= lo - p


def hypotheses(early: DataFrame, keys: Sequence[str], reach: int | None = None, best: bool = False) -> DataFrame:
    """Starts ``p`` and intervals ``n`` that hold in the first ``reach`` (by default ``EARLY``) gaps.

    Only intervals that fit the narrowest of the early gaps are tried at all: those not longer than it, and for each multiple k
    the few that put p plus k intervals into it.  A run's starts are dealt in rows of ``STARTS``; a task tries the intervals of many rows as
    arrays of at most about ``TRIED``.  With ``best`` a row whose run has no gap beyond gives its longest interval only.
    """
    reach, keys = reach or EARLY, list(keys)
    rows = (early.withColumn("_from", F.explode(F.sequence(F.least("p_lo", "p_hi"), F.greatest("p_lo", "p_hi"), F.lit(STARTS).cast("bigint"))))
            .withColumn("_to", F.least(F.col("_from") + (STARTS - 1), F.greatest("p_lo", "p_hi"))))
    long = lambda c, name: F.col(c).cast("bigint").alias(name)
    first = F.slice("first", 1, reach)
    rows = rows.select(*keys, long("_from", "_from"), long("_to", "_to"), long("third", "_third"), long("sure", "_sure"), long("near.width", "_w"),
                       long("near.lo", "_lo"), long("near.hi", "_hi"), long("last", "_last"),
                       first["lo"].cast("array<bigint>").alias("_los"), first["hi"].cast("array<bigint>").alias("_his"))
    schema = StructType([*early.select(*keys).schema.fields, StructField("p", LongType()), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _numbers(batch, "_last") <= reach + 1 if best else np.zeros(batch.num_rows, bool)
            top, top_p = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, p, n in _holding(batch):
                done = whole[row]
                # Sorted by interval, the last entry of a row is its longest.
                order = np.flatnonzero(done)[np.argsort(n[done], kind="stable")]
                order = order[n[order] > top[row[order]]]
                top[row[order]], top_p[row[order]] = n[order], p[order]
                if not done.all():
                    yield _named(batch, keys, row[~done], p[~done], n[~done])
            row = np.flatnonzero(top)
            if len(row):
                yield _named(batch, keys, row, top_p[row], top[row])

    return rows.mapInArrow(run, schema)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _named(batch: pa.RecordBatch, keys: Sequence[str], row: np.ndarray, p: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(row)) for k in keys], pa.array(p), pa.array(n)], [*keys, "p", "n"])


def _repeated(count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each index as often as ``count`` says with the numbers from 0 on beside it, in slices of about ``TRIED``, one index at least."""
    ends = np.cumsum(count)
    at = 0
    while at < len(count):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + TRIED, side="right")))
        index = np.repeat(np.arange(at, to), count[at:to])
        yield index, np.arange(len(index)) - np.repeat(ends[at:to] - count[at:to] - base, count[at:to])
        at = to


def _holding(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, start and interval of all hypotheses that hold in the gaps listed in their row."""
    start, third, sure, width, near_lo, near_hi = (_numbers(batch, c) for c in ("_from", "_third", "_sure", "_w", "_lo", "_hi"))
    for row, step in _repeated(_numbers(batch, "_to") - start + 1):
        p = start[row] + step
        w, least, most = width[row], np.maximum(sure[row] + 1, 2), third[row] - p
        multiples = np.where(w > 0, np.maximum(near_hi[row] - p, 0) // np.maximum(w + 1, 1), 0)
        # A far gap has more multiples than there are intervals to try.
        far = multiples > most
        multiples = np.where(far, 0, multiples)
        for index, k in _repeated(multiples + 1):
            k0, at = np.maximum(k, 1), p[index]
            a = np.where(k == 0, least[index], np.maximum(np.maximum(least[index], w[index] + 1), -((at - near_lo[row[index]]) // k0)))
            b = np.where(k == 0, np.where(far[index], most[index], np.minimum(most[index], w[index])),
                         np.minimum(most[index], (near_hi[row[index]] - at) // k0))
            some = np.flatnonzero(a <= b)
            # A long span is tried in parts.
            pieces = (b[some] - a[some]) // TRIED + 1
            some, part = (np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*_repeated(pieces))) if len(some) else (some, some)
            if len(some):
                found = np.flatnonzero(a <= b)[some]
                a, b, index = a[found] + part * TRIED, b[found], index[found]
                for which, more in _repeated(np.minimum(b - a + 1, TRIED)):
                    yield from _tested(batch, row[index[which]], p[index[which]], a[which] + more)


def _tested(batch: pa.RecordBatch, row: np.ndarray, p: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    offsets = batch.column("_los").offsets.to_numpy()
    los, his = (batch.column(c).values.to_numpy(zero_copy_only=False) for c in ("_los", "_his"))
    sizes, gap = np.diff(offsets), 0
    waiting = []
    while len(row):
        more = sizes[row] > gap
        if not more.all():
            waiting.append((row[~more], p[~more], n[~more]))
            row, p, n = row[more], p[more], n[more]
        at = offsets[row] + gap
        ahead = his[at] - p
        # Division rounds towards zero.
        reached = np.where(ahead >= 0, ahead // n, -(-ahead // n)) * n
        held = reached >= los[at] - p
        row, p, n, gap = row[held], p[held], n[held], gap + 1
    if waiting:
        yield tuple(np.concatenate(x) for x in zip(*waiting))


def survivors(alive: DataFrame, gaps: DataFrame, keys: Sequence[str], low: int, high: int) -> DataFrame:
    """Hypotheses that also hold in the gaps numbered from ``low`` to below ``high``.

    ``WORD`` of them travel in a row; each gap yields a bit mask per row and the masks are combined by a map-side ``bit_and``.
    """
    keys = list(keys)
    words = (alive.groupBy(*keys, "p", F.expr(f"n div {LISTED}").alias("_part")).agg(F.sort_array(F.collect_list("n")).alias("_ns"))
             .withColumn("_from", F.explode(F.sequence(F.lit(1), F.size("_ns"), F.lit(WORD))))
             .select(*keys, "p", "_part", "_from", F.slice("_ns", F.col("_from"), WORD).alias("ns")))
    rest = gaps.where(F.col("n").between(low, high - 1)).select(*keys, "lo", "hi", F.lit(True).alias("_gap"))
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    mask = F.aggregate("ns", zero, lambda acc, n: acc * 2 + F.when(
        F.col("_gap").isNull() | _holds(F.col("p"), n, F.col("lo"), F.col("hi")), one).otherwise(zero))
    # Runs without such a gap keep their hypotheses; null keys are keys like others.
    meet = null_safe_join(words, rest, keys, "left")
    return (meet.withColumn("_m", mask).groupBy(*keys, "p", "_part", "_from").agg(F.bit_and("_m").alias("_m"), F.first("ns").alias("ns"))
            .where("_m <> 0")
            .select(*keys, "p", F.explode(F.expr("filter(ns, (n, i) -> (shiftright(_m, size(ns) - 1 - i) & 1) = 1)")).alias("n")))


def infer_interval(frames: DataFrame, run: Run) -> DataFrame:
    """Largest constant interval n that puts a frame start into every gap.

    A hypothesis is a start p of frame 2 inside its gap and an interval n >= 2 that
    fits before frame 3; it holds if every later gap contains p plus a multiple of n.
    If none holds the interval is 1; runs of fewer than three frames give nothing.

    An interval no longer than the shortest later gap always holds, so only longer ones are tried, in the task that lists them, in the first
    ``REACH`` gaps.  What is left of longer runs meets the others in rounds of ``GROWTH`` times as many gaps; each round reads only what the
    rounds before left.
    """
    keys = list(run.keys)
    gaps = cut(frame_gaps(frames, run))
    early = cut(first_gaps(gaps, keys))
    alive = hypotheses(early, keys, REACH, best=True)
    last = early.agg(F.max("last")).first()[0] or 0
    low, high = 2 + REACH, (2 + REACH) * GROWTH
    if low <= last:
        alive = cut(alive)
    while low <= last:
        alive = survivors(alive, gaps, keys, low, high)
        low, high = high, high * GROWTH
        if low <= last:
            alive = cut(alive)
            if alive.isEmpty():
                break
    found = alive.groupBy(*keys).agg(F.max("n").alias("_n"))
    sure = F.least(F.col("sure"), F.col("third") - F.col("p_lo"))
    return (null_safe_join(early.select(*keys, sure.alias("sure")), found, keys, "left")
            .select(*keys, F.greatest(F.col("_n"), F.col("sure"), F.lit(1).cast("bigint")).alias("interval")))


def choose_rate(frames: DataFrame, run: Run, templates: Sequence[Template] = ()) -> DataFrame:
    """Positions per frame of each run as a reduced fraction, and how it was found.

    One frame per position gives 1, a single frame its length; then a matching
    template, then the constant interval, then length over count.
    """
    keys = list(run.keys)
    frames = cut(frames)
    total = frames.groupBy(*keys).agg(F.min("start").alias("_s"), F.max("end").alias("_e"),
                                      F.count(F.lit(1)).alias("frames"))
    total = total.withColumn("length", F.col("_e") - F.col("_s") + 1)
    out = null_safe_join(total, infer_interval(frames, run), keys, "left")
    if templates:
        first = total.select(*keys, "_s")
        relative = null_safe_join(frames, first, keys).select(*keys, (F.col("start") - F.col("_s")).alias("start"),
                                                   (F.col("end") - F.col("_s")).alias("end"))
        out = null_safe_join(out, match_template(relative, templates, keys=keys)
                             .select(*keys, F.col("num").alias("_tn"), F.col("den").alias("_td")), keys, "left")
    else:
        out = out.withColumn("_tn", F.lit(None).cast("bigint")).withColumn("_td", F.lit(None).cast("bigint"))
    one = F.lit(1).cast("bigint")
    pick = lambda each, single, template, interval, average: (
        F.when(F.col("frames") == F.col("length"), each).when(F.col("frames") == 1, single)
        .when(F.col("_tn").isNotNull(), template).when(F.col("interval") > 1, interval).otherwise(average))
    label = pick(*[F.lit(x) for x in ("each", "single", "template", "interval", "average")])
    num = pick(one, F.col("length"), F.col("_tn"), F.col("interval"), F.col("length"))
    den = pick(one, one, F.col("_td"), one, F.col("frames"))
    rate = rational(num, den)
    return (out.withColumn("method", label).withColumn("_r", rate)
            .select(*keys, "frames", "length", "method", F.col("_r.num").alias("num"), F.col("_r.den").alias("den")))
