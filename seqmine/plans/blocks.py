"""Window functions over runs of any length.

A plain ``Window.partitionBy(src)`` puts a whole run into one task, so one run
that holds a third of the data stalls the job.  Here a run is cut into *blocks*:
groups of neighbouring rows of bounded size.  Every function

1. evaluates ordinary windows inside ``(keys, block)``,
2. reduces each block to one summary row,
3. folds the summaries along the run (a window over blocks, not over rows),
4. joins the folded value back to the rows on ``(keys, block)``.

The first block column is a struct of the keys and a number.  It is never null, so rows whose keys are null meet the
summary of their block like all others, by a plain equality that keeps the partitioning.

The rows are shuffled once, on ``(keys, block)``; steps 2 and 4 keep that
partitioning.  A run of n rows in blocks of b rows needs only n/b summary rows in
one task.  Block columns must never decrease along the order of the run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seqmine.session import cut

BLOCK_WIDTH = 1 << 20
SIZING_SAMPLE = 1024
#: Rows of a block whose size is counted in rows.
BLOCK_ROWS = 1 << 19
#: Rows that a task of a shuffle gets where their number is known beforehand.
TASK_ROWS = 1 << 19

Getter = Callable[[str], Column]
Condition = Callable[[Getter, Getter], Column]


@dataclass(frozen=True)
class Run:
    """How rows form runs: partition keys, total order inside a run, block columns."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    block: tuple[str, ...] = ("blk",)

    @property
    def cell(self) -> list[str]:
        """Columns that name a block; the keys are fields of the first."""
        return list(self.block)

    def held(self) -> list[Column]:
        """The keys as the block column holds them."""
        return [F.col(self.block[0])[k].alias(k) for k in self.keys]

    def rows(self, reverse: bool = False) -> WindowSpec:
        order = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.cell).orderBy(*order)

    def blocks(self, reverse: bool = False) -> WindowSpec:
        order = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.block]
        return Window.partitionBy(*[F.col(self.block[0])[k] for k in self.keys]).orderBy(*order)

    def place(self) -> Column:
        """The order columns as one comparable value."""
        if len(self.order) == 1:
            return F.col(self.order[0])
        return F.struct(*[F.col(c) for c in self.order])


def block_of(keys: Sequence[str], number: Column) -> Column:
    """The value of a block column: the keys, which may be null, and the number of the block."""
    return F.struct(*[F.col(k) for k in keys], number.alias("_no"))


def rekeyed(df: DataFrame, run: Run, keys: Sequence[str]) -> tuple[DataFrame, Run]:
    """The same blocks for other keys."""
    first = run.block[0]
    return df.withColumn(first, block_of(keys, F.col(first)["_no"])), Run(tuple(keys), run.order, run.block)


def by_position(df: DataFrame, keys: Sequence[str], pos: str = "pos",
                width: int = BLOCK_WIDTH) -> tuple[DataFrame, Run]:
    """Blocks of ``width`` positions; a block holds at most ``width`` distinct positions.

    Keys may be null and then form a run of their own.  A null position has no place in a run and stops the query.
    """
    refused = F.raise_error(F.lit(f"null position in column {pos}")).cast("bigint")
    number = F.coalesce(F.floor(F.col(pos) / F.lit(width)), refused)
    return df.withColumn("blk", block_of(keys, number)), Run(tuple(keys), (pos,))


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal columns, where null equals null; the columns of ``left`` stay."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in right.columns if c not in on])
    match = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(other, match, how).drop(*[f"_r_{c}" for c in on])


def spread(df: DataFrame, rows: int | None, *on: str | Column) -> DataFrame:
    """Deals ``df`` by ``on`` into so many tasks that each gets about ``TASK_ROWS`` of ``rows`` rows.

    Sorts and tables of a task then stay of one size whatever the input's.  Where Spark's own number of tasks is enough, or ``rows`` is
    not known, nothing is dealt.  Tables that are dealt by equal values for an equal number of rows meet in a join without another shuffle.
    """
    tasks = -(-(rows or 0) // TASK_ROWS)
    if tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(tasks, *on)


def upto(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def running(df: DataFrame, run: Run, *, sums: dict[str, Column] | None = None,
            maxes: dict[str, Column] | None = None, mins: dict[str, Column] | None = None,
            lasts: dict[str, Column] | None = None, reverse: bool = False,
            exclusive: bool = False, size: int | None = None) -> DataFrame:
    """Running sum, max, min and last non-null value along each run.

    ``reverse`` walks the run backwards; ``exclusive`` leaves out the current row.
    The block summaries come straight from ``df`` with map-side aggregation.
    ``size``, about the number of rows, bounds what a task holds.
    """
    df = spread(df, size, *run.cell)
    sums, maxes, mins, lasts = sums or {}, maxes or {}, mins or {}, lasts or {}
    rows = run.rows(reverse)
    frame = before(rows) if exclusive else upto(rows)
    earlier = before(run.blocks(reverse))
    place = run.place()
    pick = F.min_by if reverse else F.max_by

    agg, fold, local, final = [], [], {}, {}
    for name, col in sums.items():
        agg.append(F.sum(col).alias(f"_b_{name}"))
        fold.append(F.sum(f"_b_{name}").over(earlier).alias(f"_c_{name}"))
        local[name] = F.sum(col).over(frame)
        final[name] = (F.coalesce(F.col(name), F.lit(0))
                       + F.coalesce(F.col(f"_c_{name}"), F.lit(0)))
    for name, col in maxes.items():
        agg.append(F.max(col).alias(f"_b_{name}"))
        fold.append(F.max(f"_b_{name}").over(earlier).alias(f"_c_{name}"))
        local[name] = F.max(col).over(frame)
        final[name] = F.greatest(F.col(name), F.col(f"_c_{name}"))
    for name, col in mins.items():
        agg.append(F.min(col).alias(f"_b_{name}"))
        fold.append(F.min(f"_b_{name}").over(earlier).alias(f"_c_{name}"))
        local[name] = F.min(col).over(frame)
        final[name] = F.least(F.col(name), F.col(f"_c_{name}"))
    for name, col in lasts.items():
        agg.append(pick(col, F.when(col.isNotNull(), place)).alias(f"_b_{name}"))
        fold.append(F.last(f"_b_{name}", ignorenulls=True).over(earlier).alias(f"_c_{name}"))
        local[name] = F.last(col, ignorenulls=True).over(frame)
        final[name] = F.coalesce(F.col(name), F.col(f"_c_{name}"))

    carry = spread(df.groupBy(*run.cell).agg(*agg), size, *[F.col(run.block[0])[k] for k in run.keys]).select(*run.cell, *fold)
    carry = spread(carry, size, *run.cell)
    joined = df.select("*", *[c.alias(n) for n, c in local.items()]).join(carry, run.cell)
    return joined.select(*df.columns, *[c.alias(n) for n, c in final.items()])


def dense_index(df: DataFrame, run: Run, name: str = "idx", start: int = 0) -> DataFrame:
    """Consecutive numbers along each run, from ``start``."""
    out = running(df, run, sums={name: F.lit(1).cast("bigint")})
    return out.withColumn(name, F.col(name) + F.lit(start - 1))


def run_totals(df: DataFrame, run: Run, *, mins: dict[str, Column] | None = None,
               maxes: dict[str, Column] | None = None) -> DataFrame:
    """Minimum and maximum over the whole run on every row.

    Only block summaries are gathered per run; rows keep their block partitioning.
    """
    mins, maxes = mins or {}, maxes or {}
    agg = ([F.min(c).alias(n) for n, c in mins.items()] + [F.max(c).alias(n) for n, c in maxes.items()])
    over = Window.partitionBy(*[F.col(run.block[0])[k] for k in run.keys])
    totals = df.groupBy(*run.cell).agg(*agg).select(
        *run.cell, *[F.min(n).over(over).alias(n) for n in mins], *[F.max(n).over(over).alias(n) for n in maxes])
    return df.join(totals, run.cell)


def shifted(df: DataFrame, run: Run, fields: Sequence[str], name: str = "prev",
            reverse: bool = False) -> DataFrame:
    """Struct of the previous row's ``fields`` (the next row's if ``reverse``)."""
    row = F.struct(*[F.col(c) for c in fields])
    pick = F.min_by if reverse else F.max_by
    carry = (df.groupBy(*run.cell).agg(pick(row, run.place()).alias("_edge"))
             .select(*run.cell, F.lag("_edge").over(run.blocks(reverse)).alias("_c_edge")))
    local = df.withColumn(name, F.lag(row).over(run.rows(reverse)))
    return (local.join(carry, run.cell)
            .withColumn(name, F.coalesce(F.col(name), F.col("_c_edge"))).drop("_c_edge"))


def _lagged(field: str) -> Column:
    return F.col(f"_p_{field}")


def _with_lags(df: DataFrame, run: Run, fields: Sequence[str]) -> DataFrame:
    """The previous row's fields inside the block, and whether rows come before and after."""
    rows = run.rows()
    return df.select("*", F.lag(F.lit(True), 1, False).over(rows).alias("_seen"),
                     F.lead(F.lit(True), 1, False).over(rows).alias("_more"),
                     *[F.lag(c).over(rows).alias(f"_p_{c}") for c in fields])


def last_where(df: DataFrame, run: Run, fields: Sequence[str],
               marks: dict[str, tuple[Condition, bool | Callable[[Getter], Column]]],
               carry_fields: Sequence[str] = (), index: str | None = None,
               keep_prev: bool = False) -> DataFrame:
    """For each mark, the place of the latest row (this one included) where it held.

    A mark is ``(condition, at_start)``: the condition compares the previous row with
    the current one through getters over ``fields``; ``at_start`` decides for the
    first row of a run.  This is the common form of all segmentation: the place of
    the latest break names the segment.  ``carry_fields`` of the marked row come along as
    ``<mark>_<field>``.  ``index`` adds the row's number in its run, from 0, and that of
    the marked row as ``<mark>_<index>``.
    """
    fields = list(dict.fromkeys([*fields, *carry_fields]))
    place = run.place()

    local = _with_lags(df, run, fields)
    if index:
        local = local.withColumn("_k", F.row_number().over(run.rows()).cast("bigint") - 1)
    packed = bool(index or carry_fields)
    here = place
    if packed:
        here = F.struct(place.alias("p"), *([F.col("_k").alias("k")] if index else []),
                        *[F.col(c).alias(c) for c in carry_fields])
    hits = {n: F.col("_seen") & F.coalesce(cond(_lagged, F.col), F.lit(False)) for n, (cond, _) in marks.items()}
    local = local.select("*", *[F.max(F.when(hit, here)).over(upto(run.rows())).alias(n)
                                for n, hit in hits.items()])

    def moved(col: Column, offset: Column) -> Column:
        """A mark of one block with its row number counted from the start of the run."""
        if not index:
            return col
        return F.when(col.isNotNull(), F.struct(col["p"].alias("p"), (col["k"] + offset).alias("k"),
                                                *[col[c].alias(c) for c in carry_fields]))

    head: Getter = lambda c: F.col("_head")[c]
    tail: Getter = lambda c: F.col("_tail")[c]
    blocks = run.blocks()
    row = F.struct(*[F.col(c) for c in fields])
    carry = (local.groupBy(*run.cell)
             .agg(F.max(F.when(~F.col("_seen"), row)).alias("_head"),
                  F.max(F.when(~F.col("_more"), row)).alias("_edge"),
                  F.min(here).alias("_place"), F.count(F.lit(1)).alias("_size"),
                  *[F.max(name).alias(f"_l_{name}") for name in marks])
             .withColumn("_tail", F.lag("_edge").over(blocks))
             .withColumn("_off", F.coalesce(F.sum("_size").over(before(blocks)), F.lit(0))))
    offset = F.col("_off")
    for name, (cond, at_start) in marks.items():
        opening = at_start(head) if callable(at_start) else F.lit(at_start)
        hit = (F.when(F.col("_tail").isNull(), opening)
               .otherwise(F.coalesce(cond(tail, head), F.lit(False))))
        carry = (carry.withColumn(f"_h_{name}", F.when(hit, moved(F.col("_place"), offset)))
                 .withColumn(f"_l_{name}", moved(F.col(f"_l_{name}"), offset)))
    carry = carry.select(
        *run.cell, "_tail", "_off",
        *[F.coalesce(F.col(f"_h_{name}"),
                     F.last(F.coalesce(f"_l_{name}", f"_h_{name}"), ignorenulls=True)
                     .over(before(blocks))).alias(f"_c_{name}") for name in marks])

    out = [(F.col("_k") + offset).alias(index)] if index else []
    for n in marks:
        latest = F.coalesce(moved(F.col(n), offset), F.col(f"_c_{n}"))
        out.append((latest["p"] if packed else latest).alias(n))
        out += [latest[c].alias(f"{n}_{c}") for c in carry_fields]
        if index:
            out.append(latest["k"].alias(f"{n}_{index}"))
    if keep_prev:
        before_here = F.when(F.col("_seen"), F.struct(*[_lagged(c).alias(c) for c in fields]))
        out.append(F.coalesce(before_here, F.col("_tail")).alias("prev"))
    return local.join(carry, run.cell).select(*df.columns, *out)


def segment(df: DataFrame, run: Run, fields: Sequence[str], breaks: Condition,
            name: str = "seg") -> DataFrame:
    """Adds ``name``: the place of the first row of the row's segment."""
    return last_where(df, run, fields, {name: (breaks, True)})


def segment_groups(df: DataFrame, run: Run, fields: Sequence[str], breaks: Condition,
                   sums: dict[str, Column] | None = None, mins: dict[str, Column] | None = None,
                   maxes: dict[str, Column] | None = None, late: Column | None = None) -> DataFrame:
    """One row per segment with its sums, minima and maxima, and ``seg``, its first place.

    With a mark ``late`` a segment gives up to two rows: its rows before the first marked one, and those from there on (column ``late``).

    Rows are read, shuffled and sorted once: each block is reduced to its parts of
    segments, and only its first and last part can belong to a longer segment.  The
    parts are written to the shared folder; those at block edges are linked along the
    run and merged, all others are complete and are neither shuffled nor joined again.
    """
    sums, mins, maxes = sums or {}, mins or {}, maxes or {}
    fields = list(dict.fromkeys(fields))
    place = run.place()
    local = _with_lags(df, run, fields)
    hit = F.col("_seen") & F.coalesce(breaks(_lagged, F.col), F.lit(False))
    local = local.withColumn("_cut", F.max(F.when(hit, place)).over(upto(run.rows())))
    # First and last row of the block field by field: plain maxima keep this a hash aggregation.
    split = []
    if late is not None:
        local = local.withColumn("_mark", F.when(late, place))
        marked = F.max("_mark").over(upto(run.rows()))
        local = local.withColumn("_late", marked.isNotNull() & F.coalesce(marked >= F.col("_cut"), F.lit(True)))
        split = ["_late"]
    parts = local.groupBy(*run.cell, "_cut", *split).agg(
        *([F.max("_mark").alias("_mark")] if split else []), F.min(place).alias("_from"), F.max(~F.col("_more")).alias("_at_end"),
        *[F.max(F.when(~F.col("_seen"), F.col(c))).alias(f"_h_{c}") for c in fields],
        *[F.max(F.when(~F.col("_more"), F.col(c))).alias(f"_t_{c}") for c in fields],
        *[F.sum(c).alias(n) for n, c in sums.items()], *[F.min(c).alias(n) for n, c in mins.items()],
        *[F.max(c).alias(n) for n, c in maxes.items()])
    parts = cut(parts)

    blocks = run.blocks()
    head: Getter = lambda c: F.col(f"_h_{c}")
    tail: Getter = lambda c: F.col("_tail")[c]
    edge = F.col("_cut").isNull() | F.col("_at_end")
    values = [*sums, *mins, *maxes]
    named = [F.col("_late").alias("late")] if split else []
    inner = parts.where(~edge).select(*run.held(), F.col("_cut").alias("seg"), *named, *values)
    edges = parts.where(edge)
    links = (edges.groupBy(*run.cell)
             .agg(*[F.max(f"_h_{c}").alias(f"_h_{c}") for c in fields],
                  *[F.max(f"_t_{c}").alias(f"_t_{c}") for c in fields],
                  F.min("_from").alias("_from"), F.max("_cut").alias("_cut"), *([F.max("_mark").alias("_mark")] if split else []))
             .withColumn("_tail", F.lag(F.struct(*[F.col(f"_t_{c}").alias(c) for c in fields])).over(blocks)))
    opens = F.when(F.col("_tail").isNull() | F.coalesce(breaks(tail, head), F.lit(False)), F.col("_from"))
    links = (links.withColumn("_opens", opens)
             .withColumn("_root", F.coalesce("_opens", F.last(F.coalesce("_cut", "_opens"), ignorenulls=True)
                                             .over(before(blocks)))))
    if split:
        # A segment that came into the block with a mark behind it stays late.
        links = links.withColumn("_was", F.coalesce(F.max("_mark").over(before(blocks)) >= F.col("_root"), F.lit(False)))
        named = [(F.col("_late") | (F.col("_cut").isNull() & F.col("_was"))).alias("late")]
    links = links.select(*run.cell, "_root", *(["_was"] if split else []))
    merged = (edges.join(links, run.cell)
              .select(*run.held(), F.coalesce("_cut", "_root").alias("seg"), *named, *values)
              .groupBy(*run.keys, "seg", *(["late"] if split else []))
              .agg(*[F.sum(n).alias(n) for n in sums], *[F.min(n).alias(n) for n in mins],
                   *[F.max(n).alias(n) for n in maxes]))
    return merged.unionByName(inner)


def stream_offsets(df: DataFrame, run: Run, length: Column, pos: str = "pos") -> DataFrame:
    """Adds ``seg``, the first position of the row's island, and ``at``, the row's offset in the island's stream.

    An island is a stretch of rows at consecutive positions; its stream is what ``length`` measures, laid end to end.
    """
    rows, blocks = run.rows(), run.blocks()
    local = (df.withColumn("_n", length.cast("bigint")).withColumn("_p", F.lag(pos).over(rows))
             .withColumn("_s", F.coalesce(F.sum("_n").over(before(rows)), F.lit(0))))
    root = lambda p, o: F.struct(p.cast("bigint").alias("p"), o.cast("bigint").alias("o"))
    gap = F.col("_p").isNotNull() & (F.col(pos) != F.col("_p") + 1)
    local = local.withColumn("_cut", F.max(F.when(gap, root(F.col(pos), F.col("_s")))).over(upto(rows)))
    carry = (local.groupBy(*run.cell)
             .agg(F.sum("_n").alias("_total"), F.min(pos).alias("_first"), F.max(pos).alias("_last"), F.max("_cut").alias("_inner"))
             .withColumn("_tail", F.lag("_last").over(blocks))
             .withColumn("_off", F.coalesce(F.sum("_total").over(before(blocks)), F.lit(0))))
    opens = F.col("_tail").isNull() | (F.col("_first") != F.col("_tail") + 1)
    moved = lambda c: F.when(F.col(c).isNotNull(), root(F.col(c)["p"], F.col(c)["o"] + F.col("_off")))
    carry = (carry.withColumn("_opens", F.when(opens, root(F.col("_first"), F.col("_off"))))
             .select(*run.cell, "_off", F.coalesce("_opens", F.last(F.coalesce(moved("_inner"), F.col("_opens")), ignorenulls=True)
                                                   .over(before(blocks))).alias("_root")))
    here = F.coalesce(moved("_cut"), F.col("_root"))
    return local.join(carry, run.cell).withColumn("_here", here).select(
        *df.columns, F.col("_here.p").alias("seg"), (F.col("_off") + F.col("_s") - F.col("_here.o")).alias("at"))


def catch_up(df: DataFrame, run: Run, target: Column, length: Column,
             name: str = "filler") -> DataFrame:
    """Units to insert before each row so that the total reaches ``target``.

    Inserting ``max(0, target - written)`` and then writing ``length`` units is
    max-plus algebra: with ``M = max(0, running max(target - sum of earlier lengths))``
    the filler is ``M - previous M``.  Both parts fold over blocks.
    """
    rows = run.rows()
    local = (df.withColumn("_t", target).withColumn("_n", length)
             .withColumn("_s", F.coalesce(F.sum("_n").over(before(rows)), F.lit(0)))
             .withColumn("_d", F.col("_t") - F.col("_s"))
             .withColumn("_m", F.max("_d").over(upto(rows)))
             .withColumn("_p", F.max("_d").over(before(rows))))
    earlier = before(run.blocks())
    carry = (local.groupBy(*run.cell).agg(F.sum("_n").alias("_bn"), F.max("_d").alias("_bd"))
             .withColumn("_cs", F.coalesce(F.sum("_bn").over(earlier), F.lit(0)))
             .withColumn("_cm", F.max(F.col("_bd") - F.col("_cs")).over(earlier))
             .select(*run.cell, "_cs", "_cm"))
    zero = F.lit(0).cast("bigint")
    now = F.greatest(zero, F.col("_m") - F.col("_cs"), F.col("_cm"))
    last = F.greatest(zero, F.col("_p") - F.col("_cs"), F.col("_cm"))
    written = F.col("_cs") + F.col("_s") + last
    return (local.join(carry, run.cell)
            .select(*df.columns, (now - last).alias(name), written.alias("written")))


def by_density(df: DataFrame, keys: Sequence[str], coarse: str, fine: str,
               rows: int = BLOCK_WIDTH) -> tuple[DataFrame, tuple[str, str]]:
    """Blocks of about ``rows`` rows for runs without dense positions.

    ``coarse`` and ``fine`` are integer columns that lead the order of the run.  A count
    over a sample finds the fullest ``(keys, coarse)`` value; blocks span several
    coarse values where data is thin and parts of one, cut by ``fine``, where it is
    thick.  The estimate sets only the block size, any size gives the same result.
    Returns the frame and the names of its block columns.
    """
    share = min(1.0, SIZING_SAMPLE / rows)
    full = (df.sample(share, seed=1).groupBy(*keys, coarse)
            .agg(F.count(F.lit(1)).alias("n"), (F.max(fine) - F.min(fine) + 1).alias("w"))
            .agg(F.max("n").alias("n"), F.max_by("w", "n").alias("w")).first())
    most, spread = max(1, round((full["n"] or 1) / share)), full["w"] or 1
    span = max(1, rows // most)
    part = max(1, spread * rows // most) if most > rows else None
    sub = F.floor(F.col(fine) / F.lit(part)) if part else F.lit(0).cast("bigint")
    return (df.withColumn("blk", block_of(keys, F.floor(F.col(coarse) / F.lit(span)))).withColumn("sub", sub),
            ("blk", "sub"))


def by_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = BLOCK_ROWS) -> tuple[DataFrame, Run]:
    """Blocks of about ``rows`` rows, whatever values the order has.

    Rows are dealt into ranges of ``(keys, order)``, so a run with many rows at few positions is cut by the rest of its order.  The
    ranges come from a sample, so the table is written before they are used, and a range stays below about twice ``rows``.  A table of
    no more than ``rows`` rows is one block per run and is not written again.  Rows that agree in keys and order stay together.
    """
    held = cut(df)
    ranges = -(-held.count() // rows)
    if ranges > 1:
        held = cut(held.repartitionByRange(ranges, *keys, *order).withColumn("_no", F.spark_partition_id().cast("bigint")))
    else:
        held = held.withColumn("_no", F.lit(0).cast("bigint"))
    return held.withColumn("blk", block_of(keys, F.col("_no"))).drop("_no"), Run(tuple(keys), tuple(order))
