"""Segmentation of ordered, interleaved runs.

Each operator turns its break rule into window expressions, so a run is processed
in parallel blocks (see ``seqmine.plans.blocks``) and no row passes through Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqmine.plans.blocks import (BLOCK_WIDTH, Condition, Run, before, block_of, by_position, last_where,
                                  run_totals, running, segment, segment_groups, upto)
from seqmine.session import cut

CHUNK_REACH = 50
GROUP_GAP = 100
NUMBER_JUMP = 1000
#: Numbers of a group that fit the bits of a BIGINT.
WORD = 62


def _count() -> Column:
    return F.count(F.lit(1))


def assemble_groups(df: DataFrame, run: Run, *, frame: str = "frame", chunk: str = "chunk",
                    expected: str = "expected", pos: str = "pos", same: Sequence[str] = (),
                    reach: int = CHUNK_REACH) -> DataFrame:
    """Chunks to frames: one row per frame with its extent and chunk statistics."""
    fields = list(dict.fromkeys([frame, chunk, expected, pos, *same]))

    def breaks(prev, cur):
        out = ((cur(frame) != prev(frame)) | (cur(expected) != prev(expected))
               | (cur(chunk) <= prev(chunk)) | (cur(pos) - prev(pos) >= reach)
               | (cur(chunk) >= cur(expected)) | (prev(chunk) >= prev(expected) - 1))
        for c in same:
            out = out | ~cur(c).eqNullSafe(prev(c))
        return out

    out = segment_groups(
        df, run, fields, breaks, sums={"chunks": F.lit(1).cast("bigint")},
        mins={"start": F.col(pos), frame: F.col(frame), expected: F.col(expected),
              "first_chunk": F.col(chunk), **{c: F.col(c) for c in same}},
        maxes={"end": F.col(pos), "last_chunk": F.col(chunk)})
    return out.withColumn("corrupt", F.col("first_chunk") >= F.col(expected)).drop("seg")


def segment_constant_stride(df: DataFrame, *, keys: Sequence[str] = ("src", "channel"),
                            pos: str = "pos", stream: str = "stream", end_mark: str = "end_mark",
                            fmt: str = "fmt", silent: str = "silent",
                            legal: Sequence[int] = tuple(range(1, 9)),
                            width: int = BLOCK_WIDTH) -> DataFrame:
    """Streams of equally spaced records per key; one row per stream.

    A stream breaks on a format change, an illegal stride, a stride other than its
    own, and after an end mark on any record of the same keys.  ``stream`` and
    ``end_mark`` are booleans; a row may be both.  A lone silent record is dropped.

    A record further than the largest legal stride always breaks, so copying the
    last ``2 * max(legal)`` positions of each block into the next one is enough to
    judge every record locally.  The stride rule itself depends on whether the
    previous record broke; rows where that is certain are anchors, and between
    anchors the answer alternates, so a block needs one incoming bit.  Both
    possible outcomes are prepared and the bit folded over block summaries.
    """
    keys = list(keys)
    reach = 2 * max(legal)
    width = max(width, 2 * reach)
    home = F.floor(F.col(pos) / F.lit(width))
    near_end = F.pmod(F.col(pos), F.lit(width)) >= width - reach
    rows = (df.where(F.col(stream) | F.col(end_mark)).withColumn("_home", home)
            .withColumn("blk", F.explode(F.when(near_end, F.array(F.col("_home"), F.col("_home") + 1))
                                         .otherwise(F.array(F.col("_home")))))
            .withColumn("blk", block_of(keys, F.col("blk"))))
    run = Run(tuple(keys), (pos,))
    w = run.rows()
    sofar = before(w)
    rows = rows.select(
        *keys, pos, "blk", (F.col("_home") == F.col("blk._no")).alias("_core"), stream, fmt, silent,
        F.last(F.when(F.col(stream), F.col(pos)), ignorenulls=True).over(sofar).alias("_ppos"),
        F.last(F.when(F.col(stream), F.col(fmt)), ignorenulls=True).over(sofar).alias("_pfmt"),
        F.last(F.when(F.col(end_mark), F.col(pos)), ignorenulls=True).over(sofar).alias("_mark"))
    gap = F.col(pos) - F.col("_ppos")
    hard = (F.col("_ppos").isNull() | ~F.col(fmt).eqNullSafe(F.col("_pfmt"))
            | ~gap.isin(list(legal)) | F.coalesce(F.col("_mark") >= F.col("_ppos"), F.lit(False)))
    rows = (rows.where(F.col(stream)).withColumn("_gap", gap).withColumn("_hard", hard)
            .withColumn("_phard", F.lag("_hard").over(w))
            .withColumn("_pgap", F.lag("_gap").over(w))
            .where("_core"))
    anchor = (F.when(F.col("_hard"), F.lit(1))
              .when(F.col("_phard") | (F.col("_gap") == F.col("_pgap")), F.lit(0)))
    rows = (rows.withColumn("_n", F.row_number().over(w)).withColumn("_a", anchor)
            .withColumn("_an", F.last(F.when(F.col("_a").isNotNull(), F.col("_n")), ignorenulls=True)
                        .over(upto(w)))
            .withColumn("_av", F.last("_a", ignorenulls=True).over(upto(w))))
    known = (F.col("_av") + F.col("_n") - F.col("_an")) % 2
    for bit in (0, 1):
        brk = F.coalesce(known, (F.lit(bit) + F.col("_n")) % 2) == 1
        rows = rows.withColumn(f"_s{bit}", F.max(F.when(brk, F.col(pos))).over(upto(w)))

    rows = rows.withColumn("_more", F.lead(F.lit(True), 1, False).over(w))
    # Rows of a block with the same pair of possible starts form one part of a stream.
    after = lambda bit: F.max(F.when(~F.col(pos).eqNullSafe(F.col(f"_s{bit}")), F.col("_gap")))
    parts = cut(rows.groupBy(*run.cell, "_s0", "_s1").agg(
        F.max(pos).alias("end"), _count().alias("records"), F.min(fmt).alias(fmt),
        F.sum(F.when(F.col(silent), 0).otherwise(1)).alias("sounding"),
        after(0).alias("_g0"), after(1).alias("_g1"),
        F.max("_n").alias("_n"), F.max("_an").alias("_an"), F.max_by("_av", "_n").alias("_av"),
        F.max(~F.col("_more")).alias("_at_end")))
    # Parts with one certain start that end before the block does are complete.
    edge = ~F.coalesce(F.col("_s0") == F.col("_s1"), F.lit(False)) | F.col("_at_end")
    inner = parts.where(~edge).select(*run.held(), F.col("_s0").alias("start"), "end", "records",
                                      F.col("_g0").alias("stride"), fmt, "sounding")
    parts = parts.where(edge)

    blocks = run.blocks()
    earlier = before(blocks)
    carry = (parts.groupBy(*run.cell)
             .agg(F.max("_n").alias("_cnt"), F.max("_an").alias("_an"),
                  F.max_by("_av", "_n").alias("_av"),
                  F.max("_s0").alias("_s0"), F.max("_s1").alias("_s1"))
             .withColumn("_end", (F.col("_av") + F.col("_cnt") - F.col("_an")) % 2)
             .withColumn("_total", F.sum("_cnt").over(upto(blocks)))
             .withColumn("_at", F.when(F.col("_end").isNotNull(), F.struct("_total", "_end"))))
    carry = carry.withColumn("_from", F.last("_at", ignorenulls=True).over(earlier))
    carry = carry.withColumn("_bit", F.coalesce(
        (F.col("_from._end") + F.col("_total") - F.col("_cnt") - F.col("_from._total")) % 2, F.lit(0)))
    chosen = lambda c: F.when(F.col("_bit") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    carry = (carry.withColumn("_start", F.last(chosen("_s"), ignorenulls=True).over(earlier))
             .select(*run.cell, "_bit", "_start"))
    merged = (parts.join(carry, run.cell)
              .select("*", *run.held(), F.coalesce(chosen("_s"), F.col("_start")).alias("start"), chosen("_g").alias("_gap"))
              .groupBy(*keys, "start")
              .agg(F.max("end").alias("end"), F.sum("records").alias("records"), F.max("_gap").alias("stride"),
                   F.min(fmt).alias(fmt), F.sum("sounding").alias("sounding")))
    return merged.unionByName(inner).where((F.col("records") > 1) | (F.col("sounding") > 0))


def stitch_groups(frames: DataFrame, run: Run, *, start: str = "start", end: str = "end",
                  number: str = "frame", special: str = "special", same: Sequence[str] = (),
                  gap: int = GROUP_GAP, jump: int = NUMBER_JUMP) -> DataFrame:
    """Frames to videos, including the sticky rule for a special first frame; a null ``special`` is an ordinary frame.

    A video that begins with special frames ends before its first ordinary one, and the next begins there.  Both parts are
    summed up in the pass that finds the segments.
    """
    fields = list(dict.fromkeys([start, end, number, *same]))

    def hard(prev, cur):
        out = ((cur(start) > prev(end) + gap) | (cur(number) < prev(number))
               | (cur(number) > prev(number) + jump))
        for c in same:
            out = out | ~cur(c).eqNullSafe(prev(c))
        return out

    out = segment_groups(
        frames, run, fields, hard, sums={"frames": F.lit(1).cast("bigint")},
        mins={"start": F.col(start), "first_number": F.col(number), **{c: F.col(c) for c in same}},
        maxes={"end": F.col(end), "last_number": F.col(number)}, late=~F.coalesce(F.col(special), F.lit(False)))
    return out.select(*run.keys, "start", "end", "first_number", "last_number", "frames", *same)


def stitch_countdown(frames: DataFrame, run: Run, *, number: str = "number", start: str = "start",
                     end: str = "end", gap: int = GROUP_GAP, same: Sequence[str] = ()) -> DataFrame:
    """Frames whose numbers count down to the end of the video, per run keys.

    Adds ``seg`` and ``first_number``; ``renumbered = first_number - number``.
    """
    fields = list(dict.fromkeys([start, end, number, *same]))

    def breaks(prev, cur):
        out = (cur(number) > prev(number)) | (cur(start) > prev(end) + gap)
        for c in same:
            out = out | ~cur(c).eqNullSafe(prev(c))
        return out

    out = last_where(frames, run, fields, {"seg": (breaks, True)}, carry_fields=[number])
    out = out.withColumnRenamed(f"seg_{number}", "first_number")
    return out.withColumn("renumbered", F.col("first_number") - F.col(number))


def segment_by_gap(df: DataFrame, run: Run, *, pos: str = "pos", end: str | None = None,
                   gap: int = GROUP_GAP, same: Sequence[str] = (), name: str = "seg") -> DataFrame:
    """Breaks on a gap larger than ``gap`` or a change of the ``same`` attributes."""
    end = end or pos
    fields = list(dict.fromkeys([pos, end, *same]))

    def breaks(prev, cur):
        out = cur(pos) > prev(end) + gap
        for c in same:
            out = out | ~cur(c).eqNullSafe(prev(c))
        return out

    return segment(df, run, fields, breaks, name)


def segment_by_succession(df: DataFrame, run: Run, *, number: str = "number", pos: str = "pos",
                          wanted: str = "wanted", size: str = "size", start: int = 0) -> DataFrame:
    """Runs of consecutive numbers from ``start`` with payload of one constant size."""
    payload = F.when(F.col(wanted), F.col(size))
    out = segment_groups(
        df, run, [number], lambda prev, cur: cur(number) != prev(number) + 1,
        sums={"records": F.lit(1).cast("bigint"), "payloads": F.when(payload.isNotNull(), 1).otherwise(0)},
        mins={"start": F.col(pos), "first_number": F.col(number), "size": payload},
        maxes={"end": F.col(pos), "last_number": F.col(number), "_max": payload})
    return (out.where((F.col("first_number") == start) & (F.col("payloads") > 0)
                      & (F.col("size") == F.col("_max")))
            .drop("seg", "_max"))


def segment_by_marker(df: DataFrame, run: Run, *, marker: str = "marker", pos: str = "pos",
                      bad: Condition, fields: Sequence[str], payload: Column) -> DataFrame:
    """Segments opened by marker rows.

    Rows before the first marker are dropped.  A bad row (compared with the row
    before it) ends its segment, and the rest up to the next marker is dropped.
    Segments without payload are dropped.
    """
    fields = list(dict.fromkeys([*fields, marker]))
    marks = {"seg": (lambda prev, cur: cur(marker), lambda cur: cur(marker)),
             "_bad": (lambda prev, cur: ~cur(marker) & ~prev(marker) & bad(prev, cur), False)}
    rows = last_where(df, run, fields, marks)
    kept = rows.where(F.col("seg").isNotNull()
                      & F.coalesce(F.col("_bad") < F.col("seg"), F.lit(True)))
    return (kept.groupBy(*run.keys, "seg")
            .agg(F.min(pos).alias("start"), F.max(pos).alias("end"), _count().alias("records"),
                 F.sum(F.when(payload, 1).otherwise(0)).alias("payloads"))
            .where(F.col("payloads") > 0).drop("seg"))


def pair_adjacent(df: DataFrame, run: Run, *, side: str = "side", pos: str = "pos",
                  same: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Left rows joined to the right row at the next position; unmatched sides stay alone."""
    fields = list(dict.fromkeys([side, pos, *same]))

    def joined(prev, cur):
        out = ((prev(side) == "left") & (cur(side) == "right") & (cur(pos) == prev(pos) + 1))
        for c in same:
            out = out & cur(c).eqNullSafe(prev(c))
        return out

    pick = lambda s, c: F.when(F.col(side) == s, F.col(c))
    return segment_groups(
        df.where(F.col(side).isin("left", "right")), run, fields, lambda prev, cur: ~joined(prev, cur),
        maxes={"left_pos": pick("left", pos), "right_pos": pick("right", pos),
               "left_value": pick("left", value), "right_value": pick("right", value),
               **{c: F.col(c) for c in same}}).drop("seg")


def segment_increasing(df: DataFrame, run: Run, *, number: str = "number", rate: str = "rate",
                       start: str = "start", end: str = "end", units: str = "units") -> DataFrame:
    """Breaks on a rate change or a number that does not grow; totals and smallest gap."""
    def breaks(prev, cur):
        return ~cur(rate).eqNullSafe(prev(rate)) | (cur(number) <= prev(number))

    rows = last_where(df, run, [number, rate, start, end], {"seg": (breaks, True)}, keep_prev=True)
    gap = F.when(run.place() != F.col("seg"), F.col(start) - F.col(f"prev.{end}"))
    return (rows.groupBy(*run.keys, "seg")
            .agg(F.min(start).alias("start"), F.max(end).alias("end"), _count().alias("pairs"),
                 F.sum(units).alias("units"), F.min(rate).alias(rate),
                 F.coalesce(F.min(gap), F.lit(1)).cast("bigint").alias("min_gap"))
            .drop("seg"))


def islands(df: DataFrame, run: Run, claimed: str, pos: str = "pos") -> DataFrame:
    """Maximal runs of rows for which ``claimed`` is false."""
    out = segment_groups(df, run, [claimed], lambda prev, cur: prev(claimed) != cur(claimed),
                         sums={"records": F.lit(1).cast("bigint")}, mins={"start": F.col(pos)},
                         maxes={"end": F.col(pos), "_claimed": F.col(claimed)})
    return out.where(~F.col("_claimed")).drop("seg", "_claimed")


def validated_runs(df: DataFrame, *, keys: Sequence[str] = ("src",), pos: str = "pos",
                   valid: str = "valid", last: str = "last", zero: str = "zero",
                   min_len: int = 16, phases: int = 4, width: int = BLOCK_WIDTH) -> DataFrame:
    """Runs of valid units up to a terminator, one set of runs per phase.

    A run is kept if a terminator ends it, it has at least ``min_len`` units and not
    all of them are zero.  Units of one phase must follow at distance ``phases``.
    """
    rows = df.withColumn("phase", F.pmod(F.col(pos), F.lit(phases)))
    rows, run = by_position(rows, [*keys, "phase"], pos, width)

    def breaks(prev, cur):
        return (~prev(valid) | ~cur(valid) | prev(last) | (cur(pos) != prev(pos) + phases))

    out = segment_groups(rows, run, [valid, last, pos], breaks,
                         sums={"units": F.lit(1).cast("bigint")},
                         mins={"start": F.col(pos), "_zero": F.col(zero), "_valid": F.col(valid)},
                         maxes={"end": F.col(pos), "_ended": F.col(last)})
    return (out.where(F.col("_valid") & F.col("_ended") & ~F.col("_zero") & (F.col("units") >= min_len))
            .drop("seg", "_zero", "_valid", "_ended"))


def missing_members(df: DataFrame, group: Sequence[str], *, chunk: str = "chunk",
                    expected: str = "expected") -> DataFrame:
    """Chunk numbers absent from ``0..expected-1``, one row per missing number.

    Only numbers below ``expected`` are kept while counting, so a group's set is no
    larger than the group should be, however many rows repeat its numbers.  Where no group expects more than ``WORD`` numbers its set is
    the bits of one number.
    """
    inside = F.col(chunk).between(F.lit(0), F.col(expected) - 1)
    if df.where(F.col(expected) > WORD).isEmpty():
        return _missing_bits(df, group, chunk, expected, inside)
    seen = df.groupBy(*group).agg(
        F.collect_set(F.when(inside, F.col(chunk).cast("bigint"))).alias("_have"),
        F.max(expected).cast("bigint").alias("_n"))
    wanted = F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)
    return (seen.where("_n > 0")
            .select(*group, F.explode(F.array_except(wanted, F.col("_have"))).alias("missing")))


def _missing_bits(df: DataFrame, group: Sequence[str], chunk: str, expected: str, inside: Column) -> DataFrame:
    """The same for groups of at most ``WORD`` numbers."""
    rows = df.select(*group, F.col(expected).cast("bigint").alias("_n"), F.when(inside, F.col(chunk).cast("int")).alias("_c"))
    seen = rows.groupBy(*group).agg(F.bit_or(F.expr("shiftleft(1L, _c)")).alias("_have"), F.max("_n").alias("_n"))
    return (seen.where("_n > 0").select(*group, F.coalesce("_have", F.lit(0).cast("bigint")).alias("_have"), F.explode(F.expr("sequence(0L, _n - 1)")).alias("missing"))
            .where("shiftright(_have, cast(missing AS int)) & 1L = 0").drop("_have"))


def piece_offsets(pieces: DataFrame, run: Run, *, length: Column) -> DataFrame:
    """Offset of each piece inside the payload of its group, after trims."""
    return running(pieces, run, sums={"offset": length.cast("bigint")}, exclusive=True)


def concat_payload(pieces: DataFrame, run: Run, *, payload: str = "payload", pos: str = "pos",
                   first_trim: Column | int = 0, last_trim: Column | int = 0,
                   part_size: int = 1 << 24) -> DataFrame:
    """Payload of each group in order, as parts of about ``part_size`` characters, or bytes if it is binary.

    ``first_trim`` is cut from the front of a group's first piece and ``last_trim``
    from the back of its last one.  A group within the bound is one part; a larger
    one continues in further parts, so no cell or task holds an unbounded group.
    """
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    front = F.when(F.col(pos) == F.col("_lo"), as_col(first_trim)).otherwise(0)
    back = F.when(F.col(pos) == F.col("_hi"), as_col(last_trim)).otherwise(0)
    size = F.length(payload)
    trimmed = (run_totals(pieces, run, mins={"_lo": F.col(pos)}, maxes={"_hi": F.col(pos)})
               .withColumn("_legal", (front >= 0) & (back >= 0) & (front + back <= size))
               .withColumn(payload, F.substring(F.col(payload), front + 1,
                                                F.greatest(size - front - back, F.lit(0)))))
    placed = piece_offsets(trimmed, run, length=F.length(payload))
    binary = pieces.schema[payload].dataType.simpleString() == "binary"
    texts = F.transform(F.array_sort(F.collect_list(F.col("_piece"))), lambda x: F.hex(x["t"]) if binary else x["t"])
    joined = F.unhex(F.array_join(texts, "")) if binary else F.array_join(texts, "")
    # Empty pieces take no room, so a part could hold any number of them.
    piece = F.when(F.length(payload) > 0, F.struct(F.col(pos).alias("p"), F.col(payload).alias("t")))
    return (placed.withColumn("part", F.floor(F.col("offset") / part_size)).withColumn("_piece", piece)
            .groupBy(*run.keys, "part")
            .agg(F.min(pos).alias("start"), F.max(pos).alias("end"),
                 F.sum(F.length(payload)).cast("bigint").alias("size"),
                 F.bool_and("_legal").alias("legal"),
                 joined.alias(payload)))


def locate_offset(pieces: DataFrame, queries: DataFrame, keys: Sequence[str], *, length: str = "len",
                  pos: str = "pos", at: str = "at", width: int = BLOCK_WIDTH) -> DataFrame:
    """Payload offset to source record and the offset there.

    Pieces and queries are put on one line of offsets and each query takes the
    latest piece before it, so no pair of piece and query is formed.
    """
    keys = list(keys)
    cells, run = by_position(pieces, keys, pos, width)
    placed = piece_offsets(cells.where(F.col(length) > 0), run, length=F.col(length))
    # One piece per offset: empty pieces own no offset.
    line = (placed.select(*keys, F.col("offset").alias("_at"), F.lit(0).alias("_kind"),
                          F.struct(F.col(pos).alias("pos"), F.col("offset").alias("offset"),
                                   F.col(length).alias("len")).alias("_piece"))
            .unionByName(queries.select(*keys, F.col(at).alias("_at")).distinct()
                         .withColumn("_kind", F.lit(1)), allowMissingColumns=True))
    cells, _ = by_position(line, keys, "_at", width)
    found = running(cells, Run(tuple(keys), ("_at", "_kind")), lasts={"_hit": F.col("_piece")})
    inside = F.col("_at") < F.col("_hit.offset") + F.col("_hit.len")
    return (found.where((F.col("_kind") == 1) & inside)
            .select(*keys, F.col("_at").alias(at), F.col("_hit.pos").alias("pos"),
                    (F.col("_at") - F.col("_hit.offset")).alias("inner")))


def summarise_segments(df: DataFrame, group: Sequence[str], *, pos: str = "pos", end: str | None = None,
                       number: str | None = None, total: str | None = None) -> DataFrame:
    """Start, end, length and count per segment, with map-side aggregation.

    ``end`` names the end of a row that spans positions and adds ``first_offset``, from
    the start of the segment to the end of its first row; ``number`` and ``total``
    add the number range and a sum.
    """
    last = end or pos
    aggs = [F.min(pos).alias("start"), F.max(last).alias("end"), _count().alias("records")]
    if end:
        aggs.append((F.min_by(last, pos) - F.min(pos)).alias("first_offset"))
    if number:
        aggs += [F.min(number).alias("first_number"), F.max(number).alias("last_number")]
    if total:
        aggs.append(F.sum(total).alias("total"))
    out = df.groupBy(*group).agg(*aggs)
    return out.withColumn("length", F.col("end") - F.col("start") + 1)


def claim_lookahead(df: DataFrame, run: Run, *, first: str, member: str, last: str, pos: str = "pos", limit: int = 15,
                    number: str | None = None, least: int = 1) -> DataFrame:
    """Rows claimed by a start record whose group is complete within reach.

    A candidate opened by ``first`` ends at the first ``last`` member within ``limit`` records and before the next
    ``first``.  Rows that are neither are skipped.  With ``number``, it is complete if its rows' numbers go on by one without a
    hole; it needs ``least`` rows in any case.  All rows of a complete group are claimed, none of another.
    ``pos`` must count the records of the run.
    """
    rows = running(df, run, lasts={"_open": F.when(F.col(first), F.col(pos))})
    # Only rows within reach of their start remain, so a window holds at most limit + 1 rows.
    near = rows.where((F.col(pos) - F.col("_open") <= limit)
                      & (F.col(first) | F.col(member) | F.col(last)))
    group = Window.partitionBy(*run.keys, "_open")
    stop = F.min(F.when(F.col(last) & ~F.col(first), F.col(pos))).over(group)
    claimed = near.withColumn("_stop", stop).where(F.col(pos) <= F.col("_stop"))
    if number or least > 1:
        hole = F.lit(False)
        if number:
            before_here = F.lag(number).over(group.orderBy(pos))
            hole = (F.col(pos) != F.col("_open")) & ~F.col(number).eqNullSafe(before_here + 1)
        claimed = (claimed.withColumn("_hole", hole)
                   .withColumn("_whole", ~F.max("_hole").over(group) & (_count().over(group) >= least))
                   .where("_whole").drop("_hole", "_whole"))
    return claimed.withColumnRenamed("_open", "group_start").drop("_stop")
