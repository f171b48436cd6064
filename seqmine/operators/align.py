"""Numbering of frames and alignment of streams with a clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmine.functions.rational import floor_div
from seqmine.plans.blocks import Run, catch_up, last_where, run_totals, running, shifted


def number_frames(df: DataFrame, run: Run, *, header: str = "frame", start: str = "start") -> DataFrame:
    """Index from 0 per run, and duplicate indexes among equal neighbours.

    ``header_dup`` counts within consecutive equal header numbers, ``start_dup``
    within consecutive equal start positions.
    """
    rows = last_where(df, run, [header, start], {
        "_h": (lambda prev, cur: cur(header) != prev(header), True),
        "_s": (lambda prev, cur: cur(start) != prev(start), True)}, index="index")
    return (rows.withColumn("header_dup", F.col("index") - F.col("_h_index"))
            .withColumn("start_dup", F.col("index") - F.col("_s_index"))
            .drop("_h", "_s", "_h_index", "_s_index"))


def number_format(df: DataFrame, keys: Sequence[str], *, value: str = "frame", dup: str = "header_dup",
                  order: str = "index") -> DataFrame:
    """First, last, last duplicate and largest duplicate per item, and their text.

    Numbers that went back somewhere show as ``last < largest`` in ``backwards``.
    """
    last = F.max_by(F.struct(F.col(value).alias("v"), F.col(dup).alias("d")), order)
    out = (df.groupBy(*keys).agg(
        F.min_by(value, order).alias("first"), last.alias("_last"), F.max(dup).alias("max_dup"),
        F.max(value).alias("_max"), F.min(value).alias("_min"))
        .withColumn("last", F.col("_last.v")).withColumn("last_dup", F.col("_last.d")))
    text = F.concat_ws("-", "first", "last")
    suffix = F.concat(F.lit("."), F.col("last_dup"), F.lit("/"), F.col("max_dup"))
    return (out.withColumn("text", F.when(F.col("max_dup") > 0, F.concat(text, suffix)).otherwise(text))
            .withColumn("digits", F.when(F.col("last") == 0, 0).otherwise(F.length(F.col("last").cast("string"))).cast("bigint"))
            .withColumn("backwards", (F.col("last") < F.col("_max")) | (F.col("_min") < F.col("first")))
            .drop("_last", "_max", "_min"))


def padded(value: Column, digits: Column) -> Column:
    """Zero-padded number; a longer number is never cut."""
    text = value.cast("string")
    return F.lpad(text, F.greatest(digits.cast("int"), F.length(text)), F.lit("0"))


def check_continuity(df: DataFrame, run: Run, *, header: str = "header_pos") -> DataFrame:
    """Rows whose header position is not the previous one plus one.

    An unreadable (null) header resets the check.
    """
    rows = shifted(df, run, [header], "_prev")
    before = F.col(f"_prev.{header}")
    return (rows.where(F.col(header).isNotNull() & before.isNotNull() & (F.col(header) != before + 1))
            .withColumn("previous", before).drop("_prev"))


def minority_kind(df: DataFrame, run: Run, *, minor: Column, major: Column) -> DataFrame:
    """Rows of the minor kind met while fewer of it than of the major kind had been seen."""
    as_int = lambda c: F.when(c, 1).otherwise(0).cast("bigint")
    rows = running(df.withColumn("_minor", minor), run,
                   sums={"minor_before": as_int(minor), "major_before": as_int(major)}, exclusive=True)
    return rows.where(F.col("_minor") & (F.col("minor_before") < F.col("major_before"))).drop("_minor")


def with_first(df: DataFrame, run: Run, col: str, name: str = "first") -> DataFrame:
    """The value of ``col`` in the first row of each run, on every row."""
    rows = run_totals(df, run, mins={"_at": F.struct(run.place().alias("p"), F.col(col).alias("v"))})
    return rows.withColumn(name, F.col("_at.v")).drop("_at")


def fill_audio(df: DataFrame, run: Run, *, presentation: str = "pos", samples: str = "samples",
               first: str = "first", rate: int, speed: int) -> DataFrame:
    """Silent samples to insert before each packet so that audio keeps up with the clock."""
    ahead = (F.col(presentation) - F.col(first)).cast("bigint")
    target = floor_div(ahead * (2 * rate) + speed, F.lit(2 * speed).cast("bigint"))
    return catch_up(df, run, target, F.col(samples).cast("bigint"), "silence")


def fill_video(df: DataFrame, run: Run, *, presentation: str = "pos", first: str = "first",
               spf_num: int, spf_den: int = 1) -> DataFrame:
    """Frames to repeat before each frame; ``spf_num/spf_den`` is positions per frame.

    A frame that comes more than 0.8 frames early gets ``ahead`` = number of frames
    and nothing is removed.
    """
    num, den = F.lit(spf_num).cast("bigint"), F.lit(spf_den).cast("bigint")
    due = (F.col(presentation) - F.col(first)).cast("bigint") * den
    target = floor_div(F.lit(2).cast("bigint") * due + num, F.lit(2 * spf_num).cast("bigint"))
    rows = catch_up(df, run, target, F.lit(1).cast("bigint"), "repeats")
    early = F.col("written") * num - due
    return rows.withColumn("ahead", F.when(early * 5 >= num * 4, F.col("written") - target)
                           .otherwise(0).cast("bigint"))


def initial_offset(df: DataFrame, *, video_first: str, audio_first: str, rate: int, speed: int,
                   spf_num: int, spf_den: int = 1) -> DataFrame:
    """Start delay between audio and video: whole frames of video, samples of audio.

    All in units of ``1/(speed*spf_den)`` samples, so no rounding happens before the end.
    """
    unit = speed * spf_den
    diff = (F.col(audio_first) - F.col(video_first)).cast("bigint") * (rate * spf_den)
    per_frame = F.lit(rate * spf_num).cast("bigint")
    frames = F.when(diff < 0, -floor_div(diff, per_frame)).otherwise(F.lit(0).cast("bigint"))
    rest = diff + F.col("frame_delay") * per_frame
    samples = floor_div(F.lit(2).cast("bigint") * rest + unit, F.lit(2 * unit).cast("bigint"))
    return df.withColumn("frame_delay", frames).withColumn("sample_delay", samples)
