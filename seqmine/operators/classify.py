"""Decoding, rules and selections over single records."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmine.functions.bits import (CODING_BITS, CODING_RESERVED, LEAD_IN, PER_MINUTE, PER_SECOND,
                                    SUBMODE_BITS, SYNC_HEX, bcd, bit_field, byte_int, mismatches)
from seqmine.functions.rational import floor_div, whole_div
from seqmine.plans.ranges import overlap_pairs

MAX_SYNC_ERRORS = 4
RECORD_BYTES = 16128
# Nominal records per second at the two speeds of the medium.
SPEEDS = {1: 75, 2: 150}


def decode_header(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Sync errors, position code, mode and the audio test of a full-size record.

    ``raw`` is binary, or a string that already holds upper-case hex digits.
    """
    hex_text = F.col(raw) if dict(df.dtypes)[raw] == "string" else F.hex(F.substring(raw, 1, 16))
    minute, second, frame = (bcd(hex_text, i) for i in (12, 13, 14))
    out = df.withColumns({
        "sync_errors": mismatches(hex_text, SYNC_HEX),
        "header_pos": (minute * PER_MINUTE + second * PER_SECOND + frame - LEAD_IN).cast("bigint"),
        "mode": byte_int(hex_text, 15)})
    known = F.col("mode").isin(1, 2)
    return out.withColumn("is_audio", ~known | (F.col("sync_errors") > MAX_SYNC_ERRORS))


def decode_bits(df: DataFrame, col: str, layout: dict[str, tuple[int, int]] = SUBMODE_BITS) -> DataFrame:
    """One integer column per named field of ``col``."""
    return df.withColumns({name: bit_field(F.col(col), *at) for name, at in layout.items()})


def submode_valid(col: Column) -> Column:
    """At most one of the data, audio and video flags."""
    flags = [bit_field(col, *SUBMODE_BITS[n]) for n in ("data", "audio", "video")]
    return flags[0] + flags[1] + flags[2] <= 1


def coding_valid(col: Column) -> Column:
    return col.bitwiseAND(F.lit(CODING_RESERVED)) == 0


def decode_coding(df: DataFrame, col: str) -> DataFrame:
    return decode_bits(df, col, CODING_BITS)


@dataclass(frozen=True)
class Copies:
    """A field stored twice, with the test that tells a plausible value."""

    name: str
    first: str
    second: str
    valid: Callable[[Column], Column]


def reconcile_copies(df: DataFrame, copies: Sequence[Copies]) -> DataFrame:
    """One value per doubly stored field, and the number of fields that disagree.

    Equal copies are taken; if one copy alone is valid it is taken; otherwise the
    side that was right more often among the record's fields decides, the first
    copy on a draw.  Each field counts with its own verdict.
    """
    issues, balance = F.lit(0), F.lit(0)
    for c in copies:
        a, b = F.col(c.first), F.col(c.second)
        va, vb = c.valid(a), c.valid(b)
        issues = issues + F.when(a == b, 0).otherwise(1)
        balance = balance + F.when(a == b, 0).when(va & ~vb, 1).when(vb & ~va, -1).otherwise(0)
    out = df.withColumn("_balance", balance)
    for c in copies:
        a, b = F.col(c.first), F.col(c.second)
        va, vb = c.valid(a), c.valid(b)
        out = out.withColumn(c.name, F.when(a == b, a).when(va & ~vb, a).when(vb & ~va, b)
                             .when(F.col("_balance") >= 0, a).otherwise(b))
    return out.withColumn("issues", issues.cast("bigint")).drop("_balance")


def redundancy_score(df: DataFrame, a: Column, b: Column, most: Column | int) -> DataFrame:
    """Mismatches between two arrays of repeated parameters, and ``100 - errors*100 div most``."""
    most = (most if isinstance(most, Column) else F.lit(most)).cast("bigint")
    errors = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same: ~same))
    out = df.withColumn("errors", errors.cast("bigint"))
    return out.withColumn("probability", F.lit(100) - whole_div(F.col("errors") * 100, most))


def is_constant(values: Column, value: Column | int = 0) -> Column:
    """Whether every element equals ``value``."""
    value = value if isinstance(value, Column) else F.lit(value)
    return F.forall(values, lambda x: x == value)


def is_constant_payload(raw: Column, value: int = 0, group: int | None = None, head: int = 0) -> Column:
    """Whether every byte of a binary equals ``value``, the first ``head`` bytes of each ``group`` left aside.

    Groups are counted from the start; a cut last group is judged as far as it goes.  An empty binary is constant, a null gives null.
    """
    byte = f"(?:{value:02X})"
    if group is None:
        return F.hex(raw).rlike(f"^{byte}*+$")
    if not 0 <= head <= group or group < 1:
        raise ValueError("a group needs 0 <= head <= group")
    body = group - head
    whole = f"(?:[0-9A-F]{{{2 * head}}}{byte}{{{body}}})"
    return F.hex(raw).rlike(f"^{whole}*+(?:[0-9A-F]{{0,{2 * head}}}|[0-9A-F]{{{2 * head}}}{byte}{{0,{body}}})$")


@dataclass(frozen=True)
class Rule:
    """A named claim; ``produces=False`` claims the record without giving it a class."""

    name: str
    when: Column
    produces: bool = True
    probability: Column | int = 100
    fields: dict[str, Column] = field(default_factory=dict)


def classify(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """First matching rule wins; rule order is the priority.

    Adds ``claim`` (winning rule), ``class`` (null if the rule does not produce) and
    ``probability``.  A rule with probability 0 does not match.
    """
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)

    def first(value: Callable[[Rule], Column]) -> Column:
        out = None
        for r in rules:
            test = F.coalesce(r.when & (as_col(r.probability) > 0), F.lit(False))
            out = F.when(test, value(r)) if out is None else out.when(test, value(r))
        return out

    names = list(dict.fromkeys(n for r in rules for n in r.fields))
    return df.withColumns({
        "claim": first(lambda r: F.lit(r.name)),
        "class": first(lambda r: F.lit(r.name if r.produces else None)),
        "probability": first(lambda r: as_col(r.probability)),
        **{n: first(lambda r: r.fields.get(n, F.lit(None))) for n in names}})


def count_classes(df: DataFrame, name: str = "class") -> DataFrame:
    """Records per class; records without one are counted as ``Unknown``."""
    return (df.groupBy(F.coalesce(F.col(name), F.lit("Unknown")).alias(name))
            .agg(F.count(F.lit(1)).alias("records")))


def slice_items(records: DataFrame, items: DataFrame, on: Sequence[str], *, pos: str = "pos",
                span: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Records inside the closed interval of an item with equal ``on`` attributes."""
    return overlap_pairs(records, items, on, (pos, pos), span, a_points=True)


_LOOKUP = re.compile(r"([@#]?)(\d+)(?:\.(\d+))?")
_SYSTEM = {"": "index", "@": "sector", "#": "header"}


def parse_number(text: str) -> tuple[str, int, int]:
    """``12``, ``@12`` or ``#12``, each with an optional ``.dup``."""
    found = _LOOKUP.fullmatch(text.strip())
    if not found:
        raise ValueError(f"not a frame number: {text!r}")
    return _SYSTEM[found[1]], int(found[2]), int(found[3] or 0)


def parse_number_lookup(col: Column) -> Column:
    """Struct of system, value and duplicate index; null if the text is not a lookup."""
    pattern = r"^([@#]?)([0-9]+)(?:\.([0-9]+))?$"
    text = F.trim(col)
    part = lambda i: F.regexp_extract(text, pattern, i)
    system = F.when(part(1) == "@", "sector").when(part(1) == "#", "header").otherwise("index")
    dup = F.when(part(3) == "", "0").otherwise(part(3))
    return F.when(text.rlike(pattern), F.struct(
        system.alias("system"), part(2).try_cast("bigint").alias("value"),
        dup.try_cast("bigint").alias("dup")))


def filter_number_range(df: DataFrame, low: str, high: str,
                        columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows between two lookups, both included; ``columns`` maps a system to (value, dup)."""
    out = df
    for text, below in ((low, True), (high, False)):
        system, value, dup = parse_number(text)
        v, d = (F.col(c) for c in columns[system])
        strict = v > value if below else v < value
        tie = d >= dup if below else d <= dup
        out = out.where(strict | ((v == value) & tie))
    return out


def select_items(items: DataFrame, *, index: int | None = None, item_id: str | None = None,
                 kind: str | None = None, include_video_audio: bool = False,
                 parents: DataFrame | None = None, key: Sequence[str] = ("src", "id")) -> DataFrame:
    """Items by number, by id, or all of a kind.

    ``parents`` gives ``key`` columns of audio items that belong to a video; these
    are left out of a selection by kind unless asked for.
    """
    if index is not None:
        return items.where(F.col("number") == index)
    if item_id is not None:
        return items.where(F.col("id") == item_id)
    out = items.where(F.col("kind") == kind)
    if kind == "audio" and not include_video_audio and parents is not None:
        out = out.join(parents.select(*key), list(key), "left_anti")
    return out


def derive_durations(items: DataFrame, *, samples_per_record: int, rate: int, channels: int = 1,
                     bits: int = 4) -> DataFrame:
    """Record count, samples, seconds and speed class of constant-stride streams."""
    length = F.col("end") - F.col("start") + 1
    load = F.lit(rate * channels * bits).cast("bigint") * F.col("stride")
    speed = None
    for label, per_second in SPEEDS.items():
        hit = load == per_second * RECORD_BYTES
        speed = F.when(hit, label) if speed is None else speed.when(hit, label)
    stride = F.greatest(F.coalesce(F.col("stride"), F.lit(1)), F.lit(1))
    records = F.when(length == 1, F.lit(1).cast("bigint")).otherwise(
        whole_div(length, stride.cast("bigint")) + F.lit(1))
    fps = F.coalesce(speed, F.lit(2))
    per_second = F.when(fps == 1, SPEEDS[1]).otherwise(SPEEDS[2]).cast("bigint")
    return (items.withColumn("length", length).withColumn("record_count", records)
            .withColumn("samples", F.col("record_count") * samples_per_record)
            .withColumn("speed", speed)
            .withColumn("seconds", F.greatest(floor_div(length, per_second), F.lit(1).cast("bigint"))))
