"""Interval joins by equi-join on buckets of matching size.

Each interval belongs to the smallest bucket size that is at least its length, so
it touches at most two buckets of its own level.  A pair meets at the level of its
longer member.  A short interval therefore probes one or two buckets per level
present on the other side, and a very long interval is not cut into many pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A bucket of level l spans 2 ** (BASE_BITS + STEP_BITS * l) positions.
BASE_BITS = 4
STEP_BITS = 3


def level_of(length: Column) -> Column:
    """Smallest level whose buckets are at least ``length`` wide."""
    bits = F.length(F.bin(length - 1))
    return F.greatest(F.ceil((bits - BASE_BITS) / STEP_BITS), F.lit(0)).cast("int")


def bucket_of(position: Column, level: Column) -> Column:
    return F.call_function("shiftright", position, F.lit(BASE_BITS) + F.lit(STEP_BITS) * level)


def _levels(df: DataFrame, start: str, end: str) -> list[int]:
    """Bucket sizes in use; there are at most 20, whatever the data."""
    level = level_of(F.col(end) - F.col(start) + 1).alias("l")
    return sorted(r["l"] for r in df.select(level).distinct().collect())


def _cell(level: Column, position: Column, tag: int) -> Column:
    """Bucket, level and tag in one number, so that the join compares a single BIGINT."""
    return bucket_of(position, level) * 64 + (level * 2 + tag)


def _spread(df: DataFrame, start: str, end: str, own_tag: int, other_levels: list[int],
            include_equal: bool, points: bool) -> DataFrame:
    """One row per cell: the own ones and those of the other side's larger levels.

    The levels are known, so the cells are plain expressions inside generated code.
    """
    lo, hi = F.col(start), F.col(end)
    own = F.lit(0) if points else level_of(hi - lo + 1)
    rows = df.withColumn("_own", own)
    own = F.col("_own")
    cells = []
    for level, tag, test in [(own, own_tag, None)] + [
            (F.lit(l), 1 - own_tag, own <= l if include_equal else own < l) for l in other_levels]:
        first, last = _cell(level, lo, tag), _cell(level, hi, tag)
        cells.append(first if test is None else F.when(test, first))
        if not points:
            cells.append(F.when(first != last if test is None else test & (first != last), last))
    return (rows.select(*df.columns, F.explode(F.array(*cells)).alias("_cell"))
            .where(F.col("_cell").isNotNull()))


def overlap_pairs(a: DataFrame, b: DataFrame, on: Sequence[str], a_span: tuple[str, str],
                  b_span: tuple[str, str], a_points: bool = False,
                  b_points: bool = False) -> DataFrame:
    """All pairs with equal ``on`` whose closed intervals meet, each pair once.

    Column names of ``a`` and ``b`` must differ except for ``on``.
    """
    a_levels = [0] if a_points else _levels(a, *a_span)
    b_levels = [0] if b_points else _levels(b, *b_span)
    left = _spread(a, *a_span, 0, b_levels, False, a_points)
    right = _spread(b, *b_span, 1, a_levels, True, b_points)
    meet = F.greatest(F.col(a_span[0]), F.col(b_span[0]))
    level = F.floor(F.pmod("_cell", F.lit(64)) / 2).cast("int")
    # A pair shares up to two cells; it counts in the one where the overlap begins.
    return (left.join(right, [*on, "_cell"])
            .where((F.col(a_span[0]) <= F.col(b_span[1])) & (F.col(b_span[0]) <= F.col(a_span[1])))
            .where(bucket_of(meet, level) == F.call_function("shiftright", F.col("_cell"), F.lit(6)))
            .drop("_cell"))
