"""Ranks of all rows of a table, without a window over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqmine.llm.storage import written

_ROW = 1 << 33


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` as a written table with each row's place in ``order``, from 0; equal rows get different places in no fixed order.

    Rows are sorted into ranges, numbered inside their range, and moved by the count of the ranges before it.  The window runs over one
    row per range.  Ranges of equal rows are split by a row number, so a row that fills a third of the table is no single task's work.
    """
    numbered = written(df.withColumn("_tie", F.monotonically_increasing_id()), "unsorted")
    placed = written(numbered.orderBy(*order, "_tie").drop("_tie").withColumn("_id", F.monotonically_increasing_id()), "sorted")
    part = F.floor(F.col("_id") / _ROW).cast("long")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = (placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
             .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first")))
    return (placed.withColumn("_part", part).join(first, "_part")
            .withColumn(name, F.col("_first") + F.col("_id") % _ROW).drop("_part", "_id", "_first"))
