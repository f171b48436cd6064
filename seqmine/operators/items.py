"""Ordering, numbering, merging and checking of items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmine.plans.blocks import BLOCK_ROWS, BLOCK_WIDTH, by_position, by_rows, dense_index, rekeyed, running
from seqmine.session import cut

# Item order of kinds that start at the same position; others come last.
KIND_LEVELS = {"file": 1, "video": 2, "audio": 3}
OTHER_LEVEL = 4


def kind_level(kind: Column) -> Column:
    out = None
    for name, level in KIND_LEVELS.items():
        out = F.when(kind == name, level) if out is None else out.when(kind == name, level)
    return out.otherwise(OTHER_LEVEL)


def order_items(items: DataFrame, *, src: str = "src", offset: str | None = None, rows: int = BLOCK_ROWS) -> DataFrame:
    """Items numbered from 0 per source.

    The order is start, kind level, kind, offset, longer first, id: a total order.  Nulls come first in each of them, and items of a null
    source are a source of their own.  Blocks hold about ``rows`` items, also if most items start at a few positions.
    """
    at = F.col(offset) if offset else F.lit(0)
    made = (items.withColumn("_level", kind_level(F.col("kind"))).withColumn("_off", at)
            .withColumn("_longer", -F.col("end")))
    cells, run = by_rows(made, [src], ["start", "_level", "kind", "_off", "_longer", "id"], rows)
    return dense_index(cells, run, "number").drop("_level", "_off", "_longer", "blk")


def assign_ids(items: DataFrame, *, src: str = "src", width: int = BLOCK_WIDTH) -> DataFrame:
    """Hierarchical ids of up to three levels.

    Items have ``src, id, number, kind, path, parent_id``.  A root file keeps its
    path and takes no root number; other roots are ``?[0]``, ``?[1]`` and so on;
    children take the ids of their parents plus their own number among them.
    """
    numbered, run = by_position(items, [src], "number", width)
    roots = numbered.where(F.col("parent_id").isNull())
    files = roots.where(F.col("kind") == "file").withColumn("_own", F.lit(None).cast("bigint"))
    others = dense_index(roots.where(F.col("kind") != "file"), run, "_own")
    below = dense_index(*rekeyed(numbered.where(F.col("parent_id").isNotNull()), run, [src, "parent_id"]), "_own")
    named = cut(files.drop("blk").unionByName(others.drop("blk")).unionByName(below.drop("blk")))
    up = named.select(src, F.col("id").alias("parent_id"), F.col("parent_id").alias("_grand"),
                      F.col("_own").alias("_up_own"), F.col("path").alias("_up_path"))
    top = named.select(src, F.col("id").alias("_grand"), F.col("_own").alias("_top_own"),
                       F.col("path").alias("_top_path"))
    joined = named.join(up, [src, "parent_id"], "left").join(top, [src, "_grand"], "left")
    tree = F.array_compact(F.array("_top_own", "_up_own", "_own"))
    path = (F.when(F.col("_grand").isNotNull(), F.col("_top_path"))
            .when(F.col("parent_id").isNotNull(), F.col("_up_path")).otherwise(F.col("path")))
    text = F.concat(F.coalesce(path, F.lit("?")),
                    F.when(F.size("_tree") > 0, F.concat(F.lit("["), F.array_join(F.col("_tree").cast("array<string>"), "."),
                                                         F.lit("]"))).otherwise(""))
    return (joined.withColumn("_tree", tree).withColumn("item_id", text)
            .select(*items.columns, "item_id", F.col("_tree").alias("tree")))


def merge_streams(frames: DataFrame, packets: DataFrame) -> DataFrame:
    """One timeline of frames and packets, marked by ``kind`` ``frame`` or ``audio``.

    No order is imposed on the table; write it with ``sortWithinPartitions`` or read
    it through a ``Run`` over ``(src, pos, kind)``.
    """
    return (frames.withColumn("kind", F.lit("frame"))
            .unionByName(packets.withColumn("kind", F.lit("audio")), allowMissingColumns=True))


def timeline_range(merged: DataFrame, keys: Sequence[str] = ("src",), *, pos: str = "pos", end: str | None = None) -> DataFrame:
    """Range of each merged timeline, from its first frame or packet to its last, with the count of both and the range of the frames."""
    last, frame = F.col(end or pos), F.col("kind") == "frame"
    return merged.groupBy(*keys).agg(
        F.min(pos).alias("start"), F.max(last).alias("end"), F.count_if(frame).alias("frames"), F.count_if(~frame).alias("packets"),
        F.min(F.when(frame, F.col(pos))).alias("first_frame"), F.max(F.when(frame, last)).alias("last_frame"))


def union_disjoint(items: DataFrame, *, keys: Sequence[str] = ("grp",), rows: int = BLOCK_ROWS) -> DataFrame:
    """Checks a set of streams for a common timeline and gives its range.

    A set is accepted if no streams overlap, all have one format and at most one
    known speed.  Items have ``start, end, id, fmt, speed, first``.  Null keys are a set of their own.
    """
    cells, run = by_rows(items, keys, ["start", "id"], rows)
    reached = running(cells, run, maxes={"_reach": F.col("end")}, exclusive=True)
    out = reached.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("streams"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.min("first").alias("first"),
        F.count_if(F.col("start") <= F.col("_reach")).alias("overlaps"),
        (F.min("fmt") != F.max("fmt")).alias("mixed_format"),
        F.coalesce(F.min("speed") != F.max("speed"), F.lit(False)).alias("mixed_speed"))
    accepted = (F.col("overlaps") == 0) & ~F.col("mixed_format") & ~F.col("mixed_speed")
    return out.withColumn("accepted", accepted)


def anomalies(kind: str, df: DataFrame, *, src: str, pos: str, detail: Column) -> DataFrame:
    """Fault rows in the common form ``kind, src, pos, detail``; ``src`` keeps its type."""
    return df.select(F.lit(kind).alias("kind"), F.col(src).alias("src"),
                     F.col(pos).cast("bigint").alias("pos"), detail.cast("string").alias("detail"))


def anomaly_report(parts: Sequence[DataFrame]) -> DataFrame:
    """All fault rows; ``src`` becomes a string if some part's sources are strings and others' are not."""
    strings = [p.schema["src"].dataType.simpleString() == "string" for p in parts]
    if any(strings) and not all(strings):
        parts = [p.withColumn("src", F.col("src").cast("string")) for p in parts]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def anomaly_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("faults"),
                                             F.min("pos").alias("first_pos"))
