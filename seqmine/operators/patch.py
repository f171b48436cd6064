"""Replacing rows, byte ranges and blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmine.plans.blocks import BLOCK_ROWS, by_rows, dense_index, null_safe_join, running
from seqmine.session import cut


class PatchRefused(ValueError):
    """Patches overlap or reach past the end of a record."""


def first_entries(replacements: DataFrame, key: Sequence[str], order: str = "entry") -> DataFrame:
    """The first entry per key."""
    others = [c for c in replacements.columns if c not in key]
    picked = replacements.groupBy(*key).agg(F.min_by(F.struct(*others), order).alias("_r"))
    return picked.select(*key, *[F.col(f"_r.{c}").alias(c) for c in others])


def replace_rows(df: DataFrame, replacements: DataFrame, key: Sequence[str], value: str, new: str,
                 order: str = "entry") -> DataFrame:
    """``value`` taken from the first replacement entry of the row's key, if there is one."""
    first = first_entries(replacements.select(*key, order, F.col(new).alias("_new")), key, order)
    return (df.join(first.select(*key, "_new", F.lit(True).alias("replaced")), list(key), "left")
            .withColumn(value, F.when(F.col("replaced"), F.col("_new")).otherwise(F.col(value)))
            .withColumn("replaced", F.coalesce(F.col("replaced"), F.lit(False))).drop("_new"))


def unmatched_replacements(df: DataFrame, replacements: DataFrame, key: Sequence[str]) -> DataFrame:
    """Replacement entries that no row matched."""
    return replacements.join(df.select(*key), list(key), "left_anti")


def check_patches(records: DataFrame, patches: DataFrame, *, key: Sequence[str] = ("src", "pos"),
                  data: str = "data", offset: str = "offset", new: str = "bytes",
                  rows: int = BLOCK_ROWS) -> DataFrame:
    """Patches that overlap an earlier one, reach past their record, or have no record.

    Touching patches (one starts where the other ends) are allowed.  A null key names a record with a null key.
    """
    sized = patches.withColumn("_end", F.col(offset) + F.length(new))
    cells, run = by_rows(sized, key, [offset, "entry"], rows)
    reached = running(cells, run, maxes={"_reach": F.col("_end")}, exclusive=True)
    known = null_safe_join(reached, records.select(*key, F.length(data).alias("_size")), list(key), "left")
    fault = (F.when(F.col("_size").isNull(), "no record")
             .when((F.col(offset) < 0) | (F.col("_end") > F.col("_size")), "past end")
             .when(F.col(offset) < F.col("_reach"), "overlap"))
    return (known.withColumn("fault", fault).where(F.col("fault").isNotNull())
            .select(*key, "entry", offset, "fault"))


def apply_patches(records: DataFrame, patches: DataFrame, *, key: Sequence[str] = ("src", "pos"),
                  data: str = "data", offset: str = "offset", new: str = "bytes",
                  checked: bool = False) -> DataFrame:
    """Records with their patches laid over, one rewrite per record.

    Refuses everything before any output if a patch is faulty; ``checked=True``
    says the caller has run ``check_patches``.  Legal patches of one record do not
    overlap and empty ones are left out, so a list is never larger than its record.
    """
    if not checked and not check_patches(records, patches, key=key, data=data, offset=offset, new=new).isEmpty():
        raise PatchRefused("patches overlap or do not fit; see check_patches")
    lists = patches.where(F.length(new) > 0).groupBy(*key).agg(F.array_sort(F.collect_list(
        F.struct(F.col(offset).cast("int").alias("o"), F.col(new).alias("n")))).alias("_p"))
    patched = F.aggregate("_p", F.col(data), lambda acc, p: F.overlay(acc, p["n"], p["o"] + 1))
    return (null_safe_join(records, lists, list(key), "left")
            .withColumn("patches", F.coalesce(F.size("_p"), F.lit(0)).cast("bigint"))
            .withColumn(data, F.when(F.col("_p").isNotNull(), patched).otherwise(F.col(data))).drop("_p"))


def zip_positional(a: DataFrame, b: DataFrame, keys: Sequence[str], order: Sequence[str], *, same: Sequence[str] = (),
                   rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The n-th record of one stream beside the n-th of the other, in ``order``.

    ``same`` columns and the count must agree; returns the zipped rows of agreeing keys and the refused keys with
    their reason.  Null keys are a stream of their own and are zipped like others.  Blocks hold about ``rows`` records.
    """
    keys = list(keys)

    def profile(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(F.struct(*keys).alias("_k")).agg(
            F.count(F.lit(1)).alias(f"{side}_count"),
            *[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"{side}_{c}") for c in same])

    # The struct of the keys is never null, so null keys meet by plain equality.
    both = profile(a, "a").join(profile(b, "b"), "_k", "full")
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    reason = (F.when(F.col("a_count").isNull() | F.col("b_count").isNull(), "missing side")
              .when(differs, "format").when(F.col("a_count") != F.col("b_count"), "count"))
    judged = cut(both.withColumn("reason", reason))
    good = judged.where(F.col("reason").isNull()).select("_k")

    def numbered(df: DataFrame, side: str) -> DataFrame:
        kept = df.withColumn("_k", F.struct(*keys)).join(good, "_k", "left_semi")
        cells, run = by_rows(kept, keys, order, rows)
        return dense_index(cells, run, "n").select("_k", "n", *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in (*keys, "n")])

    spread = [F.col("_k")[k].alias(k) for k in keys]
    zipped = numbered(a, "a").join(numbered(b, "b"), ["_k", "n"]).select(*spread, "*").drop("_k")
    return zipped, judged.where(F.col("reason").isNotNull()).select(*spread, "a_count", "b_count", "reason")


def diff_blocks(a: DataFrame, b: DataFrame, *, key: Sequence[str] = ("id",), cell: str = "cell",
                block: Column, components: Sequence[str], tolerance: float,
                mask: Column | None = None) -> DataFrame:
    """Blocks with a cell that differs by more than ``tolerance`` in any component.

    Only cells inside ``mask`` count.  Per block: cells compared, cells that differ
    and the largest difference; ``differs`` is the verdict.
    """
    cols = list(components)
    right = b.select(*key, cell, *[F.col(c).alias(f"_{c}") for c in cols])
    left = a.select(*key, cell, *cols)
    if mask is not None:
        left = left.where(mask)
    gap = F.greatest(*[F.abs(F.col(c) - F.col(f"_{c}")) for c in cols]) if len(cols) > 1 else F.abs(
        F.col(cols[0]) - F.col(f"_{cols[0]}"))
    return (null_safe_join(left, right, [*key, cell]).withColumn("_gap", gap)
            .groupBy(*key, block.alias("block"))
            .agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("_gap") > tolerance).alias("changed"),
                 F.max("_gap").alias("largest"))
            .withColumn("differs", F.col("changed") > 0))


def diff_verdict(blocks: DataFrame, key: Sequence[str] = ("id",)) -> DataFrame:
    """Per key: ``skip`` if no block differs, ``all`` if every block does, else ``partial``."""
    out = blocks.groupBy(*key).agg(F.count(F.lit(1)).alias("blocks"), F.count_if("differs").alias("changed_blocks"))
    verdict = (F.when(F.col("changed_blocks") == 0, "skip")
               .when(F.col("changed_blocks") == F.col("blocks"), "all").otherwise("partial"))
    return out.withColumn("verdict", verdict)
