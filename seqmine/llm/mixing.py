"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

Every source wants its share of the budget by weight, but no more than ``epochs`` times its own size.  Sources above their cap are
clamped to it and what they leave is dealt anew by weight, round after round, until none is above.  A round is one aggregate over the
table of sources that returns two numbers.

A source's target is then met by whole repetitions of all its documents and, for the rest, by one more repetition of some of them.  These
are the first ones in the order of a seeded hash, so they are the same in each run.  The place where the rest is used up is
found by sums per bucket of leading hash bits; only the bucket in which it lies is walked document by document, and there a document that is
too long for what is left is passed over.  So a source's words end nearer to its target than half the shortest document passed over.

All of it is DataFrame functions.  Sums combine before the shuffle, no window runs over a source's documents, and repeated rows of a
source are counted, not listed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqmine.llm.ranks import ranked
from seqmine.llm.storage import small_side, written

WORD = r"[^\x20\x09-\x0D]+"
#: Rows in the bucket that is walked document by document, about.
WALKED = 512
#: Bits of the hash, and bits by which one pass narrows the bucket.
HASH_BITS, PASS_BITS = 60, 12
#: Weights are exact decimals, so their sums do not depend on an order.
WEIGHT = "decimal(20,6)"


def words(text: Column) -> Column:
    """Number of words of a text, 0 for none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def dealt(sources: DataFrame, column: str, weights: Sequence[float]) -> DataFrame:
    """``column``'s distinct values with a ``weight`` each: ``weights`` dealt in turn, by code point, null last."""
    values = ranked(sources.select(column).distinct(), [F.asc_nulls_last(column)])
    listed = F.array(*[F.lit(w) for w in weights])
    return values.select(column, F.get(listed, (F.col("rank") % len(weights)).cast("int")).cast(WEIGHT).alias("weight"))


def targets(sizes: DataFrame, budget: float, epochs: float) -> DataFrame:
    """``sizes`` (written: ``source_size``, ``weight``) with ``target``.

    The clamped sources only grow from round to round, so their number tells whether a round changed anything.
    """
    cap = F.lit(float(epochs)) * F.col("source_size")
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(0)), F.lit(0)).cast(WEIGHT)
    level, clamped = None, -1
    while True:
        above = F.lit(False) if level is None else weight.cast("double") * F.lit(level) > cap
        found = sizes.agg(F.count(F.when(above, 1)).alias("n"), F.sum(F.when(above, F.col("source_size"))).alias("size"),
                          F.sum(F.when(~above, weight)).alias("weight")).first()
        if found.n == clamped:
            break
        clamped = found.n
        if not found.weight:  # every source that has a weight is full, or there is none
            level = float("inf") if clamped else 0.0
            break
        level = (budget - float(epochs) * (found.size or 0)) / float(found.weight)
    share = F.when(weight == 0, F.lit(0.0)).otherwise(weight.cast("double") * F.lit(level))
    return sizes.withColumn("target", F.when(share > cap, cap).otherwise(share))


def mix(docs: DataFrame, weights: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", share: float = 1.5,
        epochs: float = 2.0, seed: int = 0, keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``weights`` holds one ``weight`` per value of ``source``; a source without one, or with one of 0 or less, is not taken.  The budget is
    ``share`` times all words.  A null text has no words; a null source is a source; rows with a null key, equal keys or equal texts are
    rows like others.  Of wholly equal rows it is undefined which ones are repeated, their number is fixed.  Columns of
    ``docs`` called like a result, or starting with ``mix_``, are replaced.  An empty table gives no rows.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made and not c.startswith("mix_")]
    spelled = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("-")), F.lit("|"),
                       F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("-")))
    drawn = F.conv(F.substring(F.md5(spelled.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    rows = written(docs.select(*kept, F.struct(F.col(source).alias("v")).alias("mix_s"), words(F.col(text)).alias("size"),
                               drawn.alias("mix_h"), F.monotonically_increasing_id().alias("mix_row")), "mix-rows")

    sums = rows.groupBy("mix_s").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("mix_n"))
    wanted = weights.select(F.struct(F.col(source).alias("v")).alias("mix_s"), F.col("weight").cast(WEIGHT).alias("weight"))
    sizes = written(sums.join(wanted, "mix_s", "left"), "mix-sizes")
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.greatest(F.lit(0).cast("long"), F.floor(F.col("target") - F.col("mix_whole") * F.col("source_size")))
    bits = F.expr(f"if(mix_n <= {WALKED}, 0, length(bin((mix_n - 1) div {WALKED})))")
    plan = written(targets(sizes, float(share) * total, epochs).withColumn("mix_whole", whole).withColumn("mix_rest", rest)
                   .withColumn("mix_bits", F.least(bits, F.lit(HASH_BITS))), "mix-plan")

    border = written(_border(rows, plan), "mix-border")
    picked = written(_picked(rows, border), "mix-picked")
    per_source = plan.join(border.select("mix_s", "mix_bits", "mix_prefix").withColumnRenamed("mix_bits", "mix_depth"), "mix_s", "left")
    per_source = small_side(written(per_source.select("mix_s", "source_size", "target", "mix_whole", "mix_depth", "mix_prefix"), "mix-sources"))
    out = rows.join(per_source, "mix_s").join(small_side(picked), ["mix_s", "mix_h", "size"], "left")
    once = F.expr(f"mix_prefix is not null and shiftright(mix_h, {HASH_BITS} - mix_depth) < mix_prefix") | (F.col("mix_m") == F.col("mix_of"))
    some = picked.where("mix_m < mix_of")
    if some.isEmpty():
        more = F.coalesce(once, F.lit(False))
    else:
        out = out.join(_first_rows(rows, some), "mix_row", "left")
        more = F.coalesce(once, F.lit(False)) | F.col("mix_first").isNotNull()
    out = out.withColumn("copies", (F.col("mix_whole") + more.cast("long")).cast("int"))
    return out.select(*kept, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _border(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source the bucket of leading hash bits in which its rest is used up, and the words in the buckets before it.

    A pass sums at most ``2 ** PASS_BITS`` buckets per source and goes on inside the one found.
    """
    now = plan.select("mix_s", "mix_rest", "mix_bits", F.lit(0).alias("mix_depth"), F.lit(0).cast("long").alias("mix_prefix"),
                      F.lit(0).cast("long").alias("mix_before"))
    deepest = plan.agg(F.max("mix_bits")).first()[0] or 0
    for _ in range(0, deepest, PASS_BITS):
        now = written(now, "mix-now")
        step = F.least(F.col("mix_bits") - F.col("mix_depth"), F.lit(PASS_BITS))
        going = now.where("mix_depth < mix_bits").withColumn("mix_next", F.col("mix_depth") + step)
        inside = rows.select("mix_s", "size", "mix_h").join(small_side(going), "mix_s").where(
            f"shiftright(mix_h, {HASH_BITS} - mix_depth) = mix_prefix")
        held = ["mix_s", "mix_rest", "mix_bits", "mix_next", "mix_before"]
        sums = (inside.groupBy(*held, F.expr(f"shiftright(mix_h, {HASH_BITS} - mix_next)").alias("mix_bucket"))
                .agg(F.sum("size").alias("mix_sum")))
        upto = Window.partitionBy("mix_s").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        crossed = (sums.withColumn("mix_after", F.col("mix_before") + F.sum("mix_sum").over(upto)).where("mix_after > mix_rest")
                   .groupBy("mix_s", "mix_rest", "mix_bits", "mix_next")
                   .agg(F.min(F.struct("mix_bucket", F.col("mix_after") - F.col("mix_sum"))).alias("mix_at")))
        now = now.where("mix_depth = mix_bits").unionByName(
            crossed.select("mix_s", "mix_rest", "mix_bits", F.col("mix_next").alias("mix_depth"),
                           F.col("mix_at")["mix_bucket"].alias("mix_prefix"), F.col("mix_at")["col2"].alias("mix_before")))
    return now.drop("mix_depth")


def _picked(rows: DataFrame, border: DataFrame) -> DataFrame:
    """Documents of the border buckets that still fit, in hash order: how many (``mix_m``) of how many equal rows (``mix_of``)."""
    near = rows.select("mix_s", "mix_h", "size").join(small_side(border), "mix_s").where(
        f"size > 0 and shiftright(mix_h, {HASH_BITS} - mix_bits) = mix_prefix")
    left = F.col("mix_rest") - F.col("mix_before")
    equal = near.groupBy("mix_s", left.alias("mix_left"), "mix_h", "size").agg(F.count(F.lit(1)).alias("n"))
    lists = equal.groupBy("mix_s", "mix_left").agg(F.sort_array(F.collect_list(F.struct(
        F.col("mix_h").alias("h"), F.col("size").alias("size"), F.col("n").alias("n")))).alias("mix_docs"))
    seen = "struct<h:bigint,size:bigint,m:bigint,n:bigint>"
    fits = "least(x.n, acc.room div x.size)"
    walked = F.expr(f"""aggregate(mix_docs, named_struct('room', mix_left, 'seen', cast(array() as array<{seen}>), 'over', cast(null as
        struct<size:bigint,h:bigint,n:bigint>)), (acc, x) -> if(x.size <= acc.room,
            named_struct('room', acc.room - x.size * {fits}, 'seen', array_append(acc.seen, named_struct('h', x.h, 'size', x.size,
                         'm', {fits}, 'n', x.n)), 'over', acc.over),
            named_struct('room', acc.room, 'seen', acc.seen, 'over', least(acc.over, named_struct('size', x.size, 'h', x.h, 'n', x.n)))))""")
    # The shortest document passed over is taken if that ends nearer to the target.
    chosen = F.expr(f"""if(w.over.size - w.room < w.room, array_append(w.seen, cast(named_struct('h', w.over.h, 'size', w.over.size, 'm', 1L,
        'n', w.over.n) as {seen})), w.seen)""")
    return lists.select("mix_s", walked.alias("w")).select("mix_s", F.explode(chosen).alias("p")).select(
        "mix_s", F.col("p.h").alias("mix_h"), F.col("p.size").alias("size"), F.col("p.m").alias("mix_m"), F.col("p.n").alias("mix_of"))


def _first_rows(rows: DataFrame, some: DataFrame) -> DataFrame:
    """Row numbers of the first ``mix_m`` of each group of equal rows; rows are numbered per written part, so a large group is split."""
    group = ["mix_s", "mix_h", "size"]
    part = F.floor(F.col("mix_row") / (1 << 33)).cast("long")
    equal = rows.select(*group, "mix_row", part.alias("mix_part")).join(small_side(some), group)
    counts = equal.groupBy(*group, "mix_part").agg(F.count(F.lit(1)).alias("mix_k"))
    earlier = Window.partitionBy(*group).orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*group, "mix_part", F.coalesce(F.sum("mix_k").over(earlier), F.lit(0)).alias("mix_gone"))
    inner = Window.partitionBy(*group, "mix_part").orderBy("mix_row")
    return (equal.withColumn("mix_i", F.row_number().over(inner)).join(before, [*group, "mix_part"])
            .where("mix_gone + mix_i <= mix_m").select("mix_row", F.lit(True).alias("mix_first")))
