"""Best parent of each child interval, without pairs of children and parents.

Parents of one class (source, kind, channel) that lie inside an earlier one can never win.  What is left of a class is a skyline: ordered
by start, ends grow strictly.  For a child, let A be the last parent of the skyline that starts no later than the child, and B the first that ends no
earlier.  If B starts no later than the child it holds all of it.  Otherwise the best overlap is that of A, of B, or the length of the
longest parent between the two, which all lie inside the child.  A and B come from walks along one line of positions, the longest
between them from a table of maxima over 2, 4, 8, ... neighbours.  Every child is a few rows in all this, however many parents it meets.

Classes in which parents or children are few are joined instead, which makes at most that many pairs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmine.functions.rational import whole_div
from seqmine.plans.blocks import BLOCK_ROWS, BLOCK_WIDTH, Run, by_position, by_rows, dense_index, null_safe_join, running
from seqmine.plans.ranges import overlap_pairs
from seqmine.session import cut

BONUS = 100
#: A class with at most so many parents, or so many different children, is joined.
FEW = 64


def assign_parent(children: DataFrame, parents: DataFrame, *, src: str = "src", video: str = "video", audio: str = "audio",
                  file: str = "file", channel: str | None = None, width: int = BLOCK_WIDTH, rows: int = BLOCK_ROWS,
                  few: int = FEW) -> DataFrame:
    """Best parent of each child, or none: ``children`` with ``parent_id`` and ``rating``.

    Children have ``src, c_id, c_start, c_end, c_kind``; parents ``src, p_id, p_order, p_start, p_end, p_kind``.  The rating is the
    overlap in percent of the child's length (whole number), plus 100 for audio in a video.  The highest rating above zero wins, the smallest
    ``p_order`` on ties.  A file never holds a file, and a video holds audio only.  With ``channel``, a column of both sides, a video
    with a channel holds only audio of the same channel; one without holds audio of any.  Null sources are a source of their own.

    ``p_order`` is unique in a source and, as item order is, should grow with ``p_start``.  If it does not, large classes are
    rated through all overlapping pairs too.  ``few`` and the block sizes change no result.
    """
    names = [src, "c_start", "c_end", "c_kind", *([channel] if channel else [])]
    spans = cut(children.select(*names).distinct().withColumn("_q", F.monotonically_increasing_id()))
    kind = F.col("p_kind")
    group = F.when(kind == video, "v").when(kind == file, "f").otherwise("o")
    bound = F.when(kind == video, F.col(channel).cast("string")) if channel else F.lit(None).cast("string")
    held = cut(parents.select(_class(F.col(src), group, bound), "p_id", F.col("p_order").cast("bigint").alias("p_order"),
                              F.col("p_start").cast("bigint").alias("p_start"), F.col("p_end").cast("bigint").alias("p_end")))
    asked = _asked(spans, src, video, audio, file, channel)
    sizes = held.groupBy("_k").agg(F.count(F.lit(1)).alias("_parents")).join(asked.groupBy("_k").agg(F.count(F.lit(1)).alias("_children")), "_k")
    # A class is a struct with nulls; from here on it is a number.
    classes = cut(sizes.select("_k", (F.least("_parents", "_children") <= few).alias("_few"), F.monotonically_increasing_id().alias("_c")))
    held, asked = (df.join(classes, "_k").drop("_k") for df in (held, asked))
    best = _by_pairs(asked.where("_few"), held.where("_few").drop("_few"))
    if not classes.where("not _few").isEmpty():
        best = best.unionByName(_of_large(asked.where("not _few").drop("_few"), held.where("not _few").drop("_few"), width, rows))
    rating = F.struct((F.col("pct") + F.col("bonus")).alias("rating"), (-F.col("p_order")).alias("o"), "p_id")
    won = spans.join(best.groupBy("_q").agg(F.max(rating).alias("_b")), "_q").drop("_q")
    return (null_safe_join(children, won, names, "left")
            .withColumn("parent_id", F.col("_b.p_id")).withColumn("rating", F.coalesce(F.col("_b.rating"), F.lit(0)).cast("bigint")).drop("_b"))


def _of_large(asked: DataFrame, held: DataFrame, width: int, rows: int) -> DataFrame:
    cells, run = by_rows(held, ["_c"], ["p_start", "p_order"], rows)
    reached = cut(running(cells, run, maxes={"_reach": F.col("p_end"), "_late": F.col("p_order")}, exclusive=True))
    if reached.where("_late > p_order").isEmpty():
        outer = reached.where("_reach is null or p_end > _reach").drop("_reach", "_late")
        return _by_skyline(asked, cut(dense_index(outer, run, "i").drop("blk")), width)
    return _by_bucket_pairs(asked, reached.drop("_reach", "_late", "blk"))


def _class(src: Column, group: Column, channel: Column) -> Column:
    return F.struct(src.alias("s"), group.alias("g"), channel.alias("ch")).alias("_k")


def _asked(spans: DataFrame, src: str, video: str, audio: str, file: str, channel: str | None) -> DataFrame:
    """Each different child once per class of parents that may hold it: ``_q``, ``_k``, ``s``, ``e``, ``bonus``."""
    none = F.lit(None).cast("string")
    one = lambda group, ch, bonus: F.struct(F.lit(group).alias("g"), ch.alias("ch"), F.lit(bonus).alias("bonus"))
    kind = F.col("c_kind")
    is_audio, is_file = F.coalesce(kind == audio, F.lit(False)), F.coalesce(kind == file, F.lit(False))
    same = F.col(channel).cast("string") if channel else none
    classes = F.filter(F.array(
        F.when(is_audio, one("v", none, BONUS)), F.when(is_audio & same.isNotNull(), one("v", same, BONUS)),
        F.when(~is_file, one("f", none, 0)), one("o", none, 0)), lambda x: x.isNotNull())
    return (spans.withColumn("_x", F.explode(classes))
            .select("_q", _class(F.col(src), F.col("_x.g"), F.col("_x.ch")), F.col("c_start").cast("bigint").alias("s"),
                    F.col("c_end").cast("bigint").alias("e"), F.col("_x.bonus").alias("bonus")))


_BEST = ("_q", "bonus", "pct", "p_order", "p_id")


def _by_pairs(asked: DataFrame, parents: DataFrame) -> DataFrame:
    """All pairs of a class that overlap; one side has few rows."""
    return _rated(asked.join(parents, "_c").where((F.col("s") <= F.col("p_end")) & (F.col("p_start") <= F.col("e"))))


def _by_bucket_pairs(asked: DataFrame, parents: DataFrame) -> DataFrame:
    return _rated(overlap_pairs(asked, parents, ["_c"], ("s", "e"), ("p_start", "p_end")))


def _rated(pairs: DataFrame) -> DataFrame:
    overlap = F.least("e", "p_end") - F.greatest("s", "p_start") + 1
    return pairs.withColumn("pct", _percent(overlap)).where("pct > 0").select(*_BEST)


def _percent(overlap: Column) -> Column:
    return whole_div(overlap * 100, F.col("e") - F.col("s") + 1)


def _nearest(parents: DataFrame, queries: DataFrame, at: str, place: str, name: str, first: bool, width: int) -> DataFrame:
    """For each class and ``at``, the first parent whose ``place`` is not below it, or else the last one whose ``place`` is not above it."""
    known = F.struct("i", "p_start", "p_end", "p_order", "p_id")
    # Walked towards the query, a parent at the query's own position comes before it.
    line = (parents.select("_c", F.col(place).alias("_at"), "i", F.lit(1 if first else 0).alias("_kind"), known.alias("_p"))
            .unionByName(queries.select("_c", F.col(at).alias("_at")).distinct().withColumn("_kind", F.lit(0 if first else 1)),
                         allowMissingColumns=True))
    cells, _ = by_position(line, ["_c"], "_at", width)
    found = running(cells, Run(("_c",), ("_at", "_kind", "i")), lasts={name: F.col("_p")}, reverse=first)
    return found.where("_p is null").select("_c", F.col("_at").alias(at), name)


def _by_skyline(asked: DataFrame, sky: DataFrame, width: int) -> DataFrame:
    """The best parent per span and class."""
    sizes = sky.groupBy("_c").agg(F.max("i").alias("_top"))
    asked = cut(asked.join(sizes, "_c"))
    near = (asked.join(_nearest(sky, asked, "s", "p_start", "a", False, width), ["_c", "s"])
            .join(_nearest(sky, asked, "e", "p_end", "b", True, width), ["_c", "e"]))
    before, after = F.coalesce(F.col("a.i"), F.lit(-1)), F.coalesce(F.col("b.i"), F.col("_top") + 1)
    near = cut(near.withColumn("lo", before + 1).withColumn("hi", after - 1))
    near = _longest_between(near, sky)

    inside = F.col("e") - F.col("s") + 1
    whole = F.coalesce(F.col("b.p_start") <= F.col("s"), F.lit(False))
    none = F.lit(0).cast("bigint")
    share = lambda overlap: F.greatest(F.coalesce(_percent(overlap), none), none)
    near = (near.withColumn("pa", share(F.col("a.p_end") - F.col("s") + 1)).withColumn("pm", share(F.col("m.n")))
            .withColumn("pb", share(F.col("e") - F.col("b.p_start") + 1))
            .withColumn("pct", F.when(whole, F.lit(100).cast("bigint")).otherwise(F.greatest("pa", "pm", "pb"))).where("pct > 0"))
    # The least overlap with this percentage; the first parent that has it wins.
    least = whole_div(F.col("pct") * inside + 99, F.lit(100).cast("bigint"))
    near = near.withColumn("t", least).withColumn("how", F.when(whole, "b").when(F.col("pa") == F.col("pct"), "a")
                                                  .when(F.col("pm") == F.col("pct"), "m").otherwise("b"))
    pick = lambda c: F.when(F.col("how") == "a", F.col(f"a.{c}")).when(F.col("how") == "m", F.col(f"m.{c}")).otherwise(F.col(f"b.{c}"))
    kept = ["_q", "_c", "bonus", "pct"]
    # Longer children may get one percentage from several overlaps.
    loose = F.when(F.col("how") == "a", F.col("a.p_end") > F.col("s") + F.col("t") - 1).when(F.col("how") == "m", F.col("m.n") > F.col("t")).otherwise(F.lit(False))
    near = cut(near.withColumn("_loose", loose))
    out = near.where("not _loose").select(*kept, pick("p_order").alias("p_order"), pick("p_id").alias("p_id")).select(*_BEST)
    open_ = near.where("_loose")
    if open_.isEmpty():
        return out
    earlier = open_.where("how = 'a'").drop("a", "b").withColumn("x", F.col("s") + F.col("t") - 1)
    earlier = earlier.join(_nearest(sky, earlier, "x", "p_end", "b", True, width), ["_c", "x"]).select(*kept, F.col("b.p_order").alias("p_order"), F.col("b.p_id").alias("p_id"))
    return out.unionByName(earlier.select(*_BEST)).unionByName(_first_between(open_.where("how = 'm'"), sky, kept).select(*_BEST))


def _levels(near: DataFrame) -> int:
    widest = near.agg(F.max(F.col("hi") - F.col("lo") + 1)).first()[0]
    return max(0, (widest or 0)).bit_length()


def _nodes(sky: DataFrame, levels: int) -> DataFrame:
    """Longest parent (the first of equals) of each group of 1, 2, 4, ... neighbours of the skyline."""
    length = F.col("p_end") - F.col("p_start") + 1
    longest = F.struct(length.alias("n"), (-F.col("i")).alias("first"), "p_order", "p_id")
    return (sky.select("_c", "i", longest.alias("v"), F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
            .groupBy("_c", "level", F.expr("shiftright(i, level)").alias("no")).agg(F.max("v").alias("v")))


def _cover(levels: int) -> Column:
    """Groups that together hold ``lo`` to ``hi``: at most two of each level."""
    empty = "cast(array() as array<struct<level:int,no:bigint>>)"
    return F.expr(f"""aggregate(sequence(0, {levels - 1}), named_struct('l', lo, 'r', hi + 1, 'x', {empty}), (s, k) -> if(s.l >= s.r, s, named_struct(
        'l', (s.l + 1) div 2, 'r', s.r div 2, 'x', concat(s.x, if(s.l % 2 = 1, array(named_struct('level', k, 'no', s.l)), {empty}),
        if(s.r % 2 = 1, array(named_struct('level', k, 'no', s.r - 1)), {empty}))))).x""")


def _longest_between(near: DataFrame, sky: DataFrame) -> DataFrame:
    """Adds ``m``, the longest parent with a number from ``lo`` to ``hi``, null if there is none."""
    kind = "struct<n:bigint,first:bigint,p_order:bigint,p_id:" + dict(sky.dtypes)["p_id"] + ">"
    levels = _levels(near)
    if not levels:
        return near.withColumn("m", F.lit(None).cast(kind))
    some = near.where("lo <= hi").select("_q", "_c", F.explode(_cover(levels)).alias("x")).select("_q", "_c", "x.level", "x.no")
    best = some.join(_nodes(sky, levels), ["_c", "level", "no"]).groupBy("_q", "_c").agg(F.max("v").alias("m"))
    return near.join(best, ["_q", "_c"], "left")


def _first_between(open_: DataFrame, sky: DataFrame, kept: list[str]) -> DataFrame:
    """The first parent from ``lo`` to ``hi`` that is at least ``t`` long: down from the first group that holds one."""
    levels = _levels(open_)
    if not levels:
        return open_.select(*kept, F.col("m.p_order").alias("p_order"), F.col("m.p_id").alias("p_id")).limit(0)
    nodes = cut(_nodes(sky, levels))
    long = lambda df: df.join(nodes, ["_c", "level", "no"]).where("v.n >= t")
    held = [*kept, "t"]
    start = long(open_.select(*held, F.explode(_cover(levels)).alias("x")).select(*held, "x.level", "x.no"))
    now = cut(start.groupBy(*held).agg(F.min(F.struct(F.expr("shiftleft(no, level)").alias("from"), "level", "no")).alias("x"))
              .select(*held, "x.level", "x.no"))
    done = now.where("level = 0")
    for _ in range(levels - 1):
        now = now.where("level > 0")
        if now.isEmpty():
            break
        kids = now.withColumn("level", F.col("level") - 1).withColumn("no", F.explode(F.array(F.col("no") * 2, F.col("no") * 2 + 1)))
        now = cut(long(kids).groupBy(*held, "level").agg(F.min("no").alias("no")))
        done = done.unionByName(now.where("level = 0").select(*done.columns))
    return done.join(sky.select("_c", F.col("i").alias("no"), "p_order", "p_id"), ["_c", "no"]).select(*kept, "p_order", "p_id")
