"""Relations between intervals of one source: overlap, parents, cuts, subsets, lanes."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmine.functions.rational import whole_div
from seqmine.operators.parents import assign_parent  # noqa: F401, part of this module's interface
from seqmine.plans.blocks import BLOCK_ROWS, BLOCK_WIDTH, Run, by_position, by_rows, null_safe_join, running, spread
from seqmine.plans.chains import first_after, reachable
from seqmine.plans.ranges import overlap_pairs
from seqmine.session import cut

SPLIT_THRESHOLD = 32
FEW_CUTS = 64
FOLD_LIMIT = 4096
LANE_BLOCK = 100_000


def overlap_join(a: DataFrame, b: DataFrame, on: Sequence[str], a_span: tuple[str, str],
                 b_span: tuple[str, str], **points: bool) -> DataFrame:
    """Overlapping pairs and the overlap in records; both ends are inclusive."""
    size = F.least(a_span[1], b_span[1]) - F.greatest(a_span[0], b_span[0]) + 1
    return overlap_pairs(a, b, on, a_span, b_span, **points).withColumn("overlap", size)


def flag_content(items: DataFrame, records: DataFrame, flags: dict[str, Column], *,
                 keys: Sequence[str] = ("src",), pos: str = "pos", width: int = BLOCK_WIDTH, size: int | None = None) -> DataFrame:
    """For each item and flag, whether a flagged record lies inside the item.

    An item holds one exactly if the first flagged record at or after its start is
    not past its end.  Flagged positions and item starts are put on one line and
    walked backwards once for all flags, so records and items are never paired.
    ``size``, about the number of records or items if these are more, bounds what a task holds.
    """
    keys = list(keys)
    wanted = None
    for test in flags.values():
        wanted = test if wanted is None else wanted | test
    tests = [test.alias(f"_is_{name}") for name, test in flags.items()]
    marked = spread(records.where(wanted).select(*keys, F.col(pos).alias("_at"), *tests), size, *keys, "_at")
    points = marked.groupBy(*keys, "_at").agg(*[F.bool_or(f"_is_{name}").alias(name) for name in flags])
    starts = spread(items.select(*keys, F.col("start").alias("_at"), F.lit(0).alias("_kind")), size, *keys, "_at").distinct()
    line = points.withColumn("_kind", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    cells, _ = by_position(line, keys, "_at", width)
    # Walked backwards, the last flagged position is the smallest.
    found = running(cells, Run(tuple(keys), ("_at", "_kind")), reverse=True, size=size,
                    mins={f"_next_{name}": F.when(F.col(name), F.col("_at")) for name in flags})
    nearest = found.where("_kind = 0").select(F.struct(*keys, F.col("_at").alias("start")).alias("_k"), *[f"_next_{n}" for n in flags])
    # A struct of the keys is never null, so null keys meet by plain equality.
    held = spread(items.withColumn("_k", F.struct(*keys, "start")), size, "_k").join(spread(nearest, size, "_k"), "_k")
    return held.select(*items.columns, *[F.coalesce(F.col(f"_next_{n}") <= F.col("end"), F.lit(False)).alias(n) for n in flags])


def boundary_violations(children: DataFrame, parents: DataFrame, sources: DataFrame, *,
                        src: str = "src") -> DataFrame:
    """Children reaching outside their parent, and items past the end of their source.

    ``children`` carry ``parent_id``; ``sources`` has one row per source with ``records``.
    """
    held = null_safe_join(children.where(F.col("parent_id").isNotNull()),
                          parents.select(src, F.col("p_id").alias("parent_id"), "p_start", "p_end"), [src, "parent_id"])
    outside = (held.where((F.col("c_start") < F.col("p_start")) | (F.col("c_end") > F.col("p_end")))
               .select(F.lit("outside parent").alias("fault"), src, "c_id", "c_start", "c_end"))
    past = (null_safe_join(children, sources.select(src, "records"), [src])
            .where(F.col("c_end") >= F.col("records"))
            .select(F.lit("past end").alias("fault"), src, "c_id", "c_start", "c_end"))
    return outside.unionByName(past)


def _second_start(start: Column, stride: Column, at: Column) -> Column:
    return at + stride - F.pmod(at - start - 1, stride) - 1


def _first_end(start: Column, stride: Column, at: Column) -> Column:
    return at - F.pmod(at - start - 1, stride) - 1


def split_intervals(audio: DataFrame, video: DataFrame, *, on: Sequence[str] = ("src",),
                    threshold: int = SPLIT_THRESHOLD, tail: int | None = None, offset: int = 0, width: int = BLOCK_WIDTH,
                    few: int = FEW_CUTS, size: int | None = None) -> DataFrame:
    """Cuts audio items at the starts of videos, in order of the starts.

    Audio has the ``on`` columns and ``id, start, end, stride`` with its end on the
    stride.  A piece is cut at ``start of video - offset`` if it begins more than
    ``threshold`` before the video and ends at least ``tail`` (by default the
    threshold) after the video's start.  Cut points snap to the stride.  Null ``on`` values are a source of their own.

    Where the piece after a cut begins, and so which cut is the next, depends only on the cut, the stride and the item's phase on
    it.  Items of one stride and phase share these next-cut pointers; each item finds its first cut and then takes 1, 2, 4, ... cuts a
    round by pointers that skip as many.  Items and cuts are never listed against each other.  A source with at most ``few`` cuts gives
    its items the list of them instead, with the same result.  ``size``, about the number of items or cuts if these are more, bounds what a
    task holds of many sources.
    """
    tail = threshold if tail is None else tail
    key = F.struct(*on).alias("_k")
    dealt = lambda df: spread(df, size, "_k")
    cuts = cut(dealt(video.select(key, F.col("start").cast("bigint").alias("point"))).distinct())
    sizes = dealt(cuts).groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    item = cut(dealt(audio.select(key, *on, "id", "stride", "start", "end")).join(sizes, "_k", "left"))
    lists = dealt(cuts).join(sizes.where(F.col("_n") <= few), "_k", "left_semi").groupBy("_k").agg(F.sort_array(F.collect_list("point")).alias("_cuts"))
    short = item.where(F.coalesce(F.col("_n") <= few, F.lit(True)))
    out = _split_by_list(dealt(short).join(lists, "_k", "left"), [*on, "id"], threshold, tail, offset)
    large = item.where(F.col("_n") > few)
    if large.isEmpty():
        return out
    return out.unionByName(_split_by_pointers(large, cuts, on, threshold, tail, offset, width))


def _split_by_list(item: DataFrame, key: Sequence[str], threshold: int, tail: int, offset: int) -> DataFrame:
    """Pieces of items whose source has a short list of cuts."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    at = lambda c: c - offset
    fold = F.aggregate(
        F.coalesce("_cuts", F.array().cast("array<bigint>")), F.struct(F.col("start").cast("bigint").alias("s"), empty.alias("done")),
        lambda acc, c: F.when(
            (acc["s"] < c - threshold) & (F.col("end") >= c + tail),
            F.struct(_second_start(acc["s"], F.col("stride"), at(c)).cast("bigint").alias("s"),
                     F.array_append(acc["done"], F.struct(acc["s"].alias("start"), _first_end(acc["s"], F.col("stride"), at(c))
                                                          .cast("bigint").alias("end"))).alias("done")))
        .otherwise(acc))
    last = F.struct(F.col("_f.s").alias("start"), F.col("end").cast("bigint").alias("end"))
    return (item.withColumn("_f", fold).withColumn("_piece", F.explode(F.array_append(F.col("_f.done"), last)))
            .select(*key, "stride", F.col("_piece.start").alias("start"), F.col("_piece.end").alias("end")))


def _split_by_pointers(item: DataFrame, cuts: DataFrame, on: Sequence[str], threshold: int, tail: int, offset: int, width: int) -> DataFrame:
    """Pieces of items whose source has many cuts."""
    item = item.drop("_n").withColumn("at", (F.col("start") + threshold).cast("bigint"))
    cuts = cuts.join(item.select("_k").distinct(), "_k", "left_semi")
    first = item.join(first_after(cuts, item, ["_k"], width=width), ["_k", "at"], "left")
    live = F.coalesce(F.col("next") <= F.col("end") - tail, F.lit(False))
    first = cut(first.withColumn("_live", live))
    kept = [*on, "id", "stride"]
    whole = first.where("not _live").select(*kept, "start", "end")
    rows = first.where("_live").withColumn("phase", F.pmod("start", "stride")).withColumn("hi", F.col("end") - tail)

    graph = ["_k", "stride", "phase"]
    begin = _second_start(F.col("phase"), F.col("stride"), F.col("node") - offset)
    last = lambda at: _first_end(F.col("phase"), F.col("stride"), F.col(at) - offset)
    shared = rows.groupBy(*graph).agg(F.min("next").alias("_lo"), F.max("hi").alias("_hi"))
    nodes = (shared.join(cuts, "_k").where("point between _lo and _hi").select(*graph, F.col("point").alias("node"), "_hi")
             .withColumn("begin", begin).withColumn("at", F.greatest(F.col("begin") + threshold, F.col("node"))))
    nodes = cut(nodes.join(first_after(cuts, nodes, ["_k"], width=width), ["_k", "at"], "left")
                .select(*graph, "node", "begin", F.when(F.col("next") <= F.col("_hi"), F.col("next")).alias("next")))

    found = cut(rows.select(*graph, *on, "id", "end", "hi", F.col("next").alias("node")))
    jump = nodes.where("next is not null").select(*graph, "node", "next")
    while not jump.isEmpty():
        step = cut(found.join(jump, [*graph, "node"]).where("next <= hi").drop("node").withColumnRenamed("next", "node"))
        if step.isEmpty():
            break
        found = found.unionByName(step)
        far = jump.select(*graph, F.col("node").alias("next"), F.col("next").alias("_far"))
        jump = cut(jump.join(far, [*graph, "next"]).select(*graph, "node", F.col("_far").alias("next")))
    opening = rows.select(*kept, "start", last("next").alias("end"))
    ends = F.when(F.col("next") <= F.col("hi"), last("next")).otherwise(F.col("end"))
    later = found.join(nodes, [*graph, "node"]).select(*kept, F.col("begin").alias("start"), ends.alias("end"))
    return whole.unionByName(opening).unionByName(later)


def mark_silent_pieces(pieces: DataFrame, sounding: DataFrame, *, src: str = "src",
                       width: int = BLOCK_WIDTH, size: int | None = None) -> DataFrame:
    """Whether a piece holds none of the item's sounding positions (``src, id, pos``).

    ``size``, about the number of positions or pieces if these are more, bounds what a task holds.
    """
    out = flag_content(pieces, sounding, {"_loud": F.lit(True)}, keys=(src, "id"), width=width, size=size)
    return out.withColumn("silent", ~F.col("_loud")).drop("_loud")


def drop_silent_orphans(items: DataFrame, parented: DataFrame, key: Sequence[str]) -> DataFrame:
    """Removes silent items without a row in ``parented`` (items that have a video parent)."""
    held = parented.select(*key).distinct().withColumn("_held", F.lit(True))
    return items.join(held, list(key), "left").where(~F.col("silent") | F.col("_held").isNotNull()).drop("_held")


def resolve_tree(nodes: DataFrame, *, src: str = "src", node: str = "node", parent: str = "parent",
                 name: str = "name", start: str = "start", size: str = "size",
                 correction: int = 0) -> DataFrame:
    """Full path, depth and record range of every node that hangs on a root.

    A root has a null parent.  Names ``.`` and ``..`` and nodes at extent 0 are
    skipped.  Every round doubles the distance a node looks up, so the depth of the
    tree costs its logarithm.  Nodes still unresolved when a round resolves nothing
    more are cycles or orphans and are left out.
    """
    usable = nodes.where(~F.col(name).isin(".", "..") & (F.col(start) != 0)).withColumn("_k", F.struct(src, node))
    up = F.when(F.col(parent).isNotNull(), F.struct(F.col(src), F.col(parent).alias(node)))
    done = (_paths(usable.select("_k", up.alias("_up"), F.col(name).alias("_path")), "_k", "_up", "_path")
            .select("_k", F.col("_path").alias("path"), F.col("_depth").alias("depth")))
    records = F.greatest(F.ceil(F.col(size) / 2048), F.lit(1))
    return (usable.join(done, "_k").drop("_k")
            .withColumn(start, F.col(start) + correction)
            .withColumn("end", F.col(start) + records - 1))


def _paths(links: DataFrame, node: str, up: str, path: str) -> DataFrame:
    """``node``, ``path`` from its root and ``_depth`` of all nodes that hang on one; ``up`` is null in a root.

    Nodes are structs of their keys, which are never null, so sources with a null name are joined by plain equality.
    """
    state = cut(links.select(F.col(node).alias("_n"), F.col(up).alias("_up"), F.col(path).alias("_path"), F.lit(1).cast("bigint").alias("_depth")))
    open_before = -1
    while True:
        left = state.where(F.col("_up").isNotNull()).count()
        if left == 0 or left == open_before:
            break
        open_before = left
        above = state.select(F.col("_n").alias("_up"), F.col("_up").alias("_far"),
                             F.col("_path").alias("_above"), F.col("_depth").alias("_more"))
        hop = state.where(F.col("_up").isNotNull()).join(above, "_up").select(
            "_n", F.col("_far").alias("_up"), F.concat_ws("/", "_above", "_path").alias("_path"),
            (F.col("_depth") + F.col("_more")).alias("_depth"))
        state = cut(state.where(F.col("_up").isNull()).unionByName(hop))
    return state.where(F.col("_up").isNull()).select(F.col("_n").alias(node), F.col("_path").alias(path), "_depth")


def resolve_extents(entries: DataFrame, *, src: str = "src", node: str = "node", record: str = "record", name: str = "name",
                    start: str = "start", size: str = "size", folder: str = "folder", correction: int = 0,
                    last_position: int = (1 << 31) - 1) -> DataFrame:
    """Paths and record ranges of a tree whose folders name no children, only the records that list them.

    An entry stands in ``record``, and belongs to the folder whose range holds that record: the whole 2048-byte records of its ``size`` from
    ``start`` plus ``correction`` on.  A root stands in no record; its name is in no path.  Where folders overlap, an entry belongs to the one
    that starts last, then to the smallest node.  ``.``, ``..`` and folders at 0 or without a whole record are skipped, so is what hangs on
    no root or on a cycle.  A file without bytes still takes one record.  A file that reaches past ``last_position`` is reported with
    ``fault`` and has no ``end``.  Null keys are a source of their own.
    """
    at, records = F.col(start) + correction, F.ceil(F.col(size) / 2048).cast("bigint")
    root = F.col(record).isNull()
    usable = entries.where((root | ~F.col(name).isin(".", "..")) & (~F.col(folder) | ((F.col(start) != 0) & (F.col(size) >= 2048))))
    usable = cut(usable.withColumn("_s", F.struct(src)).withColumn("_k", F.struct(src, node)))
    folders = usable.where(folder).select("_s", F.col("_k").alias("_up"), at.alias("_first"), (at + F.floor(F.col(size) / 2048) - 1).alias("_last"))
    places = usable.where(~root).select("_s", F.col(record).alias("_at")).distinct()
    held = overlap_pairs(places, folders, ["_s"], ("_at", "_at"), ("_first", "_last"), a_points=True)
    # The latest start first, then the smallest node.
    owner = held.groupBy("_s", "_at").agg(F.min(F.struct((-F.col("_first")).alias("f"), F.col("_up").alias("u"))).alias("_o"))
    linked = (usable.where(~root).join(owner, (usable["_s"] == owner["_s"]) & (F.col(record) == F.col("_at"))).drop(owner["_s"])
              .select("_k", F.col("_o.u").alias("_up"), F.col(name).alias("_path")))
    tops = usable.where(root).select("_k", F.lit(None).cast(linked.schema["_up"].dataType).alias("_up"), F.lit("").alias("_path"))
    paths = (_paths(linked.unionByName(tops), "_k", "_up", "_path")
             .select("_k", F.regexp_replace("_path", "^/", "").alias("path"), (F.col("_depth") - 1).alias("depth")))
    out = usable.join(paths, "_k").drop("_k", "_s")
    impossible = ~F.col(folder) & ((F.col(start) > last_position) | (records > last_position) | (F.col(start) + records > last_position))
    return (out.withColumn("fault", F.when(impossible, "impossible size"))
            .withColumn("end", F.when(F.col("fault").isNull(), at + F.greatest(records, F.lit(1)) - 1))
            .withColumn(start, at))


def resolve_parents_by_id(items: DataFrame, *, path: str = "path", tree: str = "tree") -> DataFrame:
    """Parent of each item: same path and the id array without its last element."""
    up = F.slice(F.col(tree), 1, F.greatest(F.size(tree) - 1, F.lit(0)))
    ids = items.select(F.col(path), F.col(tree).alias("parent_tree"), F.lit(True).alias("has_parent"))
    return (items.withColumn("parent_tree", up).join(ids, [path, "parent_tree"], "left")
            .withColumn("parent_tree", F.when(F.col("has_parent"), F.col("parent_tree")))
            .withColumn("has_parent", F.coalesce(F.col("has_parent"), F.lit(False))))


def consensus(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The value if all known children agree, else null."""
    agreed = F.when(F.min(value) == F.max(value), F.min(value))
    return df.groupBy(*keys).agg(agreed.alias(value), F.count(F.lit(1)).alias("children"))


def longest_disjoint(items: DataFrame, *, parent: Sequence[str] = ("parent",), fmt: str = "fmt",
                     past: str = "past", fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Per parent, the format whose earliest-finishing compatible streams are longest.

    Items have ``parent, id, start, end, fmt`` and ``past``, the positions a stream
    occupies beyond its end (stride - 1).  Of streams ending at the same position
    only the first in item order counts.  Ties between formats go to the one whose
    first stream comes first.  Returns the chosen streams.

    Groups of up to ``fold_limit`` streams are folded as one array, larger ones
    follow pointers to the next compatible stream over distributed rows.
    """
    parent = list(parent)
    # Structs of the keys are never null, so groups with null keys are joined by plain equality.
    items = items.select(F.struct(*parent).alias("_g"), F.struct(*parent, fmt).alias("_k"), "id", "start", "end", past)
    keys = ["_k"]
    once = (items.groupBy("_g", "_k", "end").agg(F.min(F.struct("start", "id", past)).alias("_i"))
            .select("_g", "_k", "end", "_i.start", "_i.id", F.col(f"_i.{past}").alias("past")))
    once = cut(once)
    sizes = cut(once.groupBy("_g", "_k").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("start", "id")).alias("_first")))
    small = once.join(sizes.where(F.col("_n") <= fold_limit).select("_k"), "_k")
    id_type = items.schema["id"].dataType.simpleString()
    picked_type = f"struct<end:bigint,start:bigint,id:{id_type}>"
    state = F.struct(F.lit(None).cast("bigint").alias("upto"), F.array().cast(f"array<{picked_type}>").alias("picked"))
    fold = F.aggregate(
        F.array_sort("_all"), state,
        lambda acc, x: F.when(
            acc["upto"].isNull() | (x["start"] > acc["upto"]),
            F.struct((x["end"] + x["past"]).alias("upto"),
                     F.array_append(acc["picked"], F.struct(x["end"], x["start"], x["id"])
                                    .cast(picked_type)).alias("picked")))
        .otherwise(acc))
    row = F.struct(F.col("end").cast("bigint").alias("end"), F.col("start").cast("bigint").alias("start"),
                   F.col("id"), F.col("past").cast("bigint").alias("past"))
    picked = (small.groupBy("_k").agg(F.collect_list(row).alias("_all"))
              .withColumn("_p", F.explode(fold["picked"]))
              .select("_k", F.col("_p.start").alias("start"), F.col("_p.end").alias("end"), F.col("_p.id").alias("id")))
    large = sizes.where(F.col("_n") > fold_limit)
    if not large.isEmpty():
        picked = picked.unionByName(_disjoint_by_pointers(once.drop("_g").join(large.select("_k"), "_k"), keys))
    picked = cut(picked)
    total = (picked.groupBy("_k").agg(F.sum(F.col("end") - F.col("start") + 1).alias("_len")).join(sizes, "_k")
             .groupBy("_g").agg(F.min_by("_k", F.struct((-F.col("_len")).alias("l"), F.col("_first.start").alias("s"),
                                                         F.col("_first.id").alias("i"))).alias("_k")).select("_k"))
    return picked.join(total, "_k").select(*[F.col("_k")[c].alias(c) for c in (*parent, fmt)], "start", "end", "id")


def _disjoint_by_pointers(once: DataFrame, keys: list[str]) -> DataFrame:
    """The same choice for groups of any size."""
    rows = once.withColumn("_neg", -F.col("end"))
    cells, _ = by_position(rows, keys, "start")
    rows = running(cells, Run(tuple(keys), ("start", "_neg")), mins={"_inner": F.col("end")},
                   reverse=True, exclusive=True)
    # A stream that contains a later-starting, earlier-ending one is never chosen.
    rows = cut(rows.where(F.col("_inner").isNull() | (F.col("_inner") >= F.col("end")))
               .drop("_neg", "_inner", "blk").withColumn("at", F.col("end") + F.col("past")))
    follow = first_after(rows.select(*keys, F.col("start").alias("point")), rows, keys)
    first = rows.groupBy(*keys).agg(F.min("start").alias("_first"))
    graph = (rows.join(follow, [*keys, "at"], "left").join(first, keys)
             .select(*keys, F.col("start").alias("node"), "next",
                     (F.col("start") == F.col("_first")).alias("root")))
    chosen = reachable(graph, keys).withColumnRenamed("node", "start")
    return rows.join(chosen, [*keys, "start"]).select(*keys, "start", "end", "id")


def open_counts(items: DataFrame, *, keys: Sequence[str] = ("src",), width: int = BLOCK_WIDTH) -> DataFrame:
    """Number of open intervals from each position where it changes."""
    steps = (items.select(*keys, F.explode(F.array(
        F.struct(F.col("start").alias("pos"), F.lit(1).cast("bigint").alias("d")),
        F.struct((F.col("end") + 1).alias("pos"), F.lit(-1).cast("bigint").alias("d")))).alias("_e"))
        .groupBy(*keys, F.col("_e.pos").alias("pos")).agg(F.sum("_e.d").alias("_d")).where("_d <> 0"))
    cells, run = by_position(steps, keys, "pos", width)
    return running(cells, run, sums={"open": F.col("_d")}).select(*keys, "pos", "open")


def max_overlap(items: DataFrame, *, keys: Sequence[str] = ("src",), width: int = BLOCK_WIDTH) -> DataFrame:
    """Largest number of intervals open at one point."""
    return open_counts(items, keys=keys, width=width).groupBy(*keys).agg(F.max("open").alias("max_open"))


def assign_lanes(items: DataFrame, *, src: str = "src", order: Sequence[str] = ("start", "id"),
                 width: int = BLOCK_WIDTH, block: int = LANE_BLOCK) -> DataFrame:
    """Lowest free lane for each interval in start order.

    A lane is busy through the end position of its item.  Where no interval is open
    all lanes are free, so each connected stretch of intervals is placed on its own;
    a stretch longer than ``block`` items is placed block by block, handing on only
    the intervals still open.
    """
    cells, _ = by_position(items.select(src, "id", "start", "end"), [src], "start", width)
    run = Run((src,), tuple(order))
    rows = running(cells, run, sums={"_i": F.lit(1).cast("bigint")}, maxes={"_reach": F.col("end")}, exclusive=True)
    opens = F.col("_reach").isNull() | (F.col("start") > F.col("_reach"))
    rows = running(rows, run, maxes={"_stretch": F.when(opens, F.col("_i"))})
    rows = cut(rows.select(src, "id", "start", "end", "_stretch", "_i",
                           whole_div(F.col("_i") - F.col("_stretch"), F.lit(block).cast("bigint")).alias("_b"),
                           F.lit(-1).cast("bigint").alias("lane")))
    last = rows.agg(F.max("_b")).first()[0]
    kind = dict(items.dtypes)
    schema = (f"{src} {kind[src]}, id {kind['id']}, start bigint, end bigint, _stretch bigint, _i bigint, "
              f"_b bigint, lane bigint")
    done, held = [], None
    for b in range((last if last is not None else -1) + 1):
        batch = rows.where(F.col("_b") == b)
        if held is not None:
            batch = batch.unionByName(held)
        placed = (batch.repartition(src, "_stretch").sortWithinPartitions(src, "_stretch", "_i")
                  .mapInPandas(lambda batches: _place(batches, src), schema))
        if last == 0:
            return placed.select(src, "id", "start", "end", "lane")
        placed = cut(placed)
        done.append(placed.where(F.col("_b") == b))
        more = rows.where(F.col("_b") == b + 1).groupBy(src, "_stretch").agg(F.min("start").alias("_from"))
        held = (placed.join(more, [src, "_stretch"]).where(F.col("end") >= F.col("_from"))
                .withColumn("_b", F.lit(-1).cast("bigint")).drop("_from"))
    if not done:
        return rows.select(src, "id", "start", "end", "lane")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(src, "id", "start", "end", "lane")


def _place(batches: Iterator[pd.DataFrame], src: str) -> Iterator[pd.DataFrame]:
    """Lanes for rows sorted by stretch and number; only the open intervals are kept.

    Rows that already have a lane are the open intervals of the block before.
    """
    current, busy, free, used = None, [], [], 0
    for pdf in batches:
        lanes = pdf["lane"].to_numpy(copy=True)
        rows = zip(pdf[src], pdf["_stretch"], pdf["start"], pdf["end"], pdf["lane"])
        for i, (source, stretch, start, end, lane) in enumerate(rows):
            if (source, stretch) != current:
                current, busy, free, used = (source, stretch), [], [], 0
            if lane >= 0:
                # Lanes below this one that no open interval holds are free.
                heapq.heappush(busy, (end, lane))
                for unheld in range(used, lane):
                    heapq.heappush(free, unheld)
                if lane < used:
                    free.remove(lane)
                    heapq.heapify(free)
                used = max(used, lane + 1)
                continue
            while busy and busy[0][0] < start:
                heapq.heappush(free, heapq.heappop(busy)[1])
            if free:
                lane = heapq.heappop(free)
            else:
                lane, used = used, used + 1
            lanes[i] = lane
            heapq.heappush(busy, (end, lane))
        yield pdf.assign(lane=lanes)


def require_single(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of sources that have exactly one descriptor; none or several give nothing."""
    single = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(*keys)
    return df.join(single, list(keys), "left_semi")
