"""Merkle manifest of a table: a tree per source, a tree over the sources' roots, and a proof per row by pointer jumping.

Digests are SHA-256 over the hex text of the digests below.  Levels are built bottom up, one grouping per level, each a third of the one
before; a group (a *run*) holds at most ``fanout`` digests.  Sources with one node left stop; their last nodes, in order of
the sources, are the leaves of the upper tree.

Proofs: every node above the leaves starts with a pointer to its parent and one segment, its own place in its run and its siblings.  A round
joins the nodes with themselves: a node takes over its ancestor's segments behind its own and the pointer of the ancestor, so the distance
doubles and all nodes hold all siblings up to the root after about log2(height) rounds.  Nodes whose level no other node can point to in later
rounds are left out of those.  A run of leaves then takes its parent's segments, and each leaf sets its own before them.
An ancestor's rows are either many (then few rows meet each) or few enough to be broadcast after counting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmine.llm.ranks import ranked
from seqmine.llm.storage import BROADCAST_ROWS, small_side, written

FANOUT = 3
#: Tree number of the upper tree; sources are numbered from 0.
UPPER = -1
_PATH = "array<struct<place:int,others:array<binary>>>"


def digest(value: Column) -> Column:
    """Bytes of the SHA-256 of a string."""
    return F.unhex(F.sha2(value.cast("binary"), 256))


def spelled(columns: Sequence[Column]) -> Column:
    """One string of all values: ``-`` for null, else UTF-8 byte count, colon, value."""
    one = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in one])


def _hexed(binaries: Column) -> Column:
    return F.array_join(F.transform(binaries, lambda b: F.lower(F.hex(b))), "")


def leaves(rows: DataFrame, order: Sequence[str], group: str, leaf: str = "leaf") -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``tree`` (number of the group, null first) and ``idx`` (place in it), and the table of trees with their size.

    Places follow ``order``, nulls first, then the leaf's digest; only wholly equal rows are left to chance.
    """
    placed = ranked(rows, [F.asc_nulls_first(group), *[F.asc_nulls_first(c) for c in order], F.asc(leaf)], "rank")
    placed = placed.withColumn("_g", F.struct(F.col(group).alias("v")))
    trees = placed.groupBy("_g").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("size"))
    trees = written(ranked(trees, [F.col("first").asc()], "tree"), "trees")
    out = placed.join(small_side(trees), "_g").withColumn("idx", F.col("rank") - F.col("first"))
    return out.drop("_g", "rank", "first"), trees.select("tree", "size")


def build(level: DataFrame, fanout: int = FANOUT, name: str = "runs") -> tuple[list[DataFrame], DataFrame]:
    """Runs of every level, and the last node of each tree (``tree``, ``hash``).

    ``level`` has ``tree``, ``size`` (nodes of its tree here), ``idx`` and ``hash``.  A run has ``tree``, ``level``, ``g`` (its parent's
    place), ``size``, ``kids`` and ``hash``, the parent's digest.
    """
    runs, tops, depth = [], None, 0
    while True:
        done = level.where("size = 1").select("tree", "hash")
        tops = done if tops is None else tops.unionByName(done)
        many = level.where("size > 1")
        if many.isEmpty():
            return runs, written(tops, f"{name}-tops")
        g = F.floor(F.col("idx") / fanout).cast("long")
        made = (many.groupBy("tree", "size", g.alias("g")).agg(F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("k"))
                .select("tree", F.lit(depth).alias("level"), "g", "size", F.col("k.hash").alias("kids")))
        made = written(made.withColumn("hash", digest(_hexed(F.col("kids")))), f"{name}-{depth}")
        runs.append(made)
        level = made.select("tree", F.ceil(F.col("size") / fanout).cast("long").alias("size"), F.col("g").alias("idx"), "hash")
        depth += 1


def _others(place: Column) -> Column:
    """The kids of a run without the one at ``place``."""
    return F.filter("kids", lambda k, i: i != place)


def _parent(upper: bool, fanout: int) -> Column:
    """Name of the node that a run becomes: the last node of a source is the upper tree's leaf with its number, the root has none."""
    own = F.struct("tree", (F.col("level") + 1).alias("level"), F.col("g").alias("idx"))
    return F.when(F.col("size") > fanout, own).otherwise(F.lit(None) if upper else _top(F.col("tree")))


def _top(tree: Column) -> Column:
    return F.struct(F.lit(UPPER).cast("long").alias("tree"), F.lit(0).alias("level"), tree.alias("idx"))


def _nodes(runs: DataFrame, upper: bool, fanout: int) -> DataFrame:
    """The kids of runs as nodes: name, level, pointer, one segment."""
    return (runs.select("*", F.posexplode("kids").alias("p", "_k"))
            .select(F.struct("tree", "level", (F.col("g") * fanout + F.col("p")).cast("long").alias("idx")).alias("node"),
                    (F.lit(None).cast("int") if upper else F.col("level")).alias("level"), _parent(upper, fanout).alias("up"),
                    F.array(F.struct(F.col("p").alias("place"), _others(F.col("p")).alias("others"))).cast(_PATH).alias("path")))


def jump(nodes: DataFrame) -> DataFrame:
    """``node`` and ``path``, its segments up to the root, for nodes of level 1 and of the upper tree, by self-joins that double the distance.

    ``up`` is null at the root.  ``level`` is null for nodes that any level may point to; of the others only those a multiple of the
    distance above level 1 go on, as level 1 can only land on these.
    """
    now, distance = written(nodes, "pointers"), 1
    while not now.where("up is not null").isEmpty():
        now = now.where(F.col("level").isNull() | ((F.col("level") - 1) % distance == 0))
        ahead = now.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        # A segment is about a hundred bytes.
        if ahead.count() * distance <= BROADCAST_ROWS:
            ahead = F.broadcast(ahead)
        moved = now.join(ahead, "up", "left").select("node", "level", F.col("_up").alias("up"), F.when(
            F.col("up").isNull(), F.col("path")).otherwise(F.concat("path", "_path")).alias("path"))
        now, distance = written(moved, "pointers"), 2 * distance
    return now.select("node", "path")


def folded(leaf: Column, path: Column) -> Column:
    """Hex digest of the root that a leaf (bytes) and its proof give."""
    hexed = lambda b: F.lower(F.hex(b))
    return F.aggregate(path, hexed(leaf), lambda acc, s: F.sha2(F.concat(
        _hexed(F.slice(s["others"], 1, s["place"])), acc,
        _hexed(F.slice(s["others"], s["place"] + 1, F.greatest(F.size(s["others"]), F.lit(1))))).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """Hex digest of all siblings of a proof, from the leaf to the root."""
    return F.sha2(_hexed(F.flatten(F.transform(path, lambda s: s["others"]))).cast("binary"), 256)


def manifest(docs: DataFrame, *, key: str = "doc_id", group: str = "source",
             columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), fanout: int = FANOUT,
             more: Sequence[Column] = ()) -> DataFrame:
    """Per row ``key``, ``group``, ``more`` (named expressions over ``docs``), ``leaf``, ``subroot``, ``root`` (bytes) and ``path``, its proof.

    A leaf is the digest of ``columns``.  Null groups are a group of their own, the first; null keys come first in a group, equal keys
    are ordered by their leaf, and wholly equal rows are leaves side by side.  A path is a list of steps towards the root, each with the
    node's place in its run and the run's other digests.  A lone row is its group's root; a lone group's root is the root.
    Other columns are not read; names do not clash, as results are built from ``key``, ``group`` and ``more`` only.  An empty
    table gives no rows.
    """
    rows = docs.select(F.col(key).alias("m_key"), F.col(group).alias("m_group"), F.struct(*more).alias("m_more") if more else F.lit(0).alias("m_more"),
                       digest(spelled([F.col(c) for c in columns])).alias("leaf"))
    placed, trees = leaves(rows, ["m_key"], "m_group")
    placed = written(placed, "leaves")
    runs, tops = build(placed.select("tree", "size", "idx", F.col("leaf").alias("hash")), fanout)
    n = trees.count()
    first = tops.select(F.lit(UPPER).cast("long").alias("tree"), F.lit(n).cast("long").alias("size"), F.col("tree").alias("idx"), "hash")
    upper, root = build(first, fanout, "upper")

    nodes = first.where("size = 1").select(_top(F.col("idx")).alias("node"), F.lit(None).cast("int").alias("level"),
                                           F.lit(None).cast("struct<tree:bigint,level:int,idx:bigint>").alias("up"),
                                           F.array().cast(_PATH).alias("path"))
    for made, above in [*[(r, False) for r in runs[1:]], *[(r, True) for r in upper]]:
        nodes = nodes.unionByName(_nodes(made, above, fanout))
    paths = written(jump(nodes), "paths")
    whole = written(tops.withColumn("node", _top(F.col("tree"))).join(paths, "node").select(
        "tree", F.col("hash").alias("subroot"), F.col("path").alias("_top_path")), "tops")
    found = placed.join(small_side(whole, n * (len(upper) + 1)), "tree")  # a row grows with the height of the upper tree
    if runs:
        low = runs[0].withColumn("node", _parent(False, fanout)).join(paths, "node").select("tree", F.col("g").alias("_g"), "kids", "path")
        found = found.withColumn("_g", F.floor(F.col("idx") / fanout).cast("long")).join(low, ["tree", "_g"], "left")
        place = (F.col("idx") % fanout).cast("int")
        own = F.array(F.struct(place.alias("place"), _others(place).alias("others"))).cast(_PATH)
        path = F.when(F.col("kids").isNull(), F.col("_top_path")).otherwise(F.concat(own, F.col("path")))
    else:
        path = F.col("_top_path")
    top = root.first()
    names = [f for f in placed.schema["m_more"].dataType.names] if more else []
    return found.select(F.col("m_key").alias(key), F.col("m_group").alias(group), *[F.col("m_more")[c].alias(c) for c in names],
                        "leaf", "subroot", F.lit(None if top is None else bytes(top["hash"])).cast("binary").alias("root"),
                        path.alias("path"))
