"""Next-pointers: finding them with one sort, following them in few joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmine.plans.blocks import BLOCK_WIDTH, Run, by_position, running
from seqmine.session import cut


def reachable(nodes: DataFrame, keys: Sequence[str], node: str = "node", nxt: str = "next",
              root: str = "root") -> DataFrame:
    """Nodes on the chains that start at rows with ``root`` true.

    Pointers must move strictly forward.  After round k the result holds the first
    2^k nodes of each chain, and every pointer skips 2^k nodes, so a chain of n
    nodes takes about log2(n) rounds however long it is.
    """
    keys = list(keys)
    jump = cut(nodes.where(F.col(nxt).isNotNull()).select(*keys, node, nxt))
    found = cut(nodes.where(F.col(root)).select(*keys, node).distinct())
    while True:
        step = cut(found.join(jump, [*keys, node]).select(*keys, F.col(nxt).alias(node)).distinct())
        if step.isEmpty():
            return found
        found = cut(found.union(step))
        far = jump.select(*keys, F.col(node).alias(nxt), F.col(nxt).alias("_far"))
        jump = cut(jump.join(far, [*keys, nxt]).select(*keys, node, F.col("_far").alias(nxt)))


def first_after(points: DataFrame, queries: DataFrame, keys: Sequence[str], *, point: str = "point",
                at: str = "at", width: int = BLOCK_WIDTH) -> DataFrame:
    """For each distinct query value, the smallest point strictly greater in the same keys.

    Points and queries are put on one line and walked backwards, so the cost is a
    sort and no pairs are formed.  Returns ``keys``, ``at`` and ``next``.
    """
    keys = list(keys)
    line = (points.select(*keys, F.col(point).alias("_at"), F.lit(0).alias("_kind")).distinct()
            .unionByName(queries.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind")).distinct()))
    cells, _ = by_position(line, keys, "_at", width)
    found = running(cells, Run(tuple(keys), ("_at", "_kind")), reverse=True,
                    lasts={"next": F.when(F.col("_kind") == 0, F.col("_at"))})
    return found.where(F.col("_kind") == 1).select(*keys, F.col("_at").alias(at), "next")
