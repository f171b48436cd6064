"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmine.llm.storage import written


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for each node of ``edges`` (longs ``a``, ``b``).

    Rounds of two steps, each a minimum per node and a join back: the large step ties a node's larger neighbours to its
    smallest neighbour, the small step its smaller ones.  Rounds end when the edges are stars, which one aggregate by
    node tells; their number grows with the logarithm of a component's diameter.  Each round's edges are a written table.
    Minima combine before the shuffle and joins are left to adaptive execution, so a node with very many neighbours is
    no single task's work.
    """
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(tied.unionByName(low.withColumnRenamed("m", "v")).distinct(), "edges")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each upper end ``u`` has one lower end ``v`` that is no upper end itself."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.max((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1)))).first()[0]
