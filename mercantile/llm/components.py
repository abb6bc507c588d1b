"""Connected components of a graph given by its edges, as Spark jobs.

Alternates two steps until every component is a star around its smallest node: every node hands its larger neighbours to its
smallest one, then its smaller neighbours. The number of rounds grows with the logarithm of a component's longest path. Minima
are combined before the shuffle, so a node with very many neighbours costs one row per task. Each step is stored in the shared
folder, and repeats are dropped once a round: the first step makes no more rows than there are edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercantile.sources.scratch import Scratch


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (u, v) with the smallest of what their ``u`` knows."""
    return edges.join(least.withColumnRenamed("u", "of"), F.col("u") == F.col("of"))


def _settled(edges: DataFrame) -> bool:
    """Whether every larger node ``b`` of distinct edges has one smaller node, and is nobody's smaller node."""
    ends = edges.select(F.col("b").alias("u"), F.lit(1).alias("over"), F.lit(0).alias("under"))
    ends = ends.unionByName(edges.select(F.col("a").alias("u"), F.lit(0).alias("over"), F.lit(1).alias("under")))
    of_node = ends.groupBy("u").agg(F.sum("over").alias("over"), F.max("under").alias("under"))
    return not of_node.agg(F.max(F.expr("over > 0 AND over + under > 1"))).first()[0]


def star_forest(edges: DataFrame, store: Scratch) -> DataFrame:
    """(a, b) of every node b that is not the smallest of its component: a is the smallest. The edges (a, b) of longs are
    read several times, so they should be stored."""
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = edges.select(low, high).where("a < b")
    while True:
        up, down = edges.select(F.col("a").alias("u"), F.col("b").alias("v")), edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = up.unionByName(down).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
        large = store.store(_with_least(up, least).select(F.col("least").alias("a"), F.col("v").alias("b")), "large")
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("least"))
        # The smallest one itself is handed the node in the middle.
        other = F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v"))
        edges = store.store(_with_least(down, least).select(F.col("least").alias("a"), other.alias("b")).distinct(), "edges")
        if _settled(edges):
            return edges


def connected_components(edges: DataFrame, store: Scratch) -> DataFrame:
    """(node, root) of every node that an edge (a, b) of longs names; root is the smallest node of its component."""
    forest = star_forest(edges, store)
    return forest.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(forest.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
