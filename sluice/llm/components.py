"""Connected components of an edge table, by alternating large and small stars, with DataFrame functions only.

Each half-step takes every node's least neighbour by a grouped minimum (summed up in parts), and joins it back to the edges.
Both sides of that join are plain exchanges over written tables, so that a node with very many edges can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import common


def _least(edges: DataFrame) -> DataFrame:
    return common.written(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "cc-least")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    out = both.where("b > a").join(_least(both), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return common.written(out.where("a <> b").distinct(), "cc-large")


def _small_star(edges: DataFrame) -> DataFrame:
    """Links every smaller neighbour of a node, and the node, to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return common.written(out.where("a <> b").distinct(), "cc-small")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each node's component, for nodes that have an edge. edges: a, b (long)."""
    edges = common.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    mark = None
    while True:
        # A star forest is the fixed point: every node has one edge, which leads to a node that has none above it.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == mark:
            break
        mark = now
        edges = _small_star(_large_star(edges))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
