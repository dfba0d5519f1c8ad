"""Connected components of an edge table, by alternating star steps.

Each step replaces a node's edges by edges to its smallest neighbour (first
for larger neighbours, then for smaller ones); the edges end as stars around
each component's smallest node after O(log^2 n) rounds.  Every step is a
grouped minimum and a join, so a node with very many edges is pre-aggregated
and, in the join, dealt over several tasks; rounds are written to the shared
checkpoint folder.  Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import stored
from tillbook.operators.skew import join_per_key


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (join_per_key(both.filter("b > a"), least, ["a"], "inner")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = join_per_key(down, least, ["a"], "inner")
    return (joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
            .union(least.select("a", F.col("m").alias("b"))).distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of
    ``edges`` (columns ``a``, ``b`` of one orderable type; loops and repeated
    edges are fine; an empty table gives no rows)."""
    first = stored(edges.select("a", "b").distinct(), "edges")
    nodes = first.select(F.col("a").alias("node")).union(first.select(F.col("b").alias("node"))).distinct()
    now = first.filter("a != b")
    before = None
    while True:
        now = stored(_small_star(_large_star(now)), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return (nodes.join(now, nodes.node == now.a, "left")
            .select("node", F.coalesce("b", "node").alias("component")))
