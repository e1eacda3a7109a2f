"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlens.llm.common import checkpoint

#: Edges that a task writes, at least, where there are few.
EDGES = 100_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b: neighbours move to the smallest node that their node sees.

    A hub's neighbours, rows of two numbers, stream through a sort-merge join, which adaptive execution splits where it is skewed."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    near = both.join(least, "a")
    if large:
        moved = near.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = near.filter(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("least").alias("b")))
    return moved.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b), any order, to (node, root): the smallest node reachable, for every node with a link to another one."""
    edges = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = checkpoint(edges)
    parts = edges.sparkSession.sparkContext.defaultParallelism
    # equal edge sets have equal sums; a star forest maps to itself
    state = lambda: tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    last = state()
    while last[0]:
        # a step has no more edges than the one before has twice, so a small table is written in few files
        few = max(parts, -(-2 * last[0] // EDGES))
        edges = checkpoint(_star(_star(edges, True), False).coalesce(few))
        now = state()
        if now == last:
            break
        last = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
