"""Connected components, closures of trees and shortest paths by iterated joins."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder that the cluster names in spark.checkpoint.dir; only where none is set (tests), in one of our own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if sc.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes (id) and links (a, b) to (id, cluster): the smallest id reachable. Rounds are logarithmic in a chain's length.

    A round lets every node's neighbours point at the smallest id the node sees, first the smaller neighbours, which leaves few of many
    links between the same nodes, then the larger; a node's minimum is taken with partial sums, so a hub costs a join's skew handling
    and no grouped list of its neighbours. Done when all is stars: no node has two smaller neighbours, or both a smaller and a larger."""
    edges, done = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False
    while not done:
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        edges = edges.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).union(least).distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("b"), "least")
        edges = cut(edges.join(least, "b", "left").select("a", F.coalesce("least", "b").alias("b")).distinct())
        ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)).distinct())
        done = ends.groupBy("id").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).filter("ups > 0 and n > 1").isEmpty()
    return nodes.join(edges.select(F.col("a").alias("id"), F.col("b").alias("_root")), "id", "left").select("id", F.coalesce("_root", "id").alias("cluster"))


def top_parents(tree: DataFrame, stops: Column) -> DataFrame:
    """tree (id, parent_id, ...) to (id, top_id): the parent's parent and so on, to the top of trees of any depth. ``stops`` holds for
    nodes that are tops of their own, and so is a node whose parent isn't in the tree. Nodes on a cycle, or below one, have no top (null).

    Every round doubles the way that is known, so nodes of each depth get there sooner or later; once a round brings no node to its
    top, the others never get there."""
    own = tree.select("id", F.when(stops, F.lit(None)).otherwise(F.col("parent_id")).alias("up"))
    up = own.join(tree.select(F.col("id").alias("up")).distinct().withColumn("_in", F.lit(True)), "up", "left").withColumn("up", F.when(F.col("_in"), F.col("up")))
    found = cut(up.select("id", F.coalesce("up", "id").alias("top_id"), F.col("up").isNull().alias("done")))
    left = found.filter("not done").count()
    while left:
        further = found.select(F.col("id").alias("top_id"), F.col("top_id").alias("_next"), F.col("done").alias("_there"))
        found = cut(found.join(further, "top_id").select("id", F.col("_next").alias("top_id"), F.col("_there").alias("done")))
        now = found.filter("not done").count()
        if now == left:
            break
        left = now
    return found.select("id", F.when(F.col("done"), F.col("top_id")).alias("top_id"))


def shortest_paths(edges: DataFrame, roots: DataFrame, most: int = 40) -> DataFrame:
    """edges (src, dst), roots (id) to (id, depth, path): the path from a root with the fewest steps, of several the smallest.

    A step joins the frontier with the edges; nodes once reached leave, so cycles end."""
    reached = cut(roots.select("id", F.lit(0).alias("depth"), F.array("id").alias("path")).distinct())
    frontier = reached
    for depth in range(1, most + 1):
        steps = frontier.select(F.col("id").alias("src"), "path").join(edges.select("src", "dst").distinct(), "src")
        new = steps.join(reached.select(F.col("id").alias("dst")), "dst", "left_anti").groupBy("dst").agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        frontier = cut(new.select(F.col("dst").alias("id"), F.lit(depth).alias("depth"), "path"))
        if frontier.isEmpty():
            break
        reached = cut(reached.unionByName(frontier))
    return reached


def merged_mirrors(nodes: DataFrame, key: Column, url: str, weight: str) -> DataFrame:
    """URLs with one key are one page: the longest URL and the largest weight."""
    return nodes.groupBy(key.alias("mirror")).agg(F.max_by(url, F.struct(F.length(url), url)).alias("url"), F.max(weight).alias("weight"), F.count("*").alias("n"))


def greedy_pairs(overlaps: DataFrame, block: str, left: str, right: str, n: str, least: str) -> DataFrame:
    """One-to-one matching within a block, largest overlap first, then smallest section: a round keeps pairs that are the best of
    both their sides, which gives what taking them one by one in that order gives."""
    order = F.struct(-F.col(n), F.col(least), F.col(left), F.col(right))
    rest, found = cut(overlaps.select(block, left, right, n, least)), None
    while True:
        ranked = rest.withColumn("_o", order)
        best_l = ranked.groupBy(block, left).agg(F.min("_o").alias("_o"))
        best_r = ranked.groupBy(block, right).agg(F.min("_o").alias("_o"))
        both = cut(ranked.join(best_l, [block, left, "_o"], "left_semi").join(best_r, [block, right, "_o"], "left_semi").drop("_o"))
        if both.isEmpty():
            return found if found is not None else both
        found = both if found is None else found.unionByName(both)
        rest = cut(rest.join(both, [block, left], "left_anti").join(both, [block, right], "left_anti"))


def with_places(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
