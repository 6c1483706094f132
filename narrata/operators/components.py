"""Connected components by alternating large and small stars (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): O(log n) rounds whatever the diameter, two narrow joins a round.

A star's center may have a third of all nodes. Its smallest neighbour is found by partial minima; the edges of such
centers then meet that one row where they are, by a broadcast of a bounded number of rows, and are not shuffled by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.operators.skew import join_counted
from narrata.plans.storage import Workspace


def _with_least(work: Workspace, label: str, edges: DataFrame, total: int, small: int) -> DataFrame:
    """(u, v, m): edges, ``total`` at most, with the smallest neighbour of u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if total <= small:
        return edges.join(F.broadcast(least), "u")
    return join_counted(edges, work.table(label, least), "u", total, small=small)


def _large_star(work: Workspace, edges: DataFrame, total: int, small: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = _with_least(work, "large-least", both, 2 * total, small).withColumn("m", F.least("u", "m"))
    return found.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(work: Workspace, edges: DataFrame, total: int, small: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    found = _with_least(work, "small-least", down, total, small)
    moved = found.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(found.where("v = m").select("u", "v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", small: int = 50_000) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is named by its smallest node.

    Ids may be numbers or strings, compared by Spark's order (strings by code point). Edges with a null end,
    self-loops apart, are ignored; a node that has only a self-loop is its own component. Repeated edges and
    either direction count once. No edges: an empty result. Each round is written to the shared folder, so
    lineage stays short and lost executors cost one round's tasks. small: edges
    up to which all minima are broadcast, not those of hot nodes only.
    """
    work = Workspace(edges.sparkSession, "components")
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    pairs = work.table("input", pairs.distinct())
    stars, seen, turn = pairs.where("u <> v"), None, 0
    total = stars.count()
    while True:
        large = _large_star(work, stars, total, small)
        if total > small:
            large = work.table("large", large)
        stars = work.table(f"round{turn}", _small_star(work, large, total, small))
        state = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        work.drop(f"round{turn - 1}", "large", "large-least", "small-least")
        if state == seen:
            break
        seen, turn, total = state, turn + 1, state[0]
    roots = stars.select(F.col("v").alias("u")).unionByName(pairs.where("u = v").select("u")).distinct()
    own = roots.join(stars, "u", "left_anti").select(F.col("u").alias("node"), F.col("u").alias("component"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
