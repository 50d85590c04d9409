"""Breadth-first queries from a few start nodes over edges of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.runtime import cut


def shortest_paths(edges: DataFrame, starts: DataFrame, directed: bool = True, hops: int | None = None, most: int = 10_000) -> DataFrame:
    """(start, node, distance, path): a shortest path from each start to every node it reaches, ties to the smallest path.

    edges: parent, child; starts: start. Level by level: the frontier is joined to the edges, known pairs are
    anti-joined away, each level is checkpointed; it ends when a level is empty, so cycles end too. The start itself has
    distance 0. `hops` asks for the neighbourhood of that many steps only. Null ends lead nowhere. More than `most` levels raise.
    """
    e = edges.select(F.col("parent").alias("node"), F.col("child").alias("to")).dropna()
    if not directed:
        e = e.union(e.select(F.col("to"), F.col("node"))).toDF("node", "to").distinct()
    e = cut(e)
    front = cut(starts.where("start is not null").select("start", F.col("start").alias("node"), F.lit(0).alias("distance"), F.array("start").alias("path")).distinct())
    known = front
    for level in range(1, (most if hops is None else hops) + 1):
        step = front.join(e, "node").select("start", F.col("to").alias("node"), F.concat("path", F.array("to")).alias("path"))
        step = step.groupBy("start", "node").agg(F.min("path").alias("path"))
        front = cut(step.join(known.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", F.lit(level).alias("distance"), "path"))
        if not front.take(1):
            return known
        known = known.unionByName(front)
    if hops is None:
        raise ValueError(f"more than {most} levels")
    return known


def ancestors(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, distance, path) upwards."""
    return shortest_paths(edges.select(F.col("child").alias("parent"), F.col("parent").alias("child")), starts)


def missing_ends(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(node): ends of edges that the node table lacks: the foreign-key check of a graph."""
    ends = edges.select(F.explode(F.array("parent", "child")).alias("node")).where("node is not null").distinct()
    return ends.join(nodes.select(F.col(key).alias("node")), "node", "left_anti")
