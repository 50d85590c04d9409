"""Connected components over string-keyed edges, without hot tasks and without the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.runtime import cut

#: Edges a task folds into a local forest before it emits them: bounds a Python worker's memory.
FOLD_EDGES = 200_000


def node_id(c: Column | str) -> Column:
    """16 bytes that stand for a node's name in the rounds."""
    return F.unhex(F.md5(F.col(c) if isinstance(c, str) else c))


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find inside a task: edges become stars around the smallest node seen."""
    top: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        root = x
        while (up := top.setdefault(root, root)) != root:
            root = up
        while top[x] != root:
            top[x], x = root, top[x]
        return root

    def out() -> pd.DataFrame:
        nodes = list(top)
        return pd.DataFrame({"u": nodes, "v": [find(x) for x in nodes]}, dtype=object)

    held = 0
    for b in batches:
        for u, v in zip(b["u"], b["v"]):
            a, c = find(u), find(v)
            if a != c:
                top[max(a, c)] = min(a, c)
        held += len(b)
        if held >= FOLD_EDGES:
            yield out()
            top.clear()
            held = 0
    if top:
        yield out()


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node BINARY, component BINARY): the `node_id` of every node of `edges` (given as such, or by name) with the smallest one of its component.

    Edges are undirected here; null ends are ignored; an empty table gives no rows. Each task first folds its own
    edges into stars. Edges are kept from the larger to the smaller node; a round links all smaller neighbours of a
    node to the smallest (small star), then lets every edge jump over its smaller end (large star), until nothing
    changes. Minima are pre-aggregated before they are shuffled, and joined back one row per node, so a hub with a
    third of all edges is split by the skew join. Each round is checkpointed in the shared folder.
    """
    as_id = lambda c: node_id(c) if edges.schema[c].dataType.typeName() == "string" else F.col(c)
    e = edges.select(as_id(src).alias("u"), as_id(dst).alias("v")).where("u is not null and v is not null")
    e = cut(e.mapInPandas(_forest, "u binary, v binary").distinct())

    def least(df: DataFrame) -> DataFrame:
        return df.groupBy("u").agg(F.min("v").alias("m"))

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(e)
    while True:
        small = e.join(least(e), "u")
        small = small.select("u", "m").union(small.where("v <> m").select("v", "m")).toDF("u", "v").distinct()
        small = cut(small)
        jump = least(small).select(F.col("u").alias("v"), F.col("m").alias("w"))
        e = cut(small.join(jump, "v", "left").select("u", F.coalesce("w", "v").alias("v")).distinct())
        after = state(e)
        if after == before:
            break
        before = after
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
