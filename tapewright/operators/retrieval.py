"""Nearest neighbours, token overlap and similarity ranking; queries are a stated set, answered in blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most query vectors sent to the tasks at once, and their most bytes.
QUERY_BLOCK, QUERY_BYTES = 4_096, 64_000_000


def nearest_vectors(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int = 5) -> DataFrame:
    """(query, neighbour, rank, distance): the k nearest rows of each query vector by L2, ties by the smaller id; itself left out.

    Query vectors are streamed through the driver in blocks of at most QUERY_BLOCK rows and QUERY_BYTES, whatever their
    length; each block is broadcast for one pass over the rows, where a task keeps its k best per query, and the partial
    lists (k per task and query) are merged. A query id that occurs twice is one query per distinct vector. Null vectors are left out.
    """
    q = queries.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v")).distinct()
    every = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v"))
    out = None
    for ids, mat in _blocks(q.toLocalIterator(prefetchPartitions=True)):
        part = every.mapInArrow(_best(rows.sparkSession.sparkContext.broadcast((ids, mat)), k), "query bigint, neighbour bigint, distance double")
        out = part if out is None else out.union(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query bigint, neighbour bigint, rank int, distance double")
    top = out.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, k).alias("t"))
    return top.select("query", F.posexplode("t").alias("rank", "x")).select("query", F.col("x.neighbour").alias("neighbour"), (F.col("rank") + 1).alias("rank"), F.col("x.distance").alias("distance"))


def _blocks(queries: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries in blocks of bounded rows and bytes (at least one row)."""
    ids, vectors = [], []
    for r in queries:
        if ids and (len(ids) >= QUERY_BLOCK or (len(ids) + 1) * 8 * len(r.v) > QUERY_BYTES):
            yield np.array(ids, dtype=np.int64), np.array(vectors, dtype=np.float64)
            ids, vectors = [], []
        ids.append(r.id)
        vectors.append(r.v)
    if ids:
        yield np.array(ids, dtype=np.int64), np.array(vectors, dtype=np.float64)


def _best(sent, k: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        best_d, best_i = np.full((len(ids), k), np.inf), np.full((len(ids), k), -1, dtype=np.int64)
        for b in batches:
            n = np.array(b.column(0).to_pylist(), dtype=np.int64)
            for i in range(0, len(n), 2_000):
                m = n[i : i + 2_000]
                v = np.array(b.column(1).slice(i, len(m)).to_pylist(), dtype=np.float64)
                d = np.sqrt(((q[:, None, :] - v[None, :, :]) ** 2).sum(-1)) if len(q) * len(v) * q.shape[1] < 30_000_000 else np.stack([np.sqrt(((v - x) ** 2).sum(-1)) for x in q])
                d = np.where(ids[:, None] == m[None, :], np.inf, d)
                d, c = np.concatenate([best_d, d], axis=1), np.concatenate([best_i, np.broadcast_to(m, d.shape)], axis=1)
                for r in range(len(ids)):
                    o = np.lexsort((c[r], d[r]))[:k]
                    best_d[r], best_i[r] = d[r, o], c[r, o]
        ok = np.isfinite(best_d)
        r = np.repeat(ids, ok.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(best_i[ok]), pa.array(best_d[ok])], names=["query", "neighbour", "distance"])

    return run


def token_overlap(rows: DataFrame, query: str, id_col: str, text: str, most: int = 10, tags: Sequence[str] = (), tag_col: str | None = None) -> DataFrame:
    """(id, score): share of the query's words in the text plus a tenth per shared tag; the best `most`, ties by id."""
    words = sorted({w for w in query.lower().split() if w})
    have = F.array_distinct(F.split(F.lower(F.col(text)), r"\s+"))
    score = F.size(F.array_intersect(have, F.array(*map(F.lit, words)))) / F.lit(float(max(len(words), 1)))
    if tag_col and tags:
        score = score + 0.1 * F.size(F.array_intersect(F.col(tag_col), F.array(*map(F.lit, tags))))
    return rows.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(most)


def minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns scaled to [0, 1] by the table's extremes; a flat column becomes 0. The extremes are one row."""
    e = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("a", F.min), ("b", F.max))]).first()
    scaled = {}
    for c in columns:
        a, b = e[f"_a_{c}"], e[f"_b_{c}"]
        scaled[c] = (F.col(c) - a) / (b - a) if a is not None and b != a else F.col(c) * 0.0
    return df.withColumns(scaled)


def pandas_knn_shares(train: pd.DataFrame, point: np.ndarray, k: int) -> dict:
    """Class shares of the k nearest training rows; equal shares without any."""
    d = ((train.drop(columns="label").to_numpy() - point) ** 2).sum(axis=1)
    near = train.label.to_numpy()[np.argsort(d, kind="stable")[:k]]
    return {c: float((near == c).mean()) for c in np.unique(near)} if len(near) else {}


def validated(rows: DataFrame, key: str, links: DataFrame, source: str, valid: Column) -> DataFrame:
    """`rows` plus sources: those with at least one source, all of which exist in `rows` and are valid. `links` has distinct (key, source)."""
    good = rows.select(F.col(key).alias(source), F.coalesce(valid, F.lit(False)).alias("_ok"))
    g = links.join(good, source, "left").groupBy(key).agg(F.min(F.coalesce(F.col("_ok"), F.lit(False))).alias("_all"), F.count("*").alias("sources"))
    return rows.join(g.where("_all").drop("_all"), key)
