"""Dataset store on Parquet: partitioned writes, upserts, range scans, hashes, a hash-chained log, CSV and JSON sinks."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.functions.scalars import row_hash, set_hash
from tapewright.operators.blocks import Frames, numbered, with_halo
from tapewright.operators.folds import ordered_fold


def save(df: DataFrame, path: str, partition: Sequence[str] = ("symbol", "timeframe"), files_per: int = 1) -> None:
    """Writes the partitions the rows belong to and leaves the others as they are."""
    df.repartition(files_per, *partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Old rows whose key the new ones lack, and of each key's new rows the one with the largest version."""
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), version).alias("r")).select("r.*")
    return old.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def scan(spark: SparkSession, path: str, ts: str = "ts", start=None, end=None, columns: Sequence[str] | None = None, descending: bool = False, offset: int = 0, limit: int | None = None, **equal) -> DataFrame:  # noqa: ANN001, ANN003
    """Rows between two stamps (both included) with equal columns, projected and sorted; pruned to partitions and row groups."""
    df = spark.read.parquet(path)
    for k, v in equal.items():
        df = df.where(F.col(k).isin(v) if isinstance(v, (list, tuple, set)) else F.col(k) == v)
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end))
    df = df.select(*columns) if columns else df
    df = df.orderBy(F.desc(ts) if descending else F.asc(ts))
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit is not None else df


def page(df: DataFrame, number: int = 1, size: int = 20, sort: str = "created_at", descending: bool = True, tie: str = "id", allowed: Sequence[str] = ()) -> tuple[DataFrame, int, int]:
    """(rows of the page, rows in all, pages in all); size from 1 to 100, sort column from a list."""
    if number < 1 or not 1 <= size <= 100 or (allowed and sort not in allowed):
        raise ValueError("no such page or sort column")
    n = df.count()
    key = F.desc(sort) if descending else F.asc(sort)
    return df.orderBy(key, tie).offset((number - 1) * size).limit(size), n, -(-n // size)


def dataset_hash(df: DataFrame) -> str:
    """Order-free content hash of all rows and column names; equal for equal rows in any order or partitioning."""
    cols = sorted(df.columns)
    h = df.select(row_hash(*cols).alias("h")).agg(set_hash("h").alias("s")).first().s
    return f"{h}:{','.join(cols)}"


def chain(df: DataFrame, order: str, payload: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """`df` plus prev and digest: SHA-256 of the digest before it (in its log, by `order`) and the row's values; the first prev is null.

    A digest needs the one before, so a log (`keys`) is one pass of one task in constant memory; logs run side by side.
    """
    d = df.withColumns({"_log": F.concat_ws("|", *keys) if keys else F.lit(""), "_row": row_hash(*payload)})

    def make():  # noqa: ANN202
        last = None

        def step(row: str) -> tuple:
            nonlocal last
            before, last = last, hashlib.sha256(f"{last or ''}|{row}".encode()).hexdigest()
            return before, last

        return step

    return ordered_fold(d, ["_log"], [order], ["_row"], df.columns, make, [("prev", T.StringType()), ("digest", T.StringType())])


def verify_chain(log: DataFrame, order: str, digest: str, prev: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows whose prev is not the digest before them: breaks of a hash-linked log.

    `order` is a BIGINT that is unique in a log; blocks with a halo row split a long one.
    """
    f = Frames(keys=("_log", "block"))
    d = log.withColumns({"_log": F.concat_ws("|", *keys) if keys else F.lit(""), "_at": F.timestamp_micros(F.col(order).cast("bigint") * 1_000_000)})
    d = with_halo(numbered(d, ["_log"], "_at", [order]), before=1).withColumn("_before", f.lag(digest))
    return d.where("not halo").where(~F.col(prev).eqNullSafe(F.col("_before"))).select(*log.columns)


def verify_digests(log: DataFrame, payload: Sequence[str], digest: str = "digest", prev: str = "prev") -> DataFrame:
    """Rows whose digest does not follow from their prev and values: what was altered after it was written."""
    own = F.sha2(F.concat(F.coalesce(F.col(prev), F.lit("")), F.lit("|"), row_hash(*payload)), 256)
    return log.where(~own.eqNullSafe(F.col(digest)))


def manifest_hash(df: DataFrame, name: str, digest: str) -> str:
    """Hash of (name, digest) pairs in any order."""
    return df.select(F.concat_ws("=", name, digest).alias("h")).agg(set_hash("h").alias("s")).first().s


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def to_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
