"""The queries of the problems on text, and the SQL that holds for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.llm import bpe, languages, packing
from tapewright.runtime import cut, table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.assign_containers(bpe.token_counts(table(spark, d, "documents")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.wrong_labels(languages.identify(table(spark, d, "documents")))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    found = languages.identify(table(spark, d, "documents"))
    return found.select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.start", "s.end", "s.lang", F.round("s.confidence", 6).alias("confidence"))


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    return languages.identify(table(spark, d, "documents")).drop("segments")


def p9_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Of each document whether its pieces follow each other and hold all of its tokens, and whether it is split only where it exceeds a container."""
    sizes = cut(bpe.token_counts(table(spark, d, "documents")))
    out = cut(packing.assign_containers(sizes))
    w = Window.partitionBy("doc_id").orderBy("piece")
    placed = out.withColumn("before", F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("pieces"), F.bool_and(F.col("before") == F.col("start_token")).alias("follow"))
    j = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n")).join(g, "doc_id", "left")
    return j.select("doc_id", F.coalesce(F.col("follow") & (F.col("t") == F.col("n")), F.lit(False)).alias("whole"), ((F.col("pieces") == 1) | (F.col("n") > packing.CAPACITY)).alias("split_if_longer"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers beyond their capacity, and whether less than one in a hundred is opened beyond the least possible number."""
    out = cut(packing.assign_containers(bpe.token_counts(table(spark, d, "documents"))))
    c = out.groupBy("container").agg(F.sum("n_tokens").alias("t"))
    g = c.agg(F.count(F.when(F.col("t") > packing.CAPACITY, 1)).alias("overfull"), F.count("*").alias("n"), F.sum("t").alias("t"))
    return g.select("overfull", (F.col("n") <= F.ceil(F.col("t") / packing.CAPACITY) * 1.01 + 1).alias("tight"))


def p10_labels(spark: SparkSession, d: str) -> DataFrame:
    """The language that each label names."""
    return table(spark, d, "documents").select("doc_id", languages.label_code(F.col("lang")).alias("code"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p8_ids, p9_containers, p9_coverage, p9_fill, p10_found, p10_segments, p10_languages, p10_labels)}
SQL: dict[str, str] = {
    "p9_coverage": "SELECT doc_id, true AS whole, true AS split_if_longer FROM documents",
    "p9_fill": "SELECT CAST(0 AS BIGINT) AS overfull, true AS tight",
    "p10_labels": r"""WITH n AS (SELECT unnest([
  {'code': 'de', 'names': ['de', 'deu', 'ger', 'german']}, {'code': 'en', 'names': ['en', 'eng', 'english']}, {'code': 'es', 'names': ['es', 'spa', 'spanish', 'castilian']}, {'code': 'fr', 'names': ['fr', 'fra', 'fre', 'french']},
  {'code': 'it', 'names': ['it', 'ita', 'italian']}, {'code': 'ja', 'names': ['ja', 'jpn', 'japanese']}, {'code': 'nl', 'names': ['nl', 'nld', 'dut', 'dutch', 'flemish']}, {'code': 'pt', 'names': ['pt', 'por', 'portuguese']},
  {'code': 'ru', 'names': ['ru', 'rus', 'russian']}, {'code': 'zh', 'names': ['zh', 'zho', 'chi', 'chinese', 'mandarin']}]) AS r), k AS (SELECT r.code AS code, unnest(r.names) AS name FROM n)
SELECT doc_id, code FROM documents LEFT JOIN k ON k.name = lower(regexp_extract(trim(lang, E' 	
'), '^([A-Za-z]+)([-_][A-Za-z0-9_-]+)?$', 1))""",
}
