"""The queries of the general problems: each applies its operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.operators import hierarchy, nearest, regular_grid, spikes, stamps, strict_csv, trailing
from tapewright.runtime import table

TOLERANCE_US = 120 * 1_000_000


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cycles(table(spark, d, "lineage"))


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.every_path(table(spark, d, "lineage")).withColumn("path", F.array_join("path", ">"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(table(spark, d, "lineage"))


def _state(spark: SparkSession, d: str, parts: tuple[str, ...] = trailing.PARTS) -> DataFrame:
    return trailing.maintained(table(spark, d, "daily_bars"), parts=parts)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return trailing.idle_periods(_state(spark, d, ("n_active",)))


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    r = trailing.trailing_report(_state(spark, d))
    return r.select("symbol", F.date_format("day", "yyyy-MM-dd").alias("day"), "period_days", *[F.round(c, 6).alias(c) for c in ("total_volume", "avg_volume", "total_close", "avg_close")], "idle")


def p2_versions(spark: SparkSession, d: str) -> DataFrame:
    """The days that corrections rewrote or added, and their versions."""
    s = _state(spark, d).where("live")
    return s.select("symbol", F.date_format("day", "yyyy-MM-dd").alias("day"), "version", F.round(F.col("volume_30").cast("double"), 6).alias("volume_30"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    bars = table(spark, d, "bars").where("close is not null")
    quotes = table(spark, d, "dxy_quotes").where("dxy_close is not null")
    return nearest.nearest_in_time(bars, quotes, entity="source", left_time="timestamp", right_time="timestamp", left_id="bar_id", right_id="dxy_id", tolerance_us=TOLERANCE_US)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("bar_id", "dxy_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.flag_spikes(table(spark, d, "bars")).where("kind <> 'suspect'").select("bar_id", "field")


def p4_flags(spark: SparkSession, d: str) -> DataFrame:
    times = F.when(~F.isnan("times") & (F.abs("times") < float("inf")), F.round("times", 8))
    return spikes.flag_spikes(table(spark, d, "bars")).where("kind <> 'suspect'").select("bar_id", "field", "kind", times.alias("times"))


def p4_suspects(spark: SparkSession, d: str) -> DataFrame:
    """What the filter flags and the exact rule does not confirm, with its standardised innovation."""
    return spikes.flag_spikes(table(spark, d, "bars")).where("kind = 'suspect'")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return strict_csv.rejected(table(spark, d, "raw_bars")).select("raw_id", "reason")


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    return strict_csv.strict_load(table(spark, d, "raw_bars")).select("raw_id", "file_name", "line_no", "symbol", F.unix_micros("timestamp").alias("at_us"), "open", "high", "low", "close", "volume", "note")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid.regular_grid(table(spark, d, "readings")).where("status <> 'observed'").select("source", "symbol", "slot_epoch").distinct()


def p6_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid.regular_grid(table(spark, d, "readings")).withColumn("close", F.round("close", 6))


def p7_stamps(spark: SparkSession, d: str) -> DataFrame:
    one = lambda origin, key, text: table(spark, d, origin).select(F.lit(origin).alias("origin"), "source", F.col(key).cast("string").alias("key"), F.col(text).alias("stamp"))
    both = one("feed_records", "record_id", "timestamp").union(one("datasets", "id", "start_time"))
    return stamps.normalise_stamps(both, "key", "stamp", table(spark, d, "sources"), table(spark, d, "zone_abbrevs"), keep=("origin",))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    # the exact check: a text that is already canonical, or readable only against the conventions, is no case
    return p7_stamps(spark, d).where("utc_us is not null and not canonical and status <> 'contrary'").select("origin", "record_key", "utc_us")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p2_found, p2_totals, p2_versions, p3_found, p4_found, p4_flags, p4_suspects, p5_found, p5_loaded, p6_found, p6_grid, p7_found, p7_stamps)
}
