"""Rows that fail to parse: strict load, anti-join on the record offsets, diagnosis of the rest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER = "symbol,timestamp,open,high,low,close,volume,note"
FIELDS = HEADER.split(",")
#: Time layouts that are accepted in full: Java pattern, and the regular expression of its digits.
LAYOUTS = (
    ("yyyy-MM-dd HH:mm:ss", r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"),
    ("yyyy.MM.dd HH:mm", r"^[0-9]{4}\.[0-9]{2}\.[0-9]{2} [0-9]{2}:[0-9]{2}\z"),
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z"),
)
NUMBER = r"^[ \t]*[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?[ \t]*\z"


def split_quoted(line: str) -> list[str] | None:
    """The fields of a CSV record, or None if its quoting is broken. Linear in the line's length."""
    out, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            parts, i = [], i + 1
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None
                parts.append(line[i:j])
                if line[j + 1 : j + 2] != '"':
                    break
                parts.append('"')
                i = j + 2
            i = j + 1
            if i < n and line[i] != ",":
                return None
            out.append("".join(parts))
        else:
            j = line.find(",", i)
            j = n if j < 0 else j
            if '"' in line[i:j]:
                return None
            out.append(line[i:j])
            i = j
        if i >= n:
            return out
        i += 1


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split_udf(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: None if x is None else split_quoted(x))


def _fields(line: Column) -> Column:
    """Fields of a line, null if its quoting is broken. Only lines with a quote go to Python."""
    quoted = line.contains('"')
    return F.when(quoted, _split_udf(F.when(quoted, line))).otherwise(F.split(line, ",", -1))


def _time(text: Column) -> Column:
    """The instant of a text in one of the layouts, else null (impossible dates and times too)."""
    usual = F.when(text.rlike(LAYOUTS[1][1]), F.concat(F.translate(text, ".", "-"), F.lit(":00"))).when(text.rlike(LAYOUTS[0][1]), text).when(text.rlike(LAYOUTS[2][1]), F.concat_ws(" ", F.substring(text, 1, 10), F.substring(text, 12, 8)))
    ok = usual.isNotNull() & (F.substring(usual, 1, 4) != "0000")
    return F.when(ok, F.try_to_timestamp(usual, F.lit("yyyy-MM-dd HH:mm:ss")))


def _number(text: Column) -> Column:
    """A finite DOUBLE of the number grammar, else null."""
    value = F.when(text.rlike(NUMBER), F.translate(text, " \t", "")).try_cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def strict_load(raw: DataFrame) -> DataFrame:
    """The conforming records: raw_id, file_name, line_no and the typed columns of HEADER.

    Conforming: sound quoting, eight fields, a full and possible timestamp, open finite above zero, volume
    empty (null) or finite of at least zero. high, low and close are null where they are no numbers. Header
    lines and null lines are not loaded.
    """
    r = raw.where(F.col("line").isNotNull() & (F.col("line") != HEADER)).select("raw_id", "file_name", "line_no", _fields(F.col("line")).alias("f")).where("size(f) = 8")
    at = lambda i: F.col("f")[i]
    typed = r.select("raw_id", "file_name", "line_no", at(0).alias("symbol"), _time(at(1)).alias("timestamp"), *[_number(at(i)).alias(FIELDS[i]) for i in range(2, 7)], at(7).alias("note"), (at(6) == "").alias("no_volume"))
    return typed.where("timestamp is not null and open > 0 and (no_volume or volume >= 0)").drop("no_volume")


def rejected(raw: DataFrame) -> DataFrame:
    """(raw_id, file_name, line_no, line, reason): all lines but headers that `strict_load` left, with the first reason that applies.

    The loaded offsets are subtracted from the raw ones, then only the remainder is diagnosed. A null line
    counts as a blank one: `columns`.
    """
    loaded = strict_load(raw).select("raw_id")
    rest = raw.where(~F.col("line").eqNullSafe(HEADER)).select("raw_id", "file_name", "line_no", "line").join(loaded, "raw_id", "left_anti")
    f = rest.withColumn("f", _fields(F.coalesce("line", F.lit(""))))
    at = lambda i: F.get(F.col("f"), F.lit(i))
    reason = (
        F.when(F.col("f").isNull(), "quoting")
        .when(F.size("f") != 8, "columns")
        .when(_time(at(1)).isNull(), "timestamp")
        .when(~F.coalesce(_number(at(2)) > 0, F.lit(False)), "open")
        .otherwise("volume")
    )
    return f.select("raw_id", "file_name", "line_no", "line", reason.alias("reason"))
