"""Key normalisation shared by the market tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def symbol_key(c: Column | str) -> Column:
    """A symbol as it is compared: trimmed of white space and upper-cased. Null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(F.regexp_replace(c, r"^\s+|\s+$", ""))


def hash_key(c: Column | str) -> Column:
    """An artifact hash as it is compared: no blanks, lower case, no leading `sha256:`. Null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"\s+", "")), r"^sha256:", "")


def epoch_us(c: Column | str) -> Column:
    """Microseconds since 1970 UTC of a TIMESTAMP column."""
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)
