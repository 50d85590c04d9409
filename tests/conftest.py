import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings readings bars dxy_quotes daily_bars datasets evidence lineage sources zone_abbrevs feed_records raw_bars".split()


@pytest.fixture(scope="session")
def spark():
    from tapewright.runtime import session

    s = session("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(pdf):
    """Rows as a sorted list of texts; floats to nine digits, every kind of missing alike."""

    def text(x):
        if x is None or x is ... or (isinstance(x, float) and x != x) or str(x) in ("NaT", "<NA>"):
            return "~"
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        if isinstance(x, (int, float)) or type(x).__module__ == "numpy":
            try:
                return f"{float(x) + 0.0:.9g}"
            except (TypeError, ValueError):
                return str(x)
        return str(x)

    cols = sorted(pdf.columns)
    return sorted(tuple(text(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None))
