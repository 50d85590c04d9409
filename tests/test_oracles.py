"""Every query that has SQL gives the same rows and columns as DuckDB."""

import pytest

import __spark_entry__ as e
from conftest import SF, rows

SQL = {k: v for k, v in e.oracle_sql().items() if not (e.llm and k in e.llm.SQL)}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got = e.queries()[name](spark, SF).toPandas()
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())
