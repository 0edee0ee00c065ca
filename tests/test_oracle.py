"""Every registered query against its DuckDB oracle on the smallest scale factor."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.oracle_check import TABLES, digest

KEYS = sorted(E.queries())
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    import duckdb
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_registered_is_callable():
    assert len(KEYS) >= 100


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    if key not in SQL:
        assert rows is not None
        return
    res = con.sql(SQL[key])
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(res.columns)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(res.columns, orows)[0]


def test_entry(spark):
    out = E.entry(spark)
    assert out.count() > 0
