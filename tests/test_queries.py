"""Every catalogue query with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import duckdb
import pytest

from ledgerspark import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return connection


def told(value):
    return round(value, 6) if isinstance(value, float) else str(value)[:10] if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(map(told, r))) for r in df.select(columns).collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert isinstance(got, list)
        return
    found = db.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(told(row[i]) for i in at)) for row in found.fetchall())
