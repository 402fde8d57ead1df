import duckdb
import pytest

import __spark_entry__  # noqa: F401  registers all queries
from loomspark.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, sf, tables, name):
    got, want = QUERIES[name](spark, sf), tables.sql(SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got.collect()) == sorted(repr([plain(r[k]) for k in at]) for r in want.fetchall())
