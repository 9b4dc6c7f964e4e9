"""Every registered query against its SQL counterpart at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, table

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, sf, name):
    frame = QUERIES[name](spark, sf)
    columns, rows = table(frame.columns, frame.collect())
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        expected_columns, expected = table([d[0] for d in result.description], result.fetchall())
        assert columns == expected_columns
        assert rows == expected


def test_entry_is_the_flagship(spark):
    hits = entry.entry(spark)
    assert hits.columns == ["query_id", "chunk_id", "score", "rank", "norm_score"] or set(hits.columns) == {
        "query_id", "chunk_id", "score", "rank", "norm_score"
    }
    assert hits.count() == 320
