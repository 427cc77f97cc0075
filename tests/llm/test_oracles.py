"""Queries with SQL must match DuckDB on the smallest tables."""

import duckdb
import pytest

from nightjar.llm import queries
from scripts.check_oracle import TABLES, digest


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_oracle(spark, sf, con, name):
    got = queries.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in got.collect()]
    found = con.execute(queries.ORACLE[name])
    columns, want = [d[0] for d in found.description], found.fetchall()
    assert sorted(got.columns) == sorted(columns)
    assert digest(got.columns, rows)[0] == digest(columns, want)[0]


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
