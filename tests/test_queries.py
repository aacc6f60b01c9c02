"""Every query with SQL against DuckDB on the smallest fixture."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from corvello.plans import queries as library

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(library.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = library.QUERIES[name](spark, DATA)
    want = duck.execute(library.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = lambda found: sorted((tuple(map(str, r)) for r in found))
    assert rows(tuple(r) for r in got.select(*(f"`{c}`" for c in columns)).collect()) == rows(want.fetchall())


def test_entry_and_registry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(library.QUERIES) <= set(entry.queries())
