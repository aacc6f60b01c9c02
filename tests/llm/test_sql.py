"""The operators' queries that SQL can express against DuckDB on the smallest fixture."""

from pathlib import Path

import duckdb
import pytest

from corvello.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(columns) == sorted(got.columns)
    rows = lambda found: sorted(tuple(map(str, r)) for r in found)
    assert rows(tuple(r) for r in got.select(*columns).collect()) == rows(want.fetchall())
