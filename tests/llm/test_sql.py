"""Queries with SQL give the same rows as DuckDB on the smallest test data."""

from pathlib import Path

import duckdb
import pytest

from corpusmill.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    assert got == sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=str)
