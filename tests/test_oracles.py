"""Every query with SQL gives the same rows as DuckDB on the smallest test data."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from corpusmill.plans.catalog import COVERS, ORACLES, QUERIES

from .test_queries import BY_HAND

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v) if v != v.to_integral() else int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())


def test_queries_without_sql_have_a_test_of_their_own():
    assert sorted(set(QUERIES) - set(ORACLES)) == sorted(BY_HAND)


def test_every_query_names_what_it_covers():
    assert all(COVERS[n].strip() for n in QUERIES)
