"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

from kgalign.jobs import queries as own

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return round(float(v), 5) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query(spark, duck, name):
    df = own.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.sql(own.oracle_sql()[name])
    assert sorted(found.columns) == columns
    want = sorted((tuple(_plain(dict(zip(found.columns, r))[c]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want
