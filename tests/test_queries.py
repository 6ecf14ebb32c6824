"""Queries against their SQL on a small set of tables, where those are there."""

import os

import duckdb
import pytest

from tessera import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DIR):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    frame = catalog.QUERIES[name](spark, DIR)
    columns = sorted(frame.columns)
    got = sorted((tuple(map(plain, r)) for r in frame.select(*columns).collect()), key=repr)
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({catalog.SQL[name]})").fetchall()
    assert got == sorted((tuple(map(plain, r)) for r in want), key=repr)


def test_entry_point():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
