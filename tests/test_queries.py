"""Every query with SQL gives what DuckDB gives, at the smallest scale."""

import os

import duckdb
import pytest

from scenelake.plans import catalogue


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return list(v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, sf, db, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalogue.SQL:
        assert got
        return
    found = db.sql(catalogue.SQL[name])
    at = [found.columns.index(c) for c in columns]
    assert sorted(found.columns) == columns
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
