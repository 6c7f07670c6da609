"""Every registered query that has SQL gives the same rows as DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return c


def cell(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, data, connection, name):
    df = QUERIES[name](spark, data)
    cursor = connection.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    places = [names.index(n) for n in order]
    ours = sorted(tuple(cell(r[n]) for n in order) for r in df.collect())
    theirs = sorted(tuple(cell(r[i]) for i in places) for r in cursor.fetchall())
    assert len(ours) == len(theirs)
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not different, different[:3]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 8
