"""Every registered query that has SQL gives the same rows as DuckDB on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.01"


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(str(r[i]) for i in order) for r in found))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in "part pages events documents embeddings benchmark labels".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{SF}/{t}.parquet') else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(e.oracle_sql()))
def test_query(spark, duck, name):
    df = e.queries()[name](spark, SF)
    want = duck.execute(e.oracle_sql()[name])
    names, expected = rows([c[0] for c in want.description], want.fetchall())
    got_names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got_names == names and got and got == expected


def test_entry(spark):
    assert e.entry(spark).count() >= 1
