"""Every registered query with SQL gives the rows that DuckDB gives for it."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def rows(values):
    def norm(v):
        return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else repr(v)

    return sorted((tuple(norm(v) for v in r) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = [[r[names.index(c)] for c in cols] for r in found.fetchall()]
    assert rows(df.select(*cols).collect()) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "id", "similarity"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
