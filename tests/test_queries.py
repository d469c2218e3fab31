"""Every query against its SQL on the smallest driver tables."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: ("nan" if math.isnan(v) else f"{v:.9g}") if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


def test_names():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not (n[0] == "p" and n[1:2].isdigit() and n not in SQL)))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in SQL:
        rel = duck.sql(SQL[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert plain(rows, df.columns) == plain(rel.fetchall(), rel.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
