"""Every query with SQL must agree with it; every other one must run."""

import math

import duckdb
import pytest

from quern.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    if name in SQL:
        rel = db.execute(SQL[name])
        columns = [c[0] for c in rel.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, rel.fetchall())


def test_every_query_has_sql_but_random_and_approximate_ones():
    assert set(QUERIES) - set(SQL) == {"vec_graph_search"}
