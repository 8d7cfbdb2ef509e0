"""Every query with SQL gives what DuckDB gives over the smallest tables."""

import functools
import math

import duckdb
import pytest

from quire import queries
from quire.oracle import ORACLE
from quire.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module", autouse=True)
def one_world():
    """The graph and the index of the small tables are built once for all queries here."""
    build = queries.World
    queries.World = functools.lru_cache(build)
    yield
    queries.World = build


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    result = duck.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
