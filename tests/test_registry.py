"""Every registered query against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

from examlake import registry

registry.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    order = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    if name in registry.SQL:
        want = duck.sql(registry.SQL[name])
        assert sorted(want.columns) == order
        assert got == sorted(tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall())
