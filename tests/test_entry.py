"""The driver contract, and every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest

import __spark_entry__
from glyphledger.plans import oracles, registry

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted(([clean(r[i]) for i in order] for r in rows), key=repr)


@needs_data
@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cur = duck.execute(oracles.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cur.fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(oracles.SQL)))
def test_rows_only(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_contract():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["l_orderkey", "l_linenumber", "field"]
