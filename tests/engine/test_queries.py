"""Every registered query against its DuckDB SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lumenfield.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf_dir}/{f}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return v
        if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio"):
            return None if math.isnan(v) else float(v)
        return str(v)

    return sorted(repr([plain(r[i]) for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    cur = db.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, map(tuple, df.collect())) == rows(names, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 64
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(SQL) == set(QUERIES)
