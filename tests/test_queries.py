"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from quillspark.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(_value, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    if name not in SQL:
        assert len(got) > 0
        return
    r = con.execute(SQL[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    mine = sorted((tuple(_value(x[c]) for c in order) for x in got), key=repr)
    theirs = sorted((tuple(_value(x[cols.index(c)]) for c in order) for x in r.fetchall()), key=repr)
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
