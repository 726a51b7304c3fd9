"""Every registered query runs at the smallest scale and equals its reference SQL where it has one."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from townloom.plans.fixtures import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else "%.4f" % v
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLES:
        return
    rel = duck.sql(ORACLES[name])
    names, rows = rel.columns, rel.fetchall()
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(text(r[i]) for i in at) for r in rows)


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES)
    assert entry.entry(spark).count() > 0
