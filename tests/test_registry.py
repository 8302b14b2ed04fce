"""Registered queries against their oracles on the smallest tables."""

import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as entry
from livescope.plans import more, registry  # noqa: F401

TABLES = "/root/testdata/sf0.001"
SOME = ("A2", "B1", "B12", "B20", "C1", "C3", "C7", "C8", "C11", "C13", "D5", "D9", "D10", "E1", "E8", "F2", "F3", "G3", "G9", "G10", "H1", "H4", "I1", "I2", "J2", "J6", "K4", "K7", "K19", "L4", "L10", "L12", "A3", "A3_faults", "A8", "A10", "A11", "B5", "B14", "B15", "B17", "C14", "E12", "F8", "F14", "F16", "F20", "H3", "I3", "J1", "J3", "J4", "M2", "M3", "A7", "L1", "L5", "L6", "B3", "B4")

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{f}'")
    return con


def plain(v):
    if isinstance(v, dt.datetime) and v.time() == dt.time():
        return str(v.date())
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", SOME)
def test_query_matches_its_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, TABLES)
    want = duck.sql(registry.SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    rows = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_sample_rates_of_every_order_are_judged(spark):
    assert registry.QUERIES["B5"](spark, TABLES).count() == spark.read.parquet(f"{TABLES}/orders.parquet").count()
