"""Each query of the catalogue against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from recordflow import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    rows = df.orderBy("rn").collect()
    assert [r["rn"] for r in rows] == list(range(1, len(rows) + 1))
    assert [r["rec"] for r in rows] == sorted({r["rec"] for r in rows})


def test_contract():
    names = set(__spark_entry__.queries())
    assert set(catalog.QUERIES) <= names and set(__spark_entry__.oracle_sql()) <= names


def test_generated(spark):
    assert catalog.QUERIES["generate_sort_distinct"](spark, DATA).count() == 10_000 - 4096
