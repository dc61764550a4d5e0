"""Registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from quorate.plans.oracle import ORACLE
from quorate.plans.queries import registered

DATA = "/root/testdata/sf0.001"
NAMES = sorted(registered())

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def plain(value):
    return round(float(value), 9) if isinstance(value, (float, Decimal)) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(registered()) == set(ORACLE)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    got = registered()[name](spark, DATA)
    expected = duck.execute(ORACLE[name])
    names = [c[0] for c in expected.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, expected.fetchall())
