"""Every registered query that has SQL must agree with DuckDB; the others must keep their schema and rows."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from quire.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    found = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        found.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return found


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    return x


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, data, con, name):
    want = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted((tuple(map(plain, r)) for r in got.select(*want.columns).collect()), key=repr)
    assert rows == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows_only(spark, data, name):
    first = catalog.QUERIES[name](spark, data)
    again = catalog.QUERIES[name](spark, data)
    rows = first.collect()
    assert rows and first.schema == again.schema
    assert sorted(map(repr, rows)) == sorted(map(repr, again.collect()))
