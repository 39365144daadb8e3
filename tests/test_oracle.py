"""Every registered relational query against its SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

import quillon.state_queries  # noqa: F401  registers its queries
from quillon.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    norm = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert norm(got.select(*columns).collect()) == norm(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
