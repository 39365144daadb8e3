"""Plans are the ones wanted: pushed filters, semi joins, top-N, group limits, pruned columns."""

from __future__ import annotations

import re

import pytest

from quillon.plans.ast import Query, Start, all_of, any_of, cmp, exists, related
from quillon.plans.compiler import Compiler
from quillon.sources.catalog import parquet_catalog


@pytest.fixture(scope="module")
def compiler(spark, sf):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    return Compiler(parquet_catalog(spark, sf))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(compiler):
    p = plan(compiler.rows(Query("orders", where=all_of(cmp("o_totalprice", ">", 5.0), cmp("o_orderstatus", "=", "F")))).select("o_orderkey"))
    assert "GreaterThan(o_totalprice,5.0)" in p and "EqualTo(o_orderstatus,F)" in p
    assert "o_custkey" not in re.search(r"ReadSchema: (.*)", p)[1]


def test_cursor_leads_with_a_pushed_bound(compiler):
    q = Query("orders", start=Start((("o_custkey", 50), ("o_totalprice", 9.0)), True), order_by=(("o_custkey", "asc"), ("o_totalprice", "desc")), limit=5)
    p = plan(compiler.rows(q))
    assert "GreaterThanOrEqual(o_custkey,50)" in p and "TakeOrderedAndProject" in p and "Exchange" not in p


def test_subqueries_become_joins(compiler):
    big = exists("c_custkey", "o_custkey", Query("orders", where=cmp("o_totalprice", ">", 100.0)))
    p = plan(compiler.rows(Query("customer", where=big)))
    assert "LeftSemi" in p and "GreaterThan(o_totalprice,100.0)" in p
    assert "LeftAnti" in plan(compiler.rows(Query("orders", where=exists("o_orderkey", "l_orderkey", Query("lineitem"), negated=True))))
    p = plan(compiler.rows(Query("customer", where=any_of(big, cmp("c_acctbal", ">", 1.0)))))
    assert "LeftOuter" in p and "CartesianProduct" not in p and "NestedLoop" not in p


def test_limit_per_parent_is_cut_before_the_shuffle(compiler):
    q = Query("customer", related=(related("c_custkey", "o_custkey", Query("orders", order_by=(("o_totalprice", "desc"),), limit=3)),))
    assert plan(compiler.flat(q)[1][2]).count("WindowGroupLimit") >= 1


def test_false_permissions_read_nothing(compiler):
    p = plan(compiler.rows(Query("customer", where=any_of())))
    assert "Scan" not in p and "LocalTableScan <empty>" in p or "FileScan" not in p
