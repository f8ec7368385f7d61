"""The registry of queries and their SQL counterparts, compared on the smallest tables."""

import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
PICK = ["flagship", "scan_filter", "join_full", "agg_group", "sum_having_min", "qualify_is_first", "array_subquery", "recursive_hierarchy", "substr_edges", "date_diff_boundaries", "json_value", "search_words", "then_return", "cast_to_int64", "operators", "not_in_with_nulls", "string_forms", "math_safe_bits", "timestamp_arithmetic", "array_suite", "json_changing", "net_suite", "search_tokens", "column_formats", "is_index_columns", "constraints", "errors_raised"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not there")


def shaped(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", PICK)
def test_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    got = __spark_entry__.queries()[name](spark, SF)
    want = c.sql(__spark_entry__.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    assert sorted((tuple(shaped(r[n]) for n in names) for r in got.collect()), key=str) == sorted((tuple(shaped(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) > 180


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["nation", "line_count", "revenue"]


def test_pushdown(spark):
    from lumenql.queries import database

    plan = database(spark, SF, "lineitem").explain("SELECT l_orderkey FROM lineitem WHERE l_quantity > 45")
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan and "ReadSchema: struct<l_orderkey" in plan


def test_extremes_without_windows(spark):
    """HAVING MAX and MIN gather no group in one task: the extremes are aggregated apart."""
    from lumenql.queries import database

    db = database(spark, SF, "orders")
    for sql in ("SELECT SUM(o_orderkey HAVING MAX o_custkey) AS s FROM orders", "SELECT o_orderstatus, SUM(o_orderkey HAVING MIN o_custkey) AS s FROM orders GROUP BY o_orderstatus"):
        plan = db.explain(sql)
        assert "Window" not in plan and "Python" not in plan
