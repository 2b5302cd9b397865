"""Queries of passes, statistics and search against their SQL where orders repeat amounts, days and names."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry

PASSES = (
    "mt4_exact_match", "mt5_tolerance_match", "mt5_tenth_tolerance", "mt6_fuzzy_match", "mt7_scoped_tolerances", "mt7_mt15_rule_hits", "mt8_same_account", "mt10_withheld_tax",
    "mt14_relaxed_rerun", "mt15_pass_counts",
)
OTHERS = ("v1_run_statistics", "v8_trend", "io6_run_export", "lk1_search_other_side")


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Orders of two months, each five times under shifted keys that keep the name in some copies and change it in others."""
    folder = tmp_path_factory.mktemp("repeated")
    rows = [(k + 301 * c, 3 * k + 9 * c, 90_000.0 + 31_000 * (k % 9), dt.datetime(2000, 1 + k % 2, 1 + 5 * k % 28)) for k in range(1, 25) for c in range(5)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


@pytest.mark.parametrize("name", (*PASSES, *OTHERS))
def test_query_is_what_its_sql_says_where_rows_are_alike(spark, repeated, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{repeated}/orders.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = [tuple(r) for r in entry.queries()[name](spark, repeated).select(*columns).collect()]
    assert want and sorted(map(repr, got)) == sorted(map(repr, want))
