"""The registered queries: every one runs, agrees with its twin, and keeps its plan spread out."""

import duckdb
import pytest
from conftest import SF_DIR

import __spark_entry__ as entry
from checks import diffs, files, formats, profiles, relations, run, sql_surface
from checks.common import CHECK_DIR, TABLES

# Queries whose twin reads the files of the check folder by path.
BY_PATH = {n for n, t in entry.oracle_sql().items() if CHECK_DIR in t}


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return found


def test_every_query_of_the_reference_has_a_twin():
    for part in (diffs, files, formats, profiles, relations, sql_surface):
        assert set(part.QUERIES) == set(part.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - BY_PATH))
def test_twin(spark, db, name):
    result = run.compare(spark, db, name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", sorted(BY_PATH))
def test_twin_of_file_queries(spark, db, name):
    twin = entry.oracle_sql()[name].replace(CHECK_DIR, SF_DIR)
    result = run.compare(spark, db, name, entry.queries()[name], twin, SF_DIR)
    assert result.startswith("ok"), result


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["table", "level", "category", "subject", "message", "recommendation"]
    assert {r.table for r in found.select("table").distinct().collect()} == {f"{t}.parquet" for t in TABLES}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["quick_agg_sum", "join_full", "smart_diff", "smart_diff_summary", "apply_edits", "g_window_rank", "profile_types"])
def test_no_cross_join_and_no_python(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "MapInPandas", "BatchEvalPython"):
        assert word not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(entry.queries()["scan_parquet"](spark, SF_DIR))
    assert "GreaterThan(l_quantity,25.0)" in text
    assert "l_comment" not in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double,l_shipdate" in text
