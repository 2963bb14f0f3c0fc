import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablecheck.functions import names
from tablecheck.operators import query
from tablecheck.plans import ordering, slicing


def test_index_equals_sorted_place_with_ties_and_nulls(spark):
    random.seed(3)
    data = [(random.choice([None, 1, 2, 2, 2, 5]), random.choice(["a", "b", None])) for _ in range(500)]
    df = spark.createDataFrame(data, "k int, t string")
    got = ordering.with_row_index(df, [ordering.Key(F.col("k"))]).orderBy("row_index").collect()
    expected = sorted(data, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    assert [(r.row_index, r.k, r.t) for r in got] == [(i, *r) for i, r in enumerate(expected)]


def test_copies_are_spread_over_partitions(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 4 != 0, -5).otherwise(F.col("id")).alias("k"), F.lit("x").alias("t"))
    got = ordering.with_row_index(df, [ordering.Key(F.col("k"))])
    assert sorted(r.row_index for r in got.collect()) == list(range(4000))
    assert tuple(got.filter("k = -5").agg(F.min("row_index"), F.max("row_index"), F.count("*")).first()) == (0, 2999, 3000)
    parts = got.filter("k = -5").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 2000


def test_any_names_and_types_can_be_numbered(spark):
    df = spark.sql("SELECT id AS `a b.c;{}`, NULL AS i, id AS `x=` FROM range(5)")
    got = ordering.with_row_index(df, [ordering.Key(F.col("`a b.c;{}`"), descending=True)])
    assert sorted((r[0], r[1]) for r in got.select("row_index", "`a b.c;{}`").collect()) == [(i, 4 - i) for i in range(5)]
    assert got.columns == ["row_index", *df.columns]
    kept = ordering.with_row_index(df.drop("i"), [ordering.Key(F.col("`x=`"))])
    assert kept.columns == ["row_index", "a b.c;{}", "x="] and kept.count() == 5


def test_empty_tables_are_numbered(spark):
    assert ordering.with_row_index(spark.range(0), [ordering.Key(F.col("id"))]).isEmpty()


def test_unsortable_columns_ride_along(spark):
    df = spark.createDataFrame([(2, {"a": 1}), (1, {"b": 2}), (1, {"a": 9})], "k int, m map<string,int>")
    got = ordering.with_row_index(df, [ordering.Key(F.col("k"), descending=True)]).orderBy("row_index").collect()
    assert [r.m for r in got] == [{"a": 1}, {"a": 9}, {"b": 2}]


def test_no_wide_single_partition(spark, tables):
    df = ordering.with_row_index(tables["orders"], [ordering.Key(F.col("o_orderdate"))])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan and "hashpartitioning" not in plan


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cuts=st.lists(st.floats(-50, 50), unique=True, max_size=30), points=st.lists(st.floats(-60, 60), min_size=1, max_size=20))
def test_slice_number(spark, cuts, points):
    cuts = sorted(cuts)
    df = spark.createDataFrame([(p,) for p in points], "p double")
    got = df.select("p", slicing.slice_number(F.col("p"), cuts).alias("s")).collect()
    assert all(r.s == sum(c < r.p for c in cuts) for r in got)


def test_unique_names():
    assert names.unique_names(["x", "x", "x_2", "", " "]) == ["x", "x_3", "x_2", "column", "column_2"]
    assert names.unique_view_names(["a-b.csv", "A_b.json", "1.csv", "--.csv"]) == ["a_b", "A_b_2", "_1", "data"]


def test_pages_at_any_offset(spark):
    data = [(random.Random(i).choice([None, 1, 2, 2, 5]), f"t{i % 37}") for i in range(700)]
    pages = query.open_pages(spark.createDataFrame(data, "k int, t string"), ["k"])
    expected = sorted(data, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert pages.total == 700
    for offset, limit in ((0, 10), (345, 100), (690, 50), (0, 700), (700, 5), (9999, 5)):
        page = pages.page(offset, limit)
        assert [tuple(r) for r in page.rows.collect()] == expected[offset : offset + limit]
        assert page.has_more() == (offset + limit < 700)
    assert pages.rows(5, 0).isEmpty() and pages.rows(-1, 3).isEmpty()
    assert query.open_pages(spark.createDataFrame([], "k int"), ["k"]).rows(0).isEmpty()


def test_a_page_is_a_range_that_reaches_the_scan(spark, tables):
    pages = query.open_pages(tables["lineitem"], ["l_shipdate"])
    text = pages.rows(4000, 100)._jdf.queryExecution().executedPlan().toString()
    pushed = text.split("PushedFilters: [", 1)[1].split("]")[0]
    assert "GreaterThanOrEqual" in pushed and "LessThanOrEqual" in pushed and "Offset" not in text and "CollectLimit" not in text
