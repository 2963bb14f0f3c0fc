import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablecheck.operators import asof, charts, profile, query, writetypes
from tablecheck.plans import aggregate, spreading


@pytest.fixture(scope="module")
def texts(spark):
    data = [
        ("true", "1", "1.7", "2024-01-01", "2024-01-01 10:00", "1", None),
        ("FALSE", "2", "2.5", "2024-02-01", "2024-01-01T11:30:00", "x", ""),
        ("", None, "-3e2", "2024-03-01", "2024-01-02", "2024-01-01", None),
    ]
    return spark.createDataFrame(data, "flag string, n string, d string, day string, at string, mixed string, nothing string")


def test_write_types(texts):
    got = {r.column: (r.write_type, r.missing_count) for r in writetypes.infer_write_types(texts).collect()}
    assert got == {
        "flag": ("BOOLEAN", 1),
        "n": ("BIGINT", 1),
        "d": ("DOUBLE", 0),
        "day": ("DATE", 0),
        "at": ("TIMESTAMP", 0),
        "mixed": ("VARCHAR", 0),
        "nothing": ("VARCHAR", 3),
    }
    cast = writetypes.cast_columns(texts, {c: t for c, (t, _) in got.items()})
    assert [t for _, t in cast.dtypes] == ["boolean", "bigint", "double", "date", "timestamp_ntz", "string", "string"]
    assert writetypes.write_type("decimal(9)") == "DECIMAL(18, 4)" and writetypes.write_type("blob") == "VARCHAR"


def test_typed_columns_keep_their_kind(spark):
    df = spark.sql("SELECT true AS b, 1.5D AS d, 2.0D AS w, DATE'2024-01-01' AS day, CAST('NaN' AS DOUBLE) AS nan, array(1) AS a")
    got = {r.column: r.write_type for r in writetypes.infer_write_types(df).collect()}
    assert got == {"b": "BOOLEAN", "d": "DOUBLE", "w": "BIGINT", "day": "DATE", "nan": "VARCHAR", "a": "VARCHAR"}


def test_rounding_to_whole_numbers(spark):
    df = spark.createDataFrame([("1.7", 1.7), ("2.5", 2.5), ("3.5", -2.5), ("9007199254740993", 0.0), ("x", None)], "t string, d double")
    got = rows(writetypes.cast_columns(df, {"t": "BIGINT", "d": "BIGINT"}))
    assert got == sorted([(2, 2), (2, 2), (4, -2), (9007199254740993, 0), (None, None)], key=lambda t: tuple((v is None, str(v)) for v in t))


def test_profile_counts(texts):
    got = {r.column: r for r in profile.profile_columns(texts).collect()}
    assert got["flag"].missing_count == 1 and got["flag"].distinct_count == 2
    assert got["d"].numeric_count == 3 and got["d"].numeric_min == -300.0 and abs(got["d"].numeric_mean + 295.8 / 3) < 1e-9
    assert got["nothing"].present_count == 0 and got["nothing"].distinct_ratio == 0.0
    kinds = dict(rows(profile.profile_types(texts)))
    assert kinds == {"flag": "boolean", "n": "numeric", "d": "numeric", "day": "date", "at": "date", "mixed": "categorical", "nothing": "empty"}


def test_exact_and_approximate_agree_on_small_tables(tables):
    for name in ("nation", "events", "labels"):
        exact, approx = profile.column_counts(tables[name]), profile.column_counts(tables[name], approx=True)
        same = ["column", "row_count", "present_count", "numeric_count", "boolean_count", "date_count", "numeric_min", "numeric_max", "inferred_type"]
        assert rows(exact.select(*same)) == rows(approx.select(*same))


def test_category_boundary(spark):
    def kind(distinct, n):
        df = spark.range(n).select(F.concat(F.lit("w"), F.col("id") % distinct).alias("c"))
        return profile.profile_types(df).first().inferred_type

    assert (kind(20, 40), kind(21, 40)) == ("categorical", "text")
    assert (kind(41, 201), kind(42, 201)) == ("categorical", "text")  # ceil(0.2 * 201) = 41


def test_long_values_are_told_apart_beyond_any_prefix(spark):
    df = spark.createDataFrame([("x" * 500 + "a",), ("x" * 500 + "b",), ("x" * 500 + "a",)], "t string")
    assert profile.profile_columns(df).first().distinct_count == 2
    assert profile.duplicate_rows(df).first()[0] == 1
    top = profile.top_values(df).orderBy("rank").collect()
    assert [(r.value, r.value_count) for r in top] == [("x" * 500 + "a", 2), ("x" * 500 + "b", 1)]
    assert profile.top_values_text(df).first().top_values == "x" * 23 + "... (2), " + "x" * 23 + "... (1)"


def test_long_numbers_are_numbers(spark):
    df = spark.createDataFrame([("1" * 90,), ("0." + "3" * 80,), (" " * 70 + "5",), ("9" * 400,), ("a" + "1" * 90,)], "t string")
    got = profile.profile_columns(df).first()
    assert (got.numeric_count, got.distinct_count, got.numeric_max) == (3, 5, float("1" * 90))


def test_duplicates_treat_null_and_empty_alike(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (1, "NULL"), (2, "a"), (None, "a"), (None, "a")], "k int, t string")
    assert profile.duplicate_rows(df).first()[0] == 3


def test_wide_tables_take_several_passes(spark):
    df = spark.range(6).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(230)])
    got = {r.column: r.distinct_count for r in profile.profile_columns(df).collect()}
    assert got == {f"c{i}": min(i + 1, 6) for i in range(230)}


def test_findings(spark):
    df = spark.range(10).select(
        F.lit(1).alias("same"), F.when(F.col("id") < 2, None).otherwise(F.col("id")).alias("gaps"), F.lit(None).cast("string").alias("none")
    )
    got = rows(profile.eda_findings(df))
    assert got == [("constant_column", "same", None), ("duplicate_rows", None, 1.0), ("empty_column", "none", None), ("high_missing", "gaps", 0.2)]
    assert rows(profile.eda_findings(spark.range(3))) == [("no_issues", None, None)]
    assert ("no_rows", None, None) in rows(profile.eda_findings(spark.range(0)))
    advice = [(r.suggestion, r["columns"]) for r in profile.suggestions(df).orderBy("rank").collect()]
    assert advice == [("review_missing", ["gaps", "none"]), ("check_duplicates", []), ("identifier_like", ["gaps"])]
    assert profile.suggestions(spark.range(0)).first().suggestion == "start_with_charts"


def test_charts(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", -9.0), ("", 3.0), (None, None), ("a", 4.0)], "x string, y double")
    assert [tuple(r) for r in charts.bar_data(df, "x", "y", "sum").collect()] == [("b", -9.0), ("a", 5.0), ("-", 3.0)]
    assert [tuple(r) for r in charts.bar_data(df, "x").collect()] == [("-", 2.0), ("a", 2.0), ("b", 1.0)]
    line = spark.createDataFrame([("10",), ("9",), ("z",), ("2024-01-01",)], "x string")
    assert [r.label for r in charts.line_data(line, "x").collect()] == ["9", "10", "2024-01-01", "z"]
    assert charts.bar_data(spark.range(300), "id", limit=1000).count() == 300 and charts.bar_data(spark.range(300), "id").count() == 25
    assert charts.scatter_data(df.withColumnRenamed("y", "z"), "z", "z").count() == 4
    with pytest.raises(ValueError):
        charts.bar_data(df, "x", None, "sum")


def test_histogram(spark, tables):
    bins = charts.histogram(tables["lineitem"], "l_extendedprice", 12).orderBy("bin").collect()
    assert len(bins) == 12 and sum(b["count"] for b in bins) == tables["lineitem"].count()
    flat = charts.histogram(spark.range(4).select(F.lit(5).alias("x")), "x", 1).orderBy("bin").collect()
    assert [b["count"] for b in flat] == [4] and (flat[0].bin_start, flat[0].bin_end) == (5.0, 6.0)
    assert len(charts.histogram(spark.range(4), "id", 99).collect()) == 99
    with pytest.raises(ValueError):
        charts.histogram(spark.range(4), "id", -1)


def test_sql_is_read_only(spark, tables):
    df = tables["nation"]
    assert query.run_sql(spark, df, "").count() == 25
    assert query.run_sql(spark, df, 'select "n_name" from parquet_data -- all ;').count() == 25
    assert query.run_sql(spark, df, "WITH a AS (SELECT 1 AS x) SELECT * FROM a;;").first().x == 1
    for bad in ("DROP VIEW file_data", "INSERT INTO x SELECT 1", "SHOW TABLES"):
        with pytest.raises(ValueError):
            query.run_sql(spark, df, bad)
    with pytest.raises(Exception):
        query.run_sql(spark, df, "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a")
    assert spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers") == "false"


def test_sql_leaves_views_alone(spark, tables):
    spark.range(3).createOrReplaceTempView("nation_view")
    found = query.run_sql(spark, {"nation_view": tables["nation"], "other": tables["region"]})
    assert found.count() == 25 and spark.table("nation_view").count() == 3
    assert not spark.catalog.tableExists("other") and not spark.catalog.tableExists("file_data")
    spark.catalog.dropTempView("nation_view")
    with pytest.raises(ValueError):
        query.run_sql(spark, {})


def test_pages(spark):
    df = spark.range(25).select((F.col("id") % 5).alias("k"), "id")
    pages = [query.page(df, ["k"], o, 10) for o in (0, 10, 20)]
    assert [p.has_more() for p in pages] == [True, True, False]
    joined = [tuple(r) for p in pages for r in p.rows.collect()]
    assert joined == sorted((i % 5, i) for i in range(25))
    seen, last = [], None
    while True:
        got = [r.asDict() for r in query.page_after(df, ["k", "id"], last, 7).collect()]
        if not got:
            break
        seen += [(r["k"], r["id"]) for r in got]
        last = got[-1]
    assert seen == joined


def test_keyset_pages_reach_nulls(spark):
    df = spark.createDataFrame([(1, 1), (None, 2), (2, 3), (None, 4)], "k int, id int")
    first = query.page_after(df, ["k", "id"], None, 3).collect()
    rest = query.page_after(df, ["k", "id"], first[-1].asDict(), 3).collect()
    assert [r.id for r in first] == [1, 3, 2] and [r.id for r in rest] == [4]


def test_sort_order(spark):
    values = ["10", "9", None, "zebra", "2024-02-01", "2023-12-31 10:00", "apple"]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    up = [r.c for r in query.sort_rows(df, "c").collect()]
    assert up == ["9", "10", "2023-12-31 10:00", "2024-02-01", "apple", "zebra", None]
    assert [r.c for r in query.sort_rows(df, "c", "desc").collect()] == up[::-1]
    placed = {r.c: r.position for r in query.sorted_positions(df, "c").collect()}
    assert placed == {v: i for i, v in enumerate(up)}


def test_quick_aggregates_and_columns(spark, tables):
    with pytest.raises(ValueError):
        query.quick_aggregate(tables["nation"], "n_name", "median", "n_nationkey")
    with pytest.raises(ValueError):
        query.quick_aggregate(tables["nation"], "n_name", "sum")
    assert query.quick_aggregate(tables["lineitem"], "l_partkey", limit=99999).count() <= 1000
    assert query.choose_columns(tables["nation"], []).columns == tables["nation"].columns
    df = spark.createDataFrame([("x", "7", 1, None)], "a string, b string, c int, d double")
    assert rows(query.numeric_columns(df).select("column")) == [("b",), ("c",), ("d",)]


def test_asof_hot_key_against_brute_force(spark):
    left = [(i, "hot" if i % 3 else f"k{i}", i * 10) for i in range(60)] + [(99, None, 5), (98, "hot", None)]
    left += [(200 + i, "hot", 77) for i in range(30)]
    right = [(i * 7, "hot", f"r{i}") for i in range(40)] + [(0, "k3", "s"), (77, "hot", "r9"), (77, "hot", "r0"), (None, "hot", "n")]
    a = spark.createDataFrame(left, "id int, k string, t int")
    b = spark.createDataFrame(right, "rt int, rk string, name string")
    got = {r.id: r.name for r in asof.asof_join(a, b, "t", "rt", "k", "rk", "left").collect()}

    def expected(k, t):
        mates = [r for r in right if None not in (k, t, r[0]) and r[1] == k and r[0] <= t]
        return max(mates)[2] if mates else None

    assert got == {i: expected(k, t) for i, k, t in left}
    inner = asof.asof_join(a, b, "t", "rt", "k", "rk").count()
    assert inner == sum(v is not None for v in got.values())


def test_range_join_against_brute_force(spark):
    points = [(i, (i * 37) % 101) for i in range(200)] + [(999, None)]
    ranges = [(j, j * 5, j * 5 + (j % 4) * 9) for j in range(20)] + [(77, 50, 40), (78, None, 9)]
    a, b = spark.createDataFrame(points, "i int, p int"), spark.createDataFrame(ranges, "j int, lo int, hi int")
    got = rows(asof.range_join(a, "p", b, "lo", "hi").select("i", "j"))
    expected = [(i, j) for i, p in points for j, lo, hi in ranges if None not in (p, lo, hi) and lo <= p <= hi]
    assert got == sorted(expected, key=lambda t: tuple((v is None, str(v)) for v in t))


@pytest.mark.parametrize("passes", [1, 2, 16])
def test_large_tables_are_counted_a_few_columns_at_a_time(spark, tables, monkeypatch, passes):
    df = tables["lineitem"].selectExpr("*", "nullif(l_tax, 0.0) AS hole", "CAST(l_quantity AS DECIMAL(9, 2)) AS exact", "l_tax > 0.04 AS flag", "array(l_linenumber) AS nested", "CAST('NaN' AS DOUBLE) AS nan")

    def counts():
        found = profile.column_counts(df)
        return found.select(*[F.round(c, 4).alias(c) if t == "double" else c for c, t in found.dtypes])

    whole, tops = rows(counts()), rows(profile.top_values(df, 2))
    monkeypatch.setattr(spreading, "SMALL_TABLE", 0)
    monkeypatch.setattr(aggregate, "PASSES", passes)
    large = counts()
    assert rows(large) == whole and rows(profile.top_values(df, 2)) == tops
    if passes == 16:
        # Each pass groups by the values of one column.
        text = large._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"Relation .* parquet", text)) == len(df.columns) and not re.search(r"stack\(([2-9]|1\d)", text)


def test_columns_of_a_join_are_counted_together(spark, tables, monkeypatch):
    monkeypatch.setattr(spreading, "SMALL_TABLE", 0)
    joined = tables["orders"].join(tables["customer"].hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
    fields = list(enumerate(joined.schema.fields))
    assert aggregate.passes_over(joined, fields) == [fields]
    assert aggregate.passes_over(tables["orders"], fields[:3]) == [[f] for f in fields[:3]]
    assert aggregate.passes_over(tables["orders"].filter("o_custkey > 5").withColumn("x", F.upper("o_orderstatus")), fields[:2]) == [[f] for f in fields[:2]]
