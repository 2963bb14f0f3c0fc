"""Sketches per file, bounds of key scores, profiles by native values, as-of joins by one shuffle."""

import datetime
import decimal
import random
import re

import pytest
from conftest import SF_DIR, rows
from pyspark.sql import functions as F

from checks import common, profiles, sql_surface
from tablecheck.operators import asof, profile, sketches, smartdiff


def test_sketches_of_files_merge_like_one(spark, tmp_path):
    df = spark.range(30_000).selectExpr("id", "id % 100 AS few", "CAST(id AS STRING) AS t", "CASE WHEN id % 3 = 0 THEN '' END AS hole", "DATE'2024-01-01' + CAST(id % 50 AS INT) AS day", "array(id) AS a")
    df.repartition(5).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    kept = sketches.sketch_files(table)
    assert kept.count() == 5 * 6 and kept.select("file").distinct().count() == 5
    found = {r["column"]: r for r in sketches.estimates(sketches.merge_sketches(kept), (0.0, 0.5, 1.0)).collect()}
    width = 6 * sketches.DISTINCT_ERROR
    for name, exact in (("id", 30_000), ("few", 100), ("t", 30_000), ("day", 50), ("a", 30_000)):
        assert abs(found[name].distinct_estimate - exact) <= width * exact and found[name].row_count == found[name].filled_count == 30_000
    assert found["hole"].filled_count == 0 and found["hole"].distinct_estimate == 0 and found["hole"].quantile_estimates is None
    low, middle, high = found["id"].quantile_estimates
    assert (low, high) == (0, 29_999) and abs(middle - 15_000) <= 30_000 * sketches.RANK_ERROR * 2
    assert found["t"].quantile_estimates is None and found["day"].quantile_estimates[0] == 19723 * 86_400_000_000
    # One file later: only it is read.
    df.withColumn("id", F.col("id") + 30_000).coalesce(1).write.parquet(str(tmp_path / "u"))
    more = kept.unionByName(sketches.sketch_files(spark.read.parquet(str(tmp_path / "u"))))
    both = {r["column"]: r.distinct_estimate for r in sketches.estimates(sketches.merge_sketches(more)).collect()}
    assert abs(both["id"] - 60_000) <= width * 60_000 and abs(both["few"] - 100) <= 2
    per = sketches.estimates(sketches.merge_sketches(sketches.sketch_groups(df, "few", ["id"]), ["few"]))
    assert per.filter("row_count = 300").count() == 100
    with pytest.raises(ValueError):
        sketches.sketch_groups(df, "few", [])


def brute_key(base, other, pairs):
    found = smartdiff.key_stats(base, other, pairs).orderBy(F.col("score").desc(), "pos").first()
    return pairs[0].base if found is None or found.score <= -1 else found.base_column


def test_the_inferred_key_is_that_of_exact_counts(spark, monkeypatch):
    rng = random.Random(4)
    exact = []
    stats = smartdiff.key_stats
    for n in range(8):
        names = rng.sample(["id", "code", "x", "order_key", "y", "note"], 4)
        kinds = [rng.choice(["id", "id % 3", "id div 2", "CASE WHEN id % 4 > 0 THEN id END", "CAST(id AS STRING)", "NULL + id"]) for _ in names]
        df = spark.range(rng.choice([0, 1, 40, 500])).selectExpr(*[f"{k} AS {c}" for k, c in zip(kinds, names)])
        pairs = smartdiff.infer_pairs(df, df)
        monkeypatch.setattr(smartdiff, "key_stats", lambda *a: exact.append(len(a[2])) or stats(*a))
        found = smartdiff.infer_key(df, df, pairs).base
        monkeypatch.setattr(smartdiff, "key_stats", stats)
        assert found == brute_key(df, df, pairs), (names, kinds)
    assert len(exact) < 8 and max(exact, default=0) <= 4


def test_bounds_hold_the_exact_score_and_read_no_values_apart(spark, tables):
    base = tables["orders"]
    pairs = smartdiff.infer_pairs(base, base)
    exact = {r.base_column: r.score for r in smartdiff.key_stats(base, base, pairs).collect()}
    for b in smartdiff.key_bounds(base, base, pairs):
        assert b.low - 1e-9 <= exact[b.pair.base] <= b.high + 1e-9
    mapping, key = smartdiff.infer_match(base, base)
    assert key == ("o_orderkey", "o_orderkey")
    assert smartdiff.smart_diff_summary(base, base, mapping, key).first().unchanged_rows == base.count()
    with_key = smartdiff.smart_diff(base, base, mapping, key)
    assert with_key.filter("status <> 'unchanged'").isEmpty()


def test_profiles_of_native_values(spark):
    one, at = decimal.Decimal, datetime.datetime
    data = [
        (1, 0.0, one("1.10"), True, datetime.date(2024, 1, 1), at(2024, 1, 1, 1, 2, 3, 4), one("1.5"), 1.5),
        (1, -0.0, one("1.10"), False, None, at(2024, 1, 1, 1, 2, 3, 5), one("2.5"), float("inf")),
        (None, float("nan"), one("-7.25"), True, datetime.date(1960, 1, 1), at(1950, 1, 1, 1, 2, 3, 999999), None, float("nan")),
        (9, float("nan"), None, None, datetime.date(1960, 1, 1), None, one("2.5"), 1.5),
    ]
    df = spark.createDataFrame(data, "i int, d double, m decimal(9,2), b boolean, day date, at timestamp_ntz, wide decimal(38,1), f float")
    df = df.withColumn("zoned", F.col("at").cast("timestamp"))
    got = {r["column"]: r for r in profile.column_counts(df).collect()}
    expected = {"i": (3, 2, 3), "d": (4, 2, 2), "m": (3, 2, 3), "b": (3, 2, 0), "day": (3, 2, 0), "at": (3, 3, 0), "wide": (3, 2, 3), "f": (4, 3, 2), "zoned": (3, 3, 0)}
    assert {c: (r.present_count, r.distinct_count, r.numeric_count) for c, r in got.items()} == expected
    assert (got["m"].numeric_min, got["m"].numeric_max, got["m"].numeric_sum) == (-7.25, 1.1, -5.05)
    assert got["b"].boolean_count == 3 and got["day"].date_count == 3 and got["at"].date_count == 3
    text = profile.profile_columns(df)._jdf.queryExecution().executedPlan().toString()
    assert "sha2" in text or "wide" in text  # only the wide numbers go as text
    plain = profile.profile_columns(df.drop("wide"))._jdf.queryExecution().executedPlan().toString()
    assert "sha2" not in plain
    assert profile.column_counts(df.limit(0)).filter("row_count > 0").isEmpty()


def test_top_values_are_whole(spark):
    long = "x" * 300
    data = [(long, 1)] * 3 + [(long + "y", 1)] * 2 + [("short", 2)] * 2 + [(None, None), ("", 3)]
    df = spark.createDataFrame(data, "t string, n int")
    got = rows(profile.top_values(df, 2))
    assert got == [("n", 1, "1", 5), ("n", 2, "2", 2), ("t", 1, long, 3), ("t", 2, "short", 2)]
    assert rows(profile.top_values_text(df.select("t")))[0][1].startswith("x" * 23 + "... (3)")
    assert rows(profile.top_values(df.select("n"), 1)) == [("n", 1, "1", 5)]


@pytest.mark.parametrize("parts", ["1", "7"])
def test_asof_keys_that_span_partitions(spark, parts):
    rng = random.Random(int(parts))
    left = [(i, rng.choice([float("nan"), 0.0, -0.0, 1.0, None]), rng.randrange(60)) for i in range(400)]
    right = [(rng.randrange(60), rng.choice([float("nan"), 0.0, 1.0]), i) for i in range(25)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        a, b = spark.createDataFrame(left, "id int, k double, t int"), spark.createDataFrame(right, "rt int, rk double, v int")
        got = {r.id: r.v for r in asof.asof_join(a, b, "t", "rt", "k", "rk", "left").collect()}
        none = asof.asof_join(a, b.limit(0), "t", "rt", "k", "rk", "left")
        assert none.count() == 400 and none.filter("v IS NOT NULL").isEmpty()
        assert asof.asof_join(a.limit(0), b, "t", "rt", "k", "rk").isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

    def expected(k, t):
        mates = [(r[0], r[2]) for r in right if k is not None and str(r[1] + 0.0) == str(k + 0.0) and r[0] <= t]
        return max(mates)[1] if mates else None

    assert got == {i: expected(k, t) for i, k, t in left}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_asof_over_many_batches_of_a_partition(spark, how):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "7")
    try:
        a = spark.sql("SELECT id, id % 3 AS k, id AS t FROM range(300)")
        b = spark.sql("SELECT id * 40 AS rt, id % 3 AS rk, id AS v FROM range(7)")
        got = {r.id: r.v for r in asof.asof_join(a, b, "t", "rt", "k", "rk", how).collect()}
    finally:
        spark.conf.set(setting, before)
    wanted = {i: max((v for v in range(7) if v % 3 == i % 3 and v * 40 <= i), default=None) for i in range(300)}
    assert got == {i: v for i, v in wanted.items() if how == "left" or v is not None}


def test_asof_with_nested_keys_and_rows(spark):
    a = spark.sql("SELECT struct('x', id % 2) AS k, CAST(id AS INT) AS t, map('a', id) AS m FROM range(20)")
    b = spark.sql("SELECT struct('x', id % 2) AS rk, CAST(id * 5 AS INT) AS rt, array(id) AS r FROM range(4)")
    got = sorted(map(tuple, asof.asof_join(a, b, "t", "rt", "k", "rk", "left").select("t", "rt", "m.a").collect()))
    assert got == [(t, max((x for x in (0, 5, 10, 15) if x <= t and (x // 5) % 2 == t % 2), default=None), t) for t in range(20)]
    assert asof.asof_join(a, b, "t", "rt", "k", "rk").count() == sum(r[1] is not None for r in got)


def test_asof_shuffles_once(spark, tables):
    events = tables["events"]
    views = events.filter("event_type = 'view'").selectExpr("user_id AS u", "ts AS vt", "event_id AS v")
    text = asof.asof_join(events, views, "ts", "vt", "user_id", "u")._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") <= 1  # over a row for each partition


@pytest.mark.parametrize("query", [sql_surface.QUERIES["g_approx"], profiles.file_sketches], ids=["g_approx", "file_sketches"])
def test_sketches_beside_an_exact_count_are_one_for_each_group(spark, query):
    df = query(spark, SF_DIR)
    assert all(x is not False for r in df.collect() for x in r)
    nodes = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "ObjectHashAggregate(" in x]
    assert nodes and not any(re.search(r"l_partkey|[\[ ]v#", x.split("functions=")[0]) for x in nodes)
    assert not any(re.search(r"(?<!approx_)percentile\(", x) for x in nodes)  # holds each value of a group


def test_percentiles_by_rank_are_those_of_all_values(spark):
    rng = random.Random(3)
    data = [(g, v, m) for g in range(300) for m in [rng.choice([1.0, 2.0, rng.random() * 3])] for v in rng.choices([None, 0.0, 1.0, 2.0, 3.0, rng.random() * 3], k=rng.choice([1, 2, 3, 26, 51]))]
    filled = {g for g, v, _ in data if v is not None}
    df = spark.createDataFrame([(g, v, m if g in filled else None) for g, v, m in data], "g int, v double, m double")
    for low, high in ((0.48, 0.52), (0.86, 0.94), (0.0, 1.0), (0.25, 0.5)):
        both = df.groupBy("g", "m").agg(F.expr(common.between_percentiles("v", "m", low, high)).alias("a"), F.expr(f"m BETWEEN percentile(v, {low}) AND percentile(v, {high})").alias("b"))
        assert both.filter("NOT a <=> b").isEmpty() and both.filter("a").count() > 20


def test_approximate_values_of_groups_without_values(spark, tmp_path):
    row = "l_returnflag string, l_partkey long, l_extendedprice double, l_quantity double"
    spark.createDataFrame([(None, 1, None, None), ("A", None, 2.0, 3.0)], row).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = rows(sql_surface.QUERIES["g_approx"](spark, str(tmp_path)))
    assert got == [("A", 0, True, True, True, True), (None, 1, True, True, None, None)]
