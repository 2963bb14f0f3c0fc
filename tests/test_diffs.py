import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablecheck.operators import compare, edits, joins, jsonshape, smartdiff
from tablecheck.plans import joining

NAN = float("nan")


def test_mapping_rules(spark):
    base = spark.sql("SELECT 1 AS id, 'a' AS Name, 1.0D AS total_price, named_struct('x', 1) AS nested, 2 AS lonely")
    other = spark.sql("SELECT 1L AS ID, 'a' AS name, 2.0D AS `Total-Price`, named_struct('x', 1) AS nested, 'z' AS other")
    got = {p.base: (p.compare, p.match_type, p.confidence) for p in smartdiff.infer_pairs(base, other)}
    assert got == {
        "id": ("ID", "case-insensitive", 0.96),
        "Name": ("name", "case-insensitive", 0.96),
        "total_price": ("Total-Price", "normalized", 0.9),
        "nested": ("nested", "exact", 1.0),
    }
    skipped = smartdiff.infer_mapping(base, other).filter("match_type = 'skipped'")
    assert rows(skipped.select("base_column", "compare_column")) == [("lonely", None), (None, "other")]
    with pytest.raises(ValueError):
        smartdiff.infer_pairs(spark.sql("SELECT 1 AS a"), spark.sql("SELECT 'x' AS a"))
    assert smartdiff.mapping_counts(smartdiff.infer_pairs(base, other)) == (3, 1)


def test_fuzzy_boundary(spark):
    def pair(a, b):
        return spark.sql(f"SELECT 1 AS `{a}`"), spark.sql(f"SELECT 1 AS `{b}`")

    # Likeness 2 * 7 / 18 = 0.778 is too little, 2 * 7 / 17 = 0.82 is enough.
    with pytest.raises(ValueError):
        smartdiff.infer_pairs(*pair("abcdefghi", "abcdefgxy"))
    assert smartdiff.infer_pairs(*pair("abcdefghi", "abcdefgx"))[0].match_type == "fuzzy"


def test_strict_and_custom_mapping(spark):
    a, b = spark.sql("SELECT 1 AS x, 'q' AS y"), spark.sql("SELECT 1 AS z, 'q' AS y")
    with pytest.raises(ValueError):
        compare.check_mapping(a, b)
    assert [p.display for p in compare.check_mapping(a, b, [("x", "z"), ("y", "y")])] == ["x -> z", "y"]
    for bad in ([], [("x", "y")], [("x", "z"), ("x", "z")], [("w", "z")], [("x", "w")]):
        with pytest.raises(ValueError):
            compare.check_mapping(a, b, bad)
    with pytest.raises(ValueError):
        compare.check_order(a, b, None)
    with pytest.raises(ValueError):
        compare.check_order(a, b, ("x", "y"))


def test_key_prefers_unique_named_column(spark):
    base = spark.sql("SELECT id AS amount, id % 3 AS group_id, CAST(id AS string) AS customer_id FROM range(30)")
    pairs = smartdiff.infer_pairs(base, base)
    assert smartdiff.infer_key(base, base, pairs).base == "customer_id"


def brute_diff(base, other):
    """Full join on a null-safe key, pair by pair."""
    out, used = [], set()
    for k, v in base:
        mates = [j for j, (k2, _) in enumerate(other) if k2 == k]
        used.update(mates)
        for j in mates:
            out.append((k, "unchanged" if other[j][1] == v else "value_mismatch"))
        if not mates:
            out.append((k, "missing_in_compare"))
    out += [(k, "missing_in_base") for j, (k, _) in enumerate(other) if j not in used]
    return sorted(out, key=str)


def test_diff_with_null_and_repeated_keys(spark):
    base = [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, None), (5, None)]
    other = [(1, "a"), (1, "x"), (3, "y"), (None, "d"), (5, None)]
    a, b = spark.createDataFrame(base, "id int, v string"), spark.createDataFrame(other, "id int, v string")
    diff = smartdiff.smart_diff(a, b, key=("id", "id"))
    got = sorted(((None if r.key is None else int(r.key), r.status) for r in diff.collect()), key=str)
    assert got == brute_diff(base, other)
    s = smartdiff.smart_diff_summary(a, b, key=("id", "id")).first()
    states = [x[1] for x in got]
    assert (s.inserted_rows, s.deleted_rows, s.changed_rows, s.unchanged_rows) == tuple(
        states.count(k) for k in ("missing_in_base", "missing_in_compare", "value_mismatch", "unchanged")
    )
    assert s.rows_compared == len(got) and s.duplicate_keys == 2
    assert smartdiff.smart_diff(a.filter("id = 2"), a.filter("id = 2"), key=("id", "id")).filter("status <> 'unchanged'").isEmpty()


def test_nan_and_null(spark):
    a = spark.createDataFrame([(1, NAN), (2, None), (3, 1.0)], "id int, v double")
    b = spark.createDataFrame([(1, NAN), (2, 0.0), (3, None)], "id int, v double")
    plain = {r.key: r.status for r in smartdiff.smart_diff(a, b, key=("id", "id")).collect()}
    assert plain == {"1": "unchanged", "2": "value_mismatch", "3": "value_mismatch"}
    strict = {r.key: r.status for r in smartdiff.smart_diff(a, b, key=("id", "id"), nan_as_mismatch=True).collect()}
    assert strict["1"] == "value_mismatch"
    assert smartdiff.smart_diff_summary(a, b, key=("id", "id"), nan_as_mismatch=True).first().changed_rows == 3
    assert smartdiff.smart_diff_summary(a, b, key=("id", "id")).first().changed_rows == 2


def test_hot_key_diff_is_whole(spark):
    """A third of the rows share one key on one side."""
    a = spark.range(900).select(F.when(F.col("id") < 300, -1).otherwise(F.col("id")).alias("id"), F.col("id").alias("v"))
    b = spark.createDataFrame([(-1, 5), (400, 400), (5000, 1)], "id long, v long")
    diff = smartdiff.smart_diff(a, b, key=("id", "id")).groupBy("status").count()
    assert dict(rows(diff)) == {"unchanged": 2, "value_mismatch": 299, "missing_in_compare": 599, "missing_in_base": 1}


def test_positional(spark):
    base = spark.createDataFrame([(3, "c"), (1, "a"), (None, "n"), (2, "b")], "o int, v string")
    other = spark.createDataFrame([(1, "a"), (2, "x")], "o int, v string")
    got = compare.positional_compare(base, other, order=("o", "o"))
    assert rows(got.select("row_index", "status", F.array_join("mismatched_columns", ","))) == [
        (1, "value_mismatch", "v"),
        (2, "missing_in_compare", "o,v"),
        (3, "missing_in_compare", "o,v"),
    ]
    summary = compare.compare_summary(base, other, got).first()
    assert summary.asDict() == {
        "total_rows_base": 4,
        "total_rows_compare": 2,
        "rows_compared": 4,
        "mismatch_count": 3,
        "value_mismatches": 1,
        "missing_in_base": 0,
        "missing_in_compare": 2,
        "truncated": False,
    }
    hidden = compare.positional_compare(base, other, [("v", "v")], ("o", "o"))
    assert hidden.count() == 3 and "base.o" not in hidden.columns


def test_hot_keys_are_found(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    assert joining.hot_keys(df, F.col("k")) == {None, "hot"}
    assert joining.hot_keys(spark.range(9000).select(F.col("id").cast("string").alias("k")), F.col("k")) == set()


@pytest.mark.parametrize("how", joins.JOIN_KINDS)
@pytest.mark.parametrize("null_safe", [False, True])
def test_hot_joins_against_spark(spark, how, null_safe):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        third = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7.0).otherwise(F.col("id").cast("double"))
        a = spark.range(60).select(third.alias("k"), F.col("id").alias("v"))
        b = spark.range(40, 90).select(F.when(F.col("id") < 70, 11.0).when(F.col("id") == 71, None).otherwise(F.col("id").cast("double")).alias("j"), F.col("id").alias("w"))
        for right in (b, b.union(b.limit(0)).filter("j > 20"), b.withColumn("j", F.when(F.col("w") < 60, 7.0).otherwise(F.col("j")))):
            match = F.col("k").eqNullSafe(F.col("j")) if null_safe else F.col("k") == F.col("j")
            got = joining.outer_join(a, right, F.col("k"), F.col("j"), how, null_safe)
            assert rows(got.select("k", "v", "j", "w")) == rows(a.join(right, match, how))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("how", joins.JOIN_KINDS)
def test_joins_against_spark(spark, how):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "`k.x` int, v string")
        b = spark.createDataFrame([(1, "p"), (3, "q"), (None, "r"), (1, "s")], "j int, v string")
        got = joins.join_tables(a, b, "k.x", "j", how)
        assert got.columns == ["base.k.x", "base.v", "join.j", "join.v"]
        expected = a.toDF("k", "v").join(b.toDF("j", "w"), F.col("k") == F.col("j"), how)
        assert rows(got) == rows(expected)
        assert joins.join_count(a, b, "k.x", "j", how).first()[0] == expected.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_keys_of_unequal_types_meet(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.range(30).select(F.when(F.col("id") < 20, 7).otherwise(F.col("id")).alias("k"))
        b = spark.createDataFrame([(7.0,), (25.0,), (99.5,)], "j double")
        got = joining.outer_join(a, b, F.col("k"), F.col("j"), "full", False)
        assert rows(got) == rows(a.join(b, F.col("k") == F.col("j"), "full"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_diff_of_unequal_number_types(spark):
    a = spark.sql("SELECT 1 AS id, 10000000000000001BD AS v UNION ALL SELECT 2, 2BD")
    b = spark.sql("SELECT 1L AS id, 10000000000000002.0BD AS v UNION ALL SELECT 2, 2.0BD")
    got = smartdiff.smart_diff_summary(a, b, key=("id", "id")).first()
    assert (got.changed_rows, got.unchanged_rows) == (1, 1)
    assert rows(smartdiff.smart_diff(a, b, key=("id", "id")).select("key", "status")) == [("1", "value_mismatch"), ("2", "unchanged")]


def test_join_errors_and_preview(spark):
    a = spark.range(50)
    with pytest.raises(ValueError):
        joins.join_tables(a, a, "id", "id", "cross")
    with pytest.raises(ValueError):
        joins.join_tables(a, a, "x", "id")
    shown = joins.join_preview(a, a, "id", "id", limit=7)
    assert shown.rows.count() == 7 and shown.total_rows() == 50
    assert rows(joins.join_candidates(a, a)) == [("id", "id", "NUMERIC", True)]


def test_edits(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", 2.5), (3, "c", 3.5)], "id int, t string, n double")
    found = [
        ("update", "1", "n", "9.25"),
        ("update", "1", "t", " NULL "),
        ("update", "2", "n", "many"),
        ("update", "2", "zzz", "1"),
        ("shout", "2", "n", "1"),
        ("delete", "3", None, None),
        ("insert", "7", "t", "new"),
    ]
    e = spark.createDataFrame(found, "op string, key string, `column` string, value string")
    done = edits.apply_edits(df, e, "id")
    assert rows(done.rows) == [(1, None, 9.25), (2, "b", 2.5), (7, "new", None)]
    assert [r.reason for r in done.rejects.orderBy("reason").collect()] == ["unknown_column", "unknown_operation", "value_does_not_fit"]
    assert edits.edit_summary(df, e, "id").first().asDict() == {"renamed_columns": 0, "changed_cells": 2, "row_delta": 0, "changes": 2}
    assert rows(df) == [(1, "a", 1.5), (2, "b", 2.5), (3, "c", 3.5)]


def test_last_edit_of_a_cell_counts(spark):
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    e = spark.createDataFrame([("update", "1", "t", "z", 1), ("update", "1", "t", "b", 2)], "op string, key string, `column` string, value string, seq int")
    assert rows(edits.apply_edits(df, e, "id").rows) == [(1, "b")]


def test_renames(spark):
    df = spark.sql("SELECT 1 AS a, 2 AS b")
    assert edits.rename_columns(df, {"a": " A b "}).columns == ["A b", "b"]
    for bad in ({"a": " "}, {"a": "B"}, {"zz": "q"}):
        with pytest.raises(ValueError):
            edits.rename_columns(df, bad)


def test_json_shapes(spark):
    docs = ['[{"a":1},{"b":"x","c":null}]', '[1,null,"x",true,[2]]', '{"z":{"q":1}}', "null", "bad{", "[]", "{}", '"s"']
    df = spark.createDataFrame(list(enumerate(docs)), "id int, doc string")
    got = rows(jsonshape.json_to_table(df, "doc", "id"))
    assert got == [
        (0, "records", 0, "a", "number", "1"),
        (0, "records", 1, "b", "string", "x"),
        (0, "records", 1, "c", "null", "null"),
        (1, "values", 0, None, "number", "1"),
        (1, "values", 1, None, "null", "null"),
        (1, "values", 2, None, "string", "x"),
        (1, "values", 3, None, "boolean", "true"),
        (1, "values", 4, None, "array", "[2]"),
        (2, "object", 0, "z", "object", '{"q":1}'),
        (3, "scalar", 0, None, "null", "null"),
        (7, "scalar", 0, None, "string", "s"),
    ]
    status = dict(rows(jsonshape.json_validate(df, "doc", "id").select("id", "status")))
    assert [k for k, v in status.items() if v == "invalid"] == [4]


def test_hot_is_what_fills_a_partition(spark):
    """A key just above the rows of an average partition is found, one just below is not, at any size."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, share = 1000 * partitions, 1000
    keys = F.when(F.col("id") < share + 10, "over").when(F.col("id") < 2 * share, "under").otherwise(F.col("id").cast("string"))
    assert joining.hot_keys(spark.range(n).select(keys.alias("k")), F.col("k")) == {"over"}


@pytest.mark.parametrize("how", joins.JOIN_KINDS)
def test_join_count_compares_like_the_join(spark, how):
    texts = spark.createDataFrame([("01",), ("2",), ("2",), ("7",), (None,)], "k string")
    numbers = spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "n int")
    for left, right, a, b in ((texts, numbers, "k", "n"), (numbers, texts, "n", "k")):
        assert joins.join_count(left, right, a, b, how).first().total_rows == joins.join_tables(left, right, a, b, how).count()


def test_diff_and_summary_agree_on_nested_zeros(spark):
    kinds = {
        "array(0.0D)": "array(-0.0D)",
        "named_struct('x', 0.0D, 'y', 1)": "named_struct('x', -0.0D, 'y', 1)",
        "array(named_struct('x', array(0.0F)))": "array(named_struct('x', array(float(-0.0D))))",
        "map('a', 0.0D)": "map('a', -0.0D)",
    }
    for plus, minus in kinds.items():
        base, other = (spark.sql(f"SELECT 1 AS id, {x} AS v UNION ALL SELECT 2, NULL") for x in (plus, minus))
        assert smartdiff.smart_diff(base, other).filter("status <> 'unchanged'").isEmpty(), plus
        assert smartdiff.smart_diff_summary(base, other).first().changed_rows == 0, plus
