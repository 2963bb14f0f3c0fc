import datetime
import decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import rows
from pyspark.sql import functions as F

from checks import files, formats
from tablecheck.operators import dataset, doctor, schema
from tablecheck.plans.files import list_files


def issues(df, *keys):
    return {tuple(r[k] for k in keys): list(r.issues) for r in df.collect()}


def base(path):
    return path.rsplit("/", 1)[1]


@pytest.fixture(scope="module")
def broken(tmp_path_factory):
    folder = tmp_path_factory.mktemp("broken")
    good = pa.table({"x": list(range(200))})
    pq.write_table(good, folder / "good.parquet")
    whole = (folder / "good.parquet").read_bytes()
    (folder / "short.parquet").write_bytes(b"PAR")
    (folder / "renamed.parquet").write_bytes(b"id,name\n1,abc\n")
    (folder / "cut.parquet").write_bytes(whole[: len(whole) // 2])
    return str(folder)


def test_integrity(spark, broken):
    got = {base(r.path): r for r in doctor.file_integrity(spark, broken).collect()}
    assert got["good.parquet"].readable and got["good.parquet"].row_groups == 1 and got["good.parquet"].issues == []
    assert got["short.parquet"].issues == ["too_short"]
    assert got["renamed.parquet"].issues == ["bad_header", "bad_footer", "unreadable"]
    assert got["cut.parquet"].starts_with_magic and got["cut.parquet"].issues == ["bad_footer", "unreadable"]


def test_doctor_reports_broken_files_and_checks_the_rest(spark, broken):
    found = doctor.doctor(spark, broken)
    health = doctor.health(found).first()
    assert health.errors == 6 and health.health_score == 0
    assert found.filter("category = 'data_quality'").count() == 1  # the readable file passes
    one = doctor.health(doctor.doctor(spark, f"{broken}/good.parquet")).first()
    assert one.health_score == 100 and one.errors == 0
    advice = doctor.recommendations(found)
    assert advice.count() == advice.distinct().count() > 2


def test_doctor_of_a_folder_names_every_table(spark, broken, tmp_path):
    spark.range(300).selectExpr("id", "CASE WHEN id > 200 THEN 'x' END AS t").repartition(2).write.parquet(str(tmp_path / "in" / "parts"))
    spark.range(5).selectExpr("id AS other", "1 AS same").coalesce(1).write.parquet(str(tmp_path / "in" / "sub" / "more.parquet"))
    (tmp_path / "in" / "notes.csv").write_text("a\n1\n")
    (tmp_path / "in" / "bad.parquet").write_bytes(b"PAR1 nothing else")
    found = doctor.doctor_folder(spark, str(tmp_path / "in")).cache()
    assert {r.table for r in found.select("table").distinct().collect()} == {"parts", "sub/more.parquet", "bad.parquet"}
    told = {(r.table, r.category, r.message) for r in found.filter("level <> 'pass'").collect()}
    assert ("parts", "data_quality", "high_null_ratio") in told and ("sub/more.parquet", "statistics", "one_value") in told
    assert ("bad.parquet", "integrity", "unreadable") in told and not any(t == "parts" and c == "integrity" for t, c, _ in told)
    assert found.filter("level <> 'pass' AND recommendation IS NULL").isEmpty()
    with pytest.raises(ValueError):
        doctor.doctor_folder(spark, str(tmp_path / "in" / "notes.csv"))


def test_doctor_of_files_that_differ(spark, folder):
    found = doctor.doctor(spark, folder)
    assert found.filter("category = 'data_quality' AND message = 'high_null_ratio' AND subject = 'w'").count() == 1


def test_row_groups_and_statistics(spark, tmp_path):
    n = 1000
    table = pa.table({"k": list(range(n)), "same": [7] * n, "none": pa.array([None] * n, pa.int64()), "low": ["a", "b"] * (n // 2)})
    pq.write_table(table, tmp_path / "a.parquet", row_group_size=450, compression="none", use_dictionary=False)
    pq.write_table(table.slice(0, 99), tmp_path / "b.parquet", write_statistics=False)
    pq.write_table(table.slice(0, 0), tmp_path / "c.parquet")
    groups = {(base(r.path), r.row_group): r for r in doctor.row_groups(spark, str(tmp_path)).collect()}
    assert groups["a.parquet", 0].issues == [] and groups["a.parquet", 2].row_count == 100
    assert groups["a.parquet", 0].compression == "UNCOMPRESSED"
    assert groups["b.parquet", 0].issues == ["small_row_group"]
    stats = issues(doctor.column_statistics(spark, str(tmp_path / "a.parquet")), "column")
    assert stats == {("k",): [], ("same",): ["one_value"], ("none",): ["no_min_max", "only_nulls"], ("low",): []}
    bare = issues(doctor.column_statistics(spark, str(tmp_path / "b.parquet")), "column")
    assert bare["k",] == ["no_statistics", "no_null_count"]
    packed = {r.column: r for r in doctor.compression_encoding(spark, str(tmp_path / "a.parquet")).collect()}
    assert packed["k"].issues == ["uncompressed"] and "DICTIONARY" not in packed["k"].encodings


def test_small_row_group_boundary(spark, tmp_path):
    for n in (99, 100):
        pq.write_table(pa.table({"k": list(range(n))}), tmp_path / f"{n}.parquet")
    got = {base(k[0]): v for k, v in issues(doctor.row_groups(spark, str(tmp_path)), "path").items()}
    assert got == {"99.parquet": ["small_row_group"], "100.parquet": []}


def test_types_in_footers(spark, tmp_path):
    moment = datetime.datetime(2024, 1, 1)
    one = decimal.Decimal
    table = pa.table(
        {
            "d10": pa.array([one("1.50")], pa.decimal128(10, 2)),
            "d38": pa.array([one("1")], pa.decimal128(38, 6)),
            "f": pa.array([1.0], pa.float32()),
            "ms": pa.array([moment], pa.timestamp("ms", "UTC")),
            "ns": pa.array([moment], pa.timestamp("ns")),
            "raw": pa.array([b"x"], pa.binary()),
            "t": ["x"],
            "nest": pa.array([{"a": [1]}]),
        }
    )
    pq.write_table(table, tmp_path / "t.parquet", version="2.6")
    path = str(tmp_path / "t.parquet")
    got = {r.path: r for r in schema.parquet_schema(spark, path).collect()}
    assert (got["d38"].decimal_precision, got["d38"].decimal_scale) == (38, 6)
    assert (got["ms"].timestamp_unit, got["ms"].is_adjusted_to_utc) == ("MILLIS", True)
    assert (got["ns"].timestamp_unit, got["ns"].is_adjusted_to_utc) == ("NANOS", False)
    leaf = got["nest.a.list.element"]
    assert (leaf.depth, leaf.parent_path, leaf.repetition_level, leaf.definition_level) == (4, "nest.a.list", 1, 4)
    assert [got[c].type_signature for c in ("d10", "f", "ms", "raw", "t")] == ["NUMERIC", "NUMERIC", "TEMPORAL", "BYTE_ARRAY", "TEXT"]
    numbers = issues(doctor.decimal_timestamp_diagnostics(spark, path), "column")
    assert numbers == {("d38",): ["decimal_very_precise"], ("f",): ["floating_point"]}
    assert issues(doctor.schema_validation(spark, path), "column")["raw",] == ["bytes_without_meaning"]


def test_quality_rules(spark):
    rows_ = 100
    half = F.when(F.col("id") < 50, None).otherwise("v")
    df = spark.range(rows_).select(
        "id",
        half.alias("half_null"),
        F.when(F.col("id") < 49, None).otherwise("v").alias("just_under"),
        F.when(F.col("id") == 1, "").otherwise("x").alias("empties"),
        F.when(F.col("id") < 10, F.lit(" N/A ")).otherwise("x").alias("defaults"),
        F.when(F.col("id") < 9, F.lit("0")).otherwise("x").alias("few_defaults"),
        F.lit(0).alias("all_zero"),
        F.to_date(F.lit("1850-01-01")).alias("old_date"),
        F.to_timestamp_ntz(F.lit("2300-01-01 00:00:00")).alias("far"),
    )
    got = issues(doctor.data_quality(df), "column")
    assert got == {
        ("id",): [],
        ("half_null",): ["high_null_ratio"],
        ("just_under",): [],
        ("empties",): ["empty_strings"],
        ("defaults",): ["default_values"],
        ("few_defaults",): [],
        ("all_zero",): ["all_zero"],
        ("old_date",): ["min_out_of_range", "max_out_of_range"],
        ("far",): ["min_out_of_range", "max_out_of_range"],
    }
    copies = df.unionByName(df.limit(3))
    assert tuple(doctor.data_quality_totals(copies).first()) == (103, 100, 3)
    assert doctor.data_quality(df.limit(0)).filter("size(issues) > 0").isEmpty()


def test_quality_of_unhashable_columns(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m, array(1) AS a FROM range(3) UNION ALL SELECT map('b', 2, 'a', 1), array(1)")
    assert tuple(doctor.data_quality_totals(df).first()) == (4, 1, 3)
    assert doctor.data_quality(df).count() == 2


def test_wide_tables_take_several_passes(spark):
    df = spark.range(5).select(*[F.col("id").alias(f"c{i}") for i in range(150)])
    got = doctor.data_quality(df)
    assert got.count() == 150 and got.filter("max_value <> '4'").isEmpty()


def test_table_structure_and_catalog(spark):
    blank = doctor.table_structure(spark.sql("SELECT 1 AS ` `")).first()
    assert blank.issues == ["blank_column_name"] and blank.blank_names == 1
    relations = spark.createDataFrame([("c", "s", "t", "BASE TABLE"), ("c", "s", "v", "VIEW")], "`database` string, `schema` string, name string, type string")
    found = doctor.catalog_check(relations, "s.t").first()
    assert (found.tables, found.views, found.issues) == (1, 1, ["several_relations"])


def test_drift(spark):
    current = spark.sql("SELECT 1 AS id, 'x' AS cust_name, 'y' AS amount, 1 AS fresh")
    reference = spark.sql("SELECT 1 AS id, 'x' AS customer_name, 2 AS amount, true AS gone")
    got = rows(schema.schema_drift(current, reference).select("change", "column", "other_column", "similarity"))
    assert got == [
        ("added", "cust_name", None, None),
        ("added", "fresh", None, None),
        ("removed", "customer_name", None, None),
        ("removed", "gone", None, None),
        ("rename_candidate", "cust_name", "customer_name", 0.818),
        ("type_changed", "amount", None, None),
    ]
    assert tuple(schema.drift_summary(current, reference).first()) == (4, 4, 2, 2, 1, 1)


def test_schema_views(spark):
    df = spark.sql("SELECT 1 AS `a|b`, named_struct('x', array(1.5BD), 'y', map('k', 2)) AS s")
    tree = schema.schema_columns(df)
    assert [r.path for r in tree.collect()] == ["a|b", "s", "s.x", "s.x.element", "s.y", "s.y.key", "s.y.value"]
    assert schema.nested_field_count(tree).first()[0] == 3
    assert rows(schema.search_columns(tree, " DECIMAL ").select("path")) == [("s",), ("s.x",), ("s.x.element",)]
    text = schema.schema_document(df, "T")
    assert "| a\\|b |" in text and "precision 2, scale 1" in text and text.startswith("# T schema")
    assert schema.schema_json(tree).filter("json LIKE '%\"path\":\"s.x\"%'").count() == 1


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("data")

    def put(name, table):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        pq.write_table(table, path)

    rows_ = pa.table({"id": list(range(50)), "v": ["x"] * 50})
    put("dt=2024-01-01/region=eu/a.parquet", rows_)
    put("dt=2024-01-01/region=eu/b.parquet", rows_)
    put("dt=2024-01-02/c.parquet", rows_)
    put("dt=2024-01-02/region=us/d.parquet", rows_.append_column("w", pa.array([1] * 50)))
    put("dt=2024-01-03/region=eu/empty.parquet", rows_.slice(0, 0))
    put("dt=2024-01-04/region=eu/big.parquet", pa.table({"id": list(range(40000)), "v": [f"{i}" for i in range(40000)]}))
    (root / "dt=2024-01-02" / "region=us" / "bad.parquet").write_bytes(b"x" * 50)
    (root / "dt=2024-01-02" / "region=us" / "zero.parquet").write_bytes(b"")
    (root / "notes.txt").write_text("skip")
    return str(root)


def test_dataset_scan(spark, folder):
    scan = dataset.scan_dataset(spark, folder)
    got = {r.relative_path: r for r in scan.collect()}
    assert len(got) == 8
    assert got["dt=2024-01-01/region=eu/a.parquet"].partition_values == {"dt": "2024-01-01", "region": "eu"}
    assert got["dt=2024-01-01/region=eu/a.parquet"].row_count == 50
    assert rows(dataset.missing_partition_keys(scan)) == [("dt=2024-01-02/c.parquet", ["region"])]
    assert {r[0].rsplit("/", 1)[1] for r in dataset.empty_files(scan).collect()} == {"empty.parquet", "zero.parquet"}
    assert {r[0].rsplit("/", 1)[1] for r in dataset.unreadable_files(scan).collect()} == {"bad.parquet", "zero.parquet"}
    assert dataset.small_files(scan).count() == 7
    groups = dict(rows(dataset.schema_groups(scan).select("schema_signature", "file_count")))
    assert sorted(groups.values()) == [1, 2, 5] and groups["unreadable"] == 2
    uneven = dataset.uneven_partitions(scan).first()
    assert uneven.ratio >= 10
    assert {r.message for r in dataset.dataset_warnings(scan).collect()} == set(dataset.ADVICE)
    totals = dataset.dataset_totals(scan).first()
    assert totals.file_count == 8 and totals.total_rows == 40200


def test_listing_finds_empty_and_nested_files(spark, folder):
    names = {base(r.path) for r in list_files(spark, folder).collect()}
    assert {"zero.parquet", "notes.txt", "a.parquet"} <= names and len(names) == 9


def test_scan_of_other_formats(spark, tmp_path):
    (tmp_path / "a b+c.csv").write_text('id,name,at\n1,"x,y",2024-01-01\n2,z,2024-01-02\n')
    (tmp_path / "head.csv").write_text("id,name\n")
    (tmp_path / "UP.CSV").write_text("id\n5\n6\n7\n")
    (tmp_path / "_hidden.csv").write_text("id\n5\n")
    (tmp_path / "t.tsv").write_text("k\tv\n1\ttrue\n")
    (tmp_path / "l.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    (tmp_path / "d.json").write_text('[{"a":1},\n{"a":2},{"a":3}]')
    (tmp_path / "bad.ndjson").write_text('{"a":1}\nnope\n')
    spark.range(5).coalesce(1).write.orc(str(tmp_path / "o"))
    got = {r.relative_path.rsplit("/", 1)[-1][-6:]: r for r in dataset.scan_dataset(spark, str(tmp_path)).collect()}
    csv = got["+c.csv"[-6:]]
    assert csv.row_count == 2 and [(c.name, c.type_signature) for c in csv.columns] == [("id", "NUMERIC"), ("name", "TEXT"), ("at", "TEMPORAL")]
    assert got["ad.csv"].row_count == 0 and got["UP.CSV"].row_count == 3 and "en.csv" not in " ".join(got)
    assert [c.type_signature for c in got["t.tsv"].columns] == ["NUMERIC", "BOOLEAN"]
    assert got[".jsonl"].row_count == 2 and got["d.json"].row_count == 3
    assert got["ndjson"].error is not None
    assert sum(r.row_count or 0 for k, r in got.items() if k.endswith("orc")) == 5


def test_drift_of_a_dataset(spark, folder):
    reference = folder + "/dt=2024-01-01/region=eu/a.parquet"
    got = rows(schema.schema_drift_dataset(spark, folder, reference).select("change", "column"))
    assert got == [("added", "w")]


def test_compaction(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, "01").otherwise("2").alias("p"))
    df.repartition(20).write.partitionBy("p").parquet(root)
    spark.range(3).select(F.lit(0).cast("long").alias("id"), F.lit("x").alias("late"), F.lit("01").alias("p")).write.mode("append").partitionBy("p").parquet(root)
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(setting)
    dataset.compact_dataset(spark, root, out, 64)
    files = rows(list_files(spark, out).filter("path LIKE '%.parquet'").select("path"))
    assert len(files) == 2 and any("p=01" in f[0] for f in files)
    assert spark.read.parquet(out).agg(F.sum("id")).first()[0] == sum(range(1000))
    assert spark.read.parquet(out).filter("late = 'x'").count() == 3
    assert spark.conf.get(setting) == before


def test_doctor_reports_files_that_are_read_short(spark, tmp_path):
    spark.range(200_000).selectExpr("id", "id % 7 AS x").coalesce(1).write.parquet(str(tmp_path / "t" / "a b"))
    import pathlib
    import shutil

    source = next(pathlib.Path(tmp_path / "t" / "a b").glob("*.parquet"))
    ruined = tmp_path / "t" / "ruined.parquet"
    shutil.copy(source, ruined)
    data = bytearray(ruined.read_bytes())
    data[2000:200_000] = b"\x00" * 198_000
    ruined.write_bytes(data)
    found = doctor.doctor(spark, str(tmp_path / "t"))
    errors = found.filter("level = 'error'").collect()
    assert [(r.category, r.message, r.subject.endswith("ruined.parquet")) for r in errors] == [("rows_read", "short_read", True)]
    assert doctor.health(found).first().health_score < 100
    whole = doctor.doctor(spark, str(tmp_path / "t" / "a b"))
    assert whole.filter("level = 'error'").isEmpty() and doctor.health(whole).first().health_score == 100


def test_one_bad_file_is_not_hidden_by_another(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pa.table({"x": list(range(500))})
    (tmp_path / "d").mkdir()
    pq.write_table(table, tmp_path / "d" / "a.parquet", compression="snappy")
    pq.write_table(table, tmp_path / "d" / "b.parquet", compression="none", write_statistics=False)
    stats = doctor.column_statistics(spark, str(tmp_path / "d")).first()
    assert "no_statistics" in stats.issues and not stats.has_min_max
    assert "uncompressed" in doctor.compression_encoding(spark, str(tmp_path / "d")).first().issues


def test_names_with_dots(spark, tmp_path):
    spark.sql("SELECT 1 AS `a.b`, named_struct('c.d', 2, 'e', named_struct('f', 3)) AS g").write.parquet(str(tmp_path / "n.parquet"))
    found = {r.path: (r.name, r.parent_path, r.depth) for r in schema.parquet_schema(spark, str(tmp_path / "n.parquet")).collect()}
    assert found == {"a.b": ("a.b", None, 1), "g.c.d": ("c.d", "g", 2), "g.e.f": ("f", "g.e", 3)}


def test_parts_without_values_take_the_types_of_the_others(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "part-0.csv").write_text("id,day,word,mixed\n")
    (tmp_path / "t" / "part-1.csv").write_text("id,day,word,mixed\n1,2024-01-01,x,1\n")
    (tmp_path / "t" / "part-2.csv").write_text("id,day,word,mixed\n2,,y,z\n")
    (tmp_path / "alone.csv").write_text("id\n")
    scan = dataset.scan_dataset(spark, str(tmp_path))
    got = {r.relative_path: (r.row_count, [c.type_signature for c in r.columns]) for r in scan.collect()}
    assert got == {
        "t/part-0.csv": (0, ["NUMERIC", "TEMPORAL", "TEXT", "TEXT"]),
        "t/part-1.csv": (1, ["NUMERIC", "TEMPORAL", "TEXT", "NUMERIC"]),
        "t/part-2.csv": (1, ["NUMERIC", "TEMPORAL", "TEXT", "TEXT"]),
        "alone.csv": (0, ["TEXT"]),
    }


def test_footer_rows_of_tables_in_several_files(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "a.parquet"))
    spark.range(4).coalesce(1).write.parquet(str(tmp_path / "b.parquet"))
    assert rows(formats.footer_rows(spark, str(tmp_path))) == [("a", 10), ("b", 4)]


def test_file_a_key_is_written_without_a_sort(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("k"))
    files._file_a_key(df, "k", str(tmp_path / "t"))
    back = dataset.partition_sizes(dataset.scan_dataset(spark, str(tmp_path / "t"))).select("partition_dir", "file_count", "row_count")
    assert rows(back) == [("k=0", 1, 334), ("k=1", 1, 333), ("k=2", 1, 333)]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    plans = spark._jsparkSession.sharedState().statusStore().executionsList()
    written = [p for p in (plans.apply(i).physicalPlanDescription() for i in range(plans.size())) if str(tmp_path / "t") in p and "InsertInto" in p]
    assert written and "Sort" not in written[0]
