"""One way to files for every kind of path: relative ones, URIs, blanks, globs, and stores that only Spark reads."""

import json
import os
import zipfile

import pyarrow as pa
import pyarrow.feather as feather
import pyarrow.parquet as pq
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablecheck.operators import dataset, doctor, schema
from tablecheck.plans import files
from tablecheck.sinks import export
from tablecheck.sources import arrowfile, folder, tables


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """A folder with blanks in its name, and the same folder as a mount that tasks cannot open by themselves."""
    root = tmp_path_factory.mktemp("a b") / "in put"
    (root / "k=1").mkdir(parents=True)
    table = pa.table({"id": list(range(40)), "t": [f"v{i}" for i in range(40)]})
    pq.write_table(table, root / "k=1" / "one.parquet", row_group_size=15)
    pq.write_table(table.slice(0, 5), root / "two [x].parquet")
    feather.write_feather(table, str(root / "f.feather"))
    (root / "c.csv").write_text("id,name\n1,x\n2,y\n")
    (root / "l.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (root / "bad.parquet").write_bytes(b"PAR1 nothing")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.access.link./in", f"file://{root.parent.as_posix().replace(' ', '%20')}")
    return root


def spellings(store):
    return {
        "plain": str(store),
        "relative": os.path.relpath(store),
        "uri": f"file://{store}",
        "mount": "viewfs://access/in/in put",
    }


@pytest.mark.parametrize("kind", ["plain", "relative", "uri", "mount"])
def test_all_reports_take_every_spelling(spark, store, kind):
    root = spellings(store)[kind]
    listed = {r.path.rsplit("/", 1)[1]: r.file_size for r in files.list_files(spark, root).collect()}
    assert listed == {p.name: p.stat().st_size for p in store.rglob("*") if p.is_file()}
    found = {r.path.rsplit("/", 1)[1]: r for r in doctor.file_integrity(spark, root).collect()}
    assert set(found) == {"one.parquet", "two [x].parquet", "bad.parquet"} and found["one.parquet"].row_groups == 3
    assert found["bad.parquet"].issues == ["bad_footer", "unreadable"] and found["two [x].parquet"].issues == []
    scan = {r.relative_path: (r.row_count, r.partition_values, r.error is None) for r in dataset.scan_dataset(spark, root).collect()}
    assert scan == {
        "k=1/one.parquet": (40, {"k": "1"}, True),
        "two [x].parquet": (5, {}, True),
        "f.feather": (40, {}, True),
        "c.csv": (2, {}, True),
        "l.jsonl": (2, {}, True),
        "bad.parquet": (None, {}, False),
    }
    assert tables.read_table(spark, f"{root}/f.feather").agg(F.count("*"), F.sum("id")).first() == (40, 780)
    assert schema.parquet_schema(spark, f"{root}/k=1").count() == 2
    mounted = {r.path: r.format for r in folder.mount_folder(spark, root).filter("error IS NULL").collect()}
    assert mounted == {"c.csv": "csv", "l.jsonl": "json", "f.feather": "feather", "k=1/one.parquet": "parquet", "two [x].parquet": "parquet"}


def test_globs_and_names_that_look_like_globs(spark, store):
    root = str(store)
    assert {r.path.rsplit("/", 1)[1] for r in files.list_files(spark, f"{root}/*/*.parquet").collect()} == {"one.parquet"}
    assert {r.path.rsplit("/", 1)[1] for r in files.list_files(spark, f"{root}/{{c,l}}.*").collect()} == {"c.csv", "l.jsonl"}
    assert files.list_files(spark, f"{root}/two [x].parquet").count() == 1
    assert tables.read_table(spark, f"{root}/*.feather").count() == 40
    scan = dataset.scan_dataset(spark, f"{root}/k=*/*.parquet")
    assert [(r.relative_path, r.row_count) for r in scan.collect()] == [("k=1/one.parquet", 40)]
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, f"{root}/nothing")
    assert files.list_files(spark, []).isEmpty()


def test_contents_that_are_too_long_are_reported(spark, store, monkeypatch):
    monkeypatch.setattr(files, "LONGEST_CONTENT", 800)
    found = {r.path.rsplit("/", 1)[1]: r.content is None for r in files.list_files(spark, spellings(store)["mount"], content=True).collect()}
    assert found["one.parquet"] and not found["c.csv"]
    errors = doctor.file_integrity(spark, spellings(store)["mount"]).filter("path LIKE '%one.parquet'").first()
    assert not errors.readable


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet", "arrow"])
def test_exports_to_relative_paths_and_uris(spark, tmp_path, fmt):
    df = spark.range(0, 30, 1, 3)
    uri = f"file://{tmp_path}/u {fmt}.{fmt}"
    first = export.export_table(df, uri)
    assert (first.rows, first.files) == (30, 3)
    assert tables.read_table(spark, uri).count() == 30
    again = export.export_table(df, f"{os.path.relpath(tmp_path)}/rel {fmt}.{fmt}")
    assert (again.rows, again.files) == (30, 3)


def test_export_to_a_mount(spark, store, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.outward.link./out", f"file://{tmp_path}")
    done = export.export_table(spark.range(0, 30, 1, 3), "viewfs://outward/out/t.csv")
    assert (done.rows, done.files) == (30, 3)
    with pytest.raises(ValueError, match="cannot write Arrow"):
        export.export_table(spark.range(3), "viewfs://outward/out/t.arrow")


def test_arrow_files_are_planned_and_committed_in_tasks(spark, tmp_path):
    out = str(tmp_path / "many.arrow")
    done = export.export_table(spark.range(0, 900, 1, 60), out)
    assert (done.rows, done.files) == (900, 60)
    assert not [p for p in os.listdir(out) if p.startswith("_") and p != "_SUCCESS"]
    back = tables.read_table(spark, out)
    assert back.count() == 900 and back.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    export.export_table(spark.range(7), out, mode="overwrite")
    assert tables.read_table(spark, out).count() == 7
    export.export_table(spark.range(5), out, mode="append")
    assert tables.read_table(spark, out).count() == 12
    with pytest.raises(FileExistsError):
        export.export_table(spark.range(5), out)
    # A repeated step finds its file in place.
    system, _ = files.file_system(out)
    (tmp_path / "x").write_text("1")
    arrowfile._move(system, str(tmp_path / "x"), str(tmp_path / "y"))
    arrowfile._move(system, str(tmp_path / "x"), str(tmp_path / "y"))
    with pytest.raises(FileNotFoundError):
        arrowfile._move(system, str(tmp_path / "x"), str(tmp_path / "z"))


def test_arrow_files_of_unlike_columns_and_bad_ones(spark, tmp_path):
    for name, table in (("a", pa.table({"x": [1, 2], "y": ["p", "q"]})), ("b", pa.table({"x": [3], "z": [1.5]}))):
        feather.write_feather(table, str(tmp_path / f"{name}.feather"))
    assert rows(tables.read_table(spark, str(tmp_path), {"format": "feather"})) == [(1, "p"), (2, "q"), (3, None)]
    (tmp_path / "c.feather").write_bytes(b"nothing")
    with pytest.raises(Exception, match="c.feather"):
        tables.read_table(spark, str(tmp_path), {"format": "feather"}).collect()


def test_object_stores_use_the_settings_of_the_session():
    given = {"fs.s3a.access.key": "k", "fs.s3a.secret.key": "s", "fs.s3a.endpoint.region": "r", "fs.s3a.bucket.own.access.key": "o", "fs.s3a.endpoint": "localhost:9"}
    assert files.opens_directly("s3a://own/x", given) and files.opens_directly("/x", {})
    system, inner = files.file_system("s3a://own/dir/x y.parquet", given)
    assert system.type_name == "s3" and inner == "own/dir/x y.parquet" and system.region == "r"
    assert not files.opens_directly("viewfs://store/in", {}) and not files.opens_directly("nope://x/y", {})
    assert [files.scheme_of(p) for p in ("/a:b/c", "rel/a", "S3A://b/c", "file:/x")] == ["", "", "s3a", "file"]


def test_one_listing_serves_a_scan(spark, store, monkeypatch):
    seen = []
    listed = files.list_files
    monkeypatch.setattr(files, "list_files", lambda *a, **b: seen.append(a) or listed(*a, **b))
    dataset.scan_dataset(spark, str(store))
    assert len(seen) == 1


def test_json_parts_without_rows_are_arrays(spark, tmp_path):
    out = tmp_path / "e.json"
    export.export_table(spark.range(0, 4, 1, 4).filter("id > 1"), str(out))
    assert sorted(json.dumps(json.loads(p.read_text())) for p in out.glob("part-*")) == ['[]', '[]', '[{"id": 2}]', '[{"id": 3}]']


def test_folders_that_are_tables_are_not_entered(spark, tmp_path):
    for at in ("t.parquet/k=1", "plain/deep/parts", "venv/parts", "mixed/sub"):
        spark.range(2).coalesce(1).write.parquet(str(tmp_path / at))
    (tmp_path / "mixed" / "part-0.csv").write_text("a\n1\n")
    (tmp_path / "mixed" / "part-0.jsonl").write_text('{"a": 1}\n')
    (tmp_path / "notes.txt").write_text("x")
    with zipfile.ZipFile(tmp_path / "z.xlsx", "w") as z:
        z.writestr("x", "y")
    found = rows(folder.tables_below(spark, str(tmp_path)))
    assert found == [
        ("mixed/part-0.csv", "csv"),
        ("mixed/part-0.jsonl", "json"),
        ("mixed/sub", "parquet"),
        ("plain/deep/parts", "parquet"),
        ("t.parquet", "parquet"),
        ("z.xlsx", "workbook"),
    ]
