import gzip
import json

import pyarrow.parquet as pq
import pytest
from conftest import SF_DIR, rows, same_rows
from pyspark.sql import functions as F

from checks import formats
from tablecheck.operators import edits
from tablecheck.sinks import export
from tablecheck.sources import tables as src


@pytest.mark.parametrize("fmt", ["csv", "tsv", "psv", "json", "jsonl", "ndjson", "parquet", "orc", "arrow", "feather", "ipc"])
def test_round_trip(spark, tables, tmp_path, fmt):
    df = tables["customer"].withColumn("c_name", F.when(F.col("c_custkey") == 3, None).otherwise(F.concat("c_name", F.lit(' "q", x'))))
    out = str(tmp_path / f"out.{fmt}")
    done = export.export_table(df.repartition(3), out)
    assert done.rows == df.count() and done.files >= 1 and done.format == fmt
    back = src.read_table(spark, out)
    back = back.select(*[F.col(c).cast(t).alias(c) for c, t in df.dtypes])
    assert same_rows(df, back)
    with pytest.raises(Exception):
        export.export_table(df, out)


def test_json_parts_are_arrays(spark, tmp_path):
    out = str(tmp_path / "a.json")
    export.export_table(spark.range(0, 7, 1, 3).withColumn("n", F.lit(None).cast("int")), out)
    import json

    parts = [json.loads(p.read_text()) for p in (tmp_path / "a.json").glob("part-*")]
    assert sorted(r["id"] for part in parts for r in part) == list(range(7))
    assert all(r["n"] is None for part in parts for r in part)


def test_create_parquet(spark, tmp_path):
    df = spark.createDataFrame([("1", "1.5", "x"), ("2.5", "bad", "y"), ("3.5", None, "z")], "a string, b string, c string")
    columns = [export.OutputColumn("a", "n", "BIGINT"), export.OutputColumn("b", "n", "decimal(9,1)"), export.OutputColumn("c", "", "weird")]
    out = str(tmp_path / "p.parquet")
    done = export.create_parquet(df.coalesce(1), out, columns, "zstd", 2)
    back = spark.read.parquet(out)
    assert done.rows == 3 and back.dtypes == [("n", "bigint"), ("n_2", "decimal(18,4)"), ("column_3", "string")]
    assert [r[0] for r in rows(back)] == [1, 2, 4]
    meta = pq.read_metadata(next((tmp_path / "p.parquet").glob("part-*.parquet")))
    assert meta.num_row_groups == 2 and meta.row_group(0).column(0).compression == "ZSTD"
    with pytest.raises(ValueError):
        export.create_parquet(df, out + "2", columns, "lzma")


def test_export_scopes(spark, tables, tmp_path):
    done = export.export_query(spark, tables["nation"], "SELECT n_name FROM file_data WHERE n_regionkey = 1", str(tmp_path / "q"), "csv")
    assert done.rows == tables["nation"].filter("n_regionkey = 1").count()
    spark.sql(f"CREATE TABLE IF NOT EXISTS e1 USING parquet LOCATION '{tmp_path}/e1' AS SELECT 1 AS x")
    spark.sql(f"CREATE TABLE IF NOT EXISTS e2 USING parquet LOCATION '{tmp_path}/e2' AS SELECT 2 AS x UNION ALL SELECT 3")
    try:
        picked = [{"database": "spark_catalog", "schema": "default", "name": n} for n in ("e1", "e2")]
        found = export.export_relations(spark, picked, str(tmp_path / "all"), "jsonl")
        assert [(f.rows, f.path.rsplit("/", 1)[1]) for f in found] == [(1, "default_e1"), (2, "default_e2")]
    finally:
        spark.sql("DROP TABLE e1")
        spark.sql("DROP TABLE e2")


def test_export_join_is_whole(spark, tables, tmp_path):
    done = export.export_join(tables["nation"], tables["region"], "n_regionkey", "r_regionkey", "left", str(tmp_path / "j"))
    assert done.rows == 25


def test_saved_copy(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    gone = spark.createDataFrame([("delete", "1", None, None), ("delete", "2", None, None)], "op string, key string, `column` string, value string")
    empty = edits.apply_edits(df, gone, "id").rows
    out = str(tmp_path / "copy.parquet")
    assert export.save_edited_copy(empty, "src.parquet", out).rows == 0
    assert spark.read.parquet(out).dtypes == [("id", "string"), ("t", "string")]
    with pytest.raises(Exception):
        export.save_edited_copy(df, "src.parquet", out)


@pytest.mark.parametrize("fmt", ["json", "csv"])
def test_texts_with_line_breaks_are_written_in_files_of_bounded_length(spark, tmp_path, monkeypatch, fmt):
    monkeypatch.setattr(export, "ROWS_PER_FILE", 7)
    df = spark.range(50).selectExpr("id", "concat('a\n\"', id, ',]') AS t").coalesce(2)
    path = tmp_path / f"t.{fmt}"
    done = export.export_table(df, str(path), fmt)
    parts = [f.read_text() for f in path.glob("part-*")]
    assert done.rows == 50 and done.files == len(parts) == 8
    if fmt == "json":
        assert sorted(len(json.loads(p)) for p in parts) == [4, 4, 7, 7, 7, 7, 7, 7]
    assert rows(src.read_table(spark, str(path), {"multi_line": True}).select(F.col("id").cast("long"), "t")) == rows(df)


@pytest.mark.parametrize("fmt", ["csv", "tsv", "psv", "json", "jsonl", "ndjson"])
def test_packed_texts_are_whole(spark, tables, tmp_path, fmt):
    df = tables["customer"].withColumn("c_name", F.when(F.col("c_custkey") == 3, None).otherwise(F.concat("c_name", F.lit(' "q", x'))))
    plain, packed = tmp_path / f"plain.{fmt}", tmp_path / f"packed.{fmt}"
    export.export_table(df.repartition(3), str(plain))
    done = export.export_table(df.repartition(3), str(packed), compression="gzip")
    assert done.rows == df.count() and done.files == len(list(packed.glob("part-*.gz"))) == 3

    def text(folder, of):
        return sorted(line for p in folder.glob("part-*") for line in of(p.read_bytes()).splitlines())

    assert text(packed, gzip.decompress) == text(plain, bytes)
    assert sum(p.stat().st_size for p in packed.glob("part-*")) * 2 < sum(p.stat().st_size for p in plain.glob("part-*"))
    back = src.read_table(spark, str(packed))
    assert same_rows(df, back.select(*[F.col(c).cast(t).alias(c) for c, t in df.dtypes]))


def test_codecs_that_do_not_fit_are_refused(spark, tmp_path):
    for fmt, codec in (("parquet", "gzip"), ("arrow", "gzip"), ("csv", "rar")):
        with pytest.raises(ValueError):
            export.export_table(spark.range(3), f"{tmp_path}/x.{fmt}", compression=codec)
    assert not list(tmp_path.iterdir())


def test_export_counts_writes_every_row_packed(spark, tables, monkeypatch, tmp_path):
    monkeypatch.setattr(formats, "scratch_folder", lambda _: str(tmp_path))
    got = {r.name: r.n_rows for r in formats.export_counts(spark, SF_DIR).collect()}
    assert got == {n: t.count() for n, t in tables.items()}
    for name, count in got.items():
        parts = list((tmp_path / f"{name}.jsonl").glob("part-*"))
        assert all(p.name.endswith(".gz") for p in parts) and sum(gzip.decompress(p.read_bytes()).count(b"\n") for p in parts) == count
