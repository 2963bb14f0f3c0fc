"""Writing tables in every format and reading them back, folders of files."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.operators import dataset, doctor
from tablecheck.plans.files import footers, qualified, relative_path
from tablecheck.plans.small import small_frame
from tablecheck.plans.storage import scratch_folder
from tablecheck.sinks import export
from tablecheck.sources.folder import mount_folder
from tablecheck.sources.tables import read_table

from .common import CHECK_DIR, TABLES, load

FORMATS = ("csv", "tsv", "psv", "json", "jsonl", "ndjson", "parquet", "orc", "arrow", "feather", "ipc")


def _round_trip(fmt, spark, sf_dir):
    events = load(spark, sf_dir, "events")
    path = f"{scratch_folder(spark)}/events.{fmt}"
    export.export_table(events, path)
    back = read_table(spark, path)
    return back.select(*[F.col(c).cast(t).alias(c) for c, t in events.dtypes])


def _round_trip_text(fmt, spark, sf_dir):
    """Long texts with quotes and line breaks."""
    documents = load(spark, sf_dir, "documents")
    path = f"{scratch_folder(spark)}/documents.{fmt}"
    export.export_table(documents, path)
    back = read_table(spark, path, {"multi_line": True} if fmt == "csv" else None)
    return back.select(*[F.col(c).cast(t).alias(c) for c, t in documents.dtypes])


def export_counts(spark, sf_dir):
    """All tables as packed JSON lines, and the rows written."""
    folder = scratch_folder(spark)
    done = [(t, export.export_table(load(spark, sf_dir, t), f"{folder}/{t}.jsonl", compression="gzip").rows) for t in TABLES]
    return small_frame(spark, done, "name string, n_rows bigint")


def create_parquet_groups(spark, sf_dir):
    path = f"{scratch_folder(spark)}/lineitem.parquet"
    export.create_parquet(load(spark, sf_dir, "lineitem"), path, compression="zstd", row_group_size=1000)
    groups = doctor.row_groups(spark, path)
    return groups.agg(F.sum("row_count").alias("n_rows"), F.max("row_count").alias("largest"), F.max("compression").alias("codec"))


def export_join(spark, sf_dir):
    path = f"{scratch_folder(spark)}/join.csv"
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    export.export_join(nation, region, "n_regionkey", "r_regionkey", "inner", path)
    return read_table(spark, path).select(*[F.col(f"`{c}`").alias(c) for c in ("base.n_name", "join.r_name")])


def _partitioned(spark, sf_dir) -> str:
    path = scratch_folder(spark)
    load(spark, sf_dir, "orders").write.partitionBy("o_orderstatus").parquet(path)
    return path


def dataset_partitions(spark, sf_dir):
    scan = dataset.scan_dataset(spark, _partitioned(spark, sf_dir))
    status = F.col("partition_values")["o_orderstatus"].alias("status")
    return scan.groupBy(status).agg(F.sum("row_count").alias("n_rows"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def compact_dataset(spark, sf_dir):
    out = scratch_folder(spark)
    dataset.compact_dataset(spark, _partitioned(spark, sf_dir), out, 128)
    return dataset.partition_sizes(dataset.scan_dataset(spark, out)).select("partition_dir", "row_count")


def delimited_scan(spark, sf_dir):
    path = scratch_folder(spark)
    export.export_table(load(spark, sf_dir, "orders"), f"{path}/orders.csv", "csv")
    scan = dataset.scan_dataset(spark, path)
    column = F.explode("columns").alias("c")
    return scan.select("row_count", column).groupBy("c.name", "c.type_signature").agg(F.sum("row_count").alias("n_rows"))


def mounted_views(spark, sf_dir):
    """A view per file of the folder, with the rows that it gives."""
    mounted = mount_folder(spark, sf_dir)
    counted = [spark.table(f"`{r.view}`").agg(F.lit(r.view).alias("v"), F.count("*").alias("n_rows")) for r in mounted.filter("view IS NOT NULL").collect()]
    return mounted.join(reduce(DataFrame.unionByName, counted), F.col("view") == F.col("v")).select("view", "path", "format", "error", "n_rows")


def footer_rows(spark, sf_dir):
    """Rows per table as the footers of all files state them, beside a count of the data."""
    stated = footers(spark, sf_dir).filter("row_group IS NULL")
    # A table is a file, or a folder of part files.
    table = F.regexp_extract(relative_path(qualified(spark, sf_dir), F.col("path")), r"^(.+?)\.parquet(/|$)", 1)
    return stated.groupBy(table.alias("name")).agg(F.sum("row_count").alias("row_count"))


QUERIES = {f"round_trip_{fmt}": partial(_round_trip, fmt) for fmt in FORMATS} | {
    "round_trip_text_csv": partial(_round_trip_text, "csv"),
    "round_trip_text_json": partial(_round_trip_text, "json"),
    "export_counts": export_counts,
    "export_join": export_join,
    "create_parquet_groups": create_parquet_groups,
    "dataset_partitions": dataset_partitions,
    "compact_dataset": compact_dataset,
    "delimited_scan": delimited_scan,
    "mounted_views": mounted_views,
    "footer_rows": footer_rows,
}

_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS {{n}} FROM {t}" for t in TABLES)

ORACLES = {f"round_trip_{fmt}": "SELECT * FROM events" for fmt in FORMATS} | {
    "round_trip_text_csv": "SELECT * FROM documents",
    "round_trip_text_json": "SELECT * FROM documents",
    "export_counts": _COUNTS.format(n="n_rows"),
    "export_join": 'SELECT n_name AS "base.n_name", r_name AS "join.r_name" FROM nation JOIN region ON n_regionkey = r_regionkey',
    "create_parquet_groups": "SELECT count(*) AS n_rows, least(1000, count(*)) AS largest, 'ZSTD' AS codec FROM lineitem",
    "dataset_partitions": "SELECT o_orderstatus AS status, count(*) AS n_rows, CAST(0 AS BIGINT) AS errors FROM orders GROUP BY 1",
    "compact_dataset": "SELECT 'o_orderstatus=' || o_orderstatus AS partition_dir, count(*) AS row_count FROM orders GROUP BY 1",
    "delimited_scan": """SELECT column_name AS name, CASE column_type WHEN 'VARCHAR' THEN 'TEXT' WHEN 'TIMESTAMP' THEN 'TEMPORAL' ELSE 'NUMERIC' END AS type_signature,
        (SELECT count(*) FROM orders) AS n_rows FROM (DESCRIBE SELECT * FROM orders)""",
    "mounted_views": f"""SELECT name AS view, name || '.parquet' AS path, 'parquet' AS format, CAST(NULL AS VARCHAR) AS error, n_rows FROM ({_COUNTS.format(n="n_rows")})""",
    "footer_rows": _COUNTS.format(n="row_count"),
}
