"""Looking over a folder of data files: inventory, schemas, partitions, sizes."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..plans.files import access_settings, any_case, files_to_open, footer_rows, load_paths, open_file, opens_directly, path_of_uri, qualified, relative_path
from ..plans.shipping import ship_package
from ..plans.storage import checkpointed, stored
from ..sources.options import DELIMITERS, family_of, normalize_options
from ..sources.workbooks import workbook_rows

# Thresholds of the folder rules.
SMALL_FILE = 10 * 1024 * 1024
UNEVEN_RATIO = 10

ADVICE = {
    "inconsistent_schemas": "Write all files with one schema.",
    "missing_partition_keys": "Give every file the same key=value folders.",
    "empty_files": "Remove the empty files or write them again.",
    "small_files": "Compact small files into larger ones.",
    "uneven_partitions": "Choose other partition keys or compact the large partitions.",
    "unreadable_files": "Repair or remove the unreadable files.",
}

_LEAF = "name string, path string, type_signature string"
_FOUND = f"path string, row_count bigint, columns array<struct<{_LEAF}>>, error string"
SCAN_COLUMNS = (
    "path",
    "relative_path",
    "partition_dir",
    "file_size",
    "row_count",
    "partition_values",
    "schema_signature",
    "columns",
    "error",
)


def partition_values(relative_dir: Column) -> Column:
    """``key=value`` parts of a path as a map."""
    parts = F.filter(F.split(relative_dir, "/"), lambda p: p.rlike("^[^=]+="))
    pairs = F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, "^[^=]+=", "").alias("v")))
    # Of a repeated key the last value counts, as for nested folders.
    keys = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda x: x["k"] == k), -1)["v"]))


def _inspected(files: DataFrame) -> DataFrame:
    """Row count and columns of files that carry both in their metadata; header names of delimited files."""
    settings = access_settings(files.sparkSession)

    def inspect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size, family, content in zip(batch["path"], batch["file_size"], batch["family"], batch["content"]):
                try:
                    found = _metadata(path, int(size), family, settings, content)
                except Exception as problem:  # listed as unreadable
                    found = (path, None, None, f"{type(problem).__name__}: {problem}")
                yield pd.DataFrame([found], columns=["path", "row_count", "columns", "error"])

    return files.select("path", "file_size", "family", "content").mapInPandas(inspect, _FOUND)


def _metadata(path: str, size: int, family: str, settings: dict[str, str], content: bytes | None) -> tuple:
    if family == "parquet":
        head = footer_rows(path, size, False, settings, content)[0]
        columns = [{k: c[k] for k in ("name", "path", "type_signature")} for c in head[6] or []]
        return path, head[8], columns if head[5] is None else None, head[5]
    if family in DELIMITERS:
        with open_file(path, settings, content) as source:
            first = io.TextIOWrapper(source, "utf-8", errors="replace").readline()
        header = next(csv.reader([first], delimiter=DELIMITERS[family]), [])
        return path, None, [{"name": n, "path": n, "type_signature": None} for n in header], None
    with open_file(path, settings, content) as source:
        schema, rows = _orc(source) if family == "orc" else _arrow(source)
    return path, rows, [{"name": f.name, "path": f.name, "type_signature": _arrow_signature(f.type)} for f in schema], None


def _orc(source):
    import pyarrow.orc as orc

    file = orc.ORCFile(source)
    return file.schema, file.nrows


def _arrow(source):
    from ..sources.arrowfile import open_layout

    reader, is_file = open_layout(source)
    if not is_file:
        return reader.schema, sum(b.num_rows for b in reader)
    # Without columns a batch is its header: no values are read.
    import pyarrow as pa

    source.seek(0)
    options = pa.ipc.IpcReadOptions(included_fields=[0] if len(reader.schema) else [])
    headers = pa.ipc.open_file(source, options=options)
    return reader.schema, sum(headers.get_batch(i).num_rows for i in range(headers.num_record_batches))


def _arrow_signature(kind) -> str:
    import pyarrow.types as at

    if at.is_string(kind) or at.is_large_string(kind):
        return "TEXT"
    if at.is_temporal(kind) and not at.is_duration(kind):
        return "TEMPORAL"
    if at.is_integer(kind) or at.is_floating(kind) or at.is_decimal(kind):
        return "NUMERIC"
    return "BOOLEAN" if at.is_boolean(kind) else str(kind).upper()


def _delimited(spark: SparkSession, root: str, family: str, headers: DataFrame) -> DataFrame:
    """Rows and column types of all delimited files of a kind, in one distributed read.

    Columns are read by position as text and tested per file and position;
    the widest header bounds their number. A column without a value in its
    file is of the type it has in all other files of the folder, else text.
    """
    width = headers.agg(F.coalesce(F.max(F.size("columns")), F.lit(0)).alias("w")).first().w
    if not width:
        return headers.withColumn("row_count", F.lit(0).cast("bigint"))
    options = normalize_options(family)
    schema = ", ".join(f"c{i} string" for i in range(width))
    reader = spark.read.schema(schema).option("header", True).option("sep", options["delimiter"]).option("escape", '"')
    reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", any_case(family))
    stacked = ", ".join(f"{i}, c{i}" for i in range(width))
    cells = load_paths(reader.format("csv"), [root]).selectExpr("_metadata.file_path AS uri", f"stack({width}, {stacked}) AS (pos, v)")
    here, number = values.present(F.col("v")), values.as_number(F.col("v"))
    tested = cells.groupBy("uri", "pos").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(here).alias("present"),
        F.every(F.when(here, number.isNotNull())).alias("number"),
        F.every(F.when(here, values.is_boolean_text(F.col("v")))).alias("boolean"),
        F.every(F.when(here, number.isNull() & values.as_moment(F.col("v")).isNotNull())).alias("moment"),
    )
    kind = F.when(F.col("boolean"), "BOOLEAN").when(F.col("number"), "NUMERIC").when(F.col("moment"), "TEMPORAL").when(F.col("present") > 0, "TEXT")
    by_file = tested.groupBy(path_of_uri(F.col("uri")).alias("path")).agg(
        F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("pos", kind))).alias("kinds")
    )
    typed = F.transform(
        "columns",
        lambda c, i: F.struct(c["name"], c["path"], F.try_element_at("kinds", i).alias("type_signature")),
    )
    joined = headers.drop("row_count").join(by_file, "path", "left")
    return _settled(stored(joined.select(
        "path", F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0))).alias("row_count"), typed.alias("columns"), "error"
    )))


def _settled(files: DataFrame) -> DataFrame:
    """Columns without a type take the one that the other files of the folder agree on, else text: an empty part contradicts no other."""
    folder = F.regexp_replace("path", "/[^/]*$", "").alias("folder")
    cells = files.select("path", folder, F.posexplode("columns").alias("pos", "c")).select("path", "folder", "pos", "c.name", "c.type_signature")
    kind = F.col("type_signature")
    agreed = cells.filter(kind.isNotNull()).groupBy("folder", "name").agg(F.min(kind).alias("usual"), F.max(kind).alias("most")).filter("usual = most").drop("most")
    untyped = cells.filter(kind.isNull()).join(agreed, ["folder", "name"], "left")
    by_file = untyped.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.coalesce("usual", F.lit("TEXT"))))).alias("usual"))
    settled = F.transform(
        "columns",
        lambda c, i: F.struct(c["name"], c["path"], F.coalesce(c["type_signature"], F.try_element_at("usual", i)).alias("type_signature")),
    )
    return files.join(by_file, "path", "left").select("path", "row_count", settled.alias("columns"), "error")


def _json(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """Records and shape of JSON files: lines are documents, ``.json`` files are one document each.

    A document that is too long for one Spark value counts as invalid; such
    data belongs in a file of lines.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", any_case("jsonl", "ndjson")).text(root)
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", any_case("json")).text(root, wholetext=True)
    uri = F.col("_metadata.file_path").alias("uri")
    documents = lines.select(uri, F.col("value")).unionByName(whole.select(uri, F.col("value"))).filter("trim(value) <> ''")
    parsed = documents.select("uri", F.try_parse_json("value").alias("doc"))
    items = F.col("doc").try_cast("array<variant>")
    counted = parsed.groupBy(path_of_uri(F.col("uri")).alias("path")).agg(
        F.sum(F.coalesce(F.size(items), F.lit(1))).alias("n"),
        F.count_if(F.col("doc").isNull()).alias("bad"),
        F.schema_of_variant_agg("doc").alias("shape"),
    )
    joined = files.select("path").join(counted, "path", "left")
    shape = F.coalesce(F.col("shape"), F.lit("VOID"))
    column = F.array(F.struct(F.lit("document").alias("name"), F.lit("$").alias("path"), shape.alias("type_signature")))
    bad = F.col("bad") > 0
    return joined.select(
        "path",
        F.when(~F.coalesce(bad, F.lit(False)), F.coalesce("n", F.lit(0))).alias("row_count"),
        F.when(~F.coalesce(bad, F.lit(False)), column).alias("columns"),
        F.when(bad, F.concat(F.col("bad").cast("string"), F.lit(" invalid JSON documents"))).alias("error"),
    )


def _workbooks(files: DataFrame) -> DataFrame:
    rows = workbook_rows(files, normalize_options("workbook"))
    header = F.max_by("cells", F.when(F.col("is_header"), 1))
    counted = rows.groupBy("path").agg(
        F.count_if(~F.col("is_header") & F.col("error").isNull()).alias("n"), header.alias("header"), F.max("error").alias("error")
    )
    named = F.transform("header", lambda n: F.struct(n.alias("name"), n.alias("path"), F.lit("TEXT").alias("type_signature")))
    good = F.col("error").isNull()
    return files.select("path").join(counted, "path", "left").select(
        "path", F.when(good, F.coalesce("n", F.lit(0))).alias("row_count"), named.alias("columns"), "error"
    )


def scan_dataset(spark: SparkSession, root: str) -> DataFrame:
    """One row per supported file: size, rows, partition values, schema, error.

    Parquet, ORC and Arrow files are asked for their metadata only. Delimited
    and JSON files are read by Spark, split as usual, and counted per file.
    The scan is stored, since every report on it would repeat it.
    """
    root = qualified(spark, root)
    relative = relative_path(root, F.col("path"))
    files = files_to_open(spark, root).withColumn("family", family_of(F.col("path"))).filter("family IS NOT NULL")
    if opens_directly(root, access_settings(spark)):
        files = stored(files)  # one listing, whatever the kinds of files in it
    kinds = {r.family for r in files.select("family").distinct().collect()}
    if not kinds:
        raise ValueError(f"No data files below {root!r}.")
    ship_package(spark)
    seen = []
    direct = [k for k in kinds if k in ("parquet", "orc", "arrow", "feather")]
    if direct:
        seen.append(_inspected(files.filter(F.col("family").isin(*direct))))
    for kind in sorted(kinds & set(DELIMITERS)):
        headers = _inspected(files.filter(F.col("family") == kind))
        seen.append(_delimited(spark, root, kind, headers))
    if "json" in kinds:
        seen.append(_json(spark, root, files.filter("family = 'json'")))
    if "workbook" in kinds:
        seen.append(_workbooks(files.filter("family = 'workbook'")))
    if "avro" in kinds:
        none = F.lit(None)
        seen.append(
            files.filter("family = 'avro'").select(
                "path",
                none.cast("bigint").alias("row_count"),
                none.cast(f"array<struct<{_LEAF}>>").alias("columns"),
                F.lit("Avro needs the org.apache.spark:spark-avro package on the cluster.").alias("error"),
            )
        )
    found = reduce(DataFrame.unionByName, seen)
    folder = F.regexp_replace(F.col("relative_path"), "/?[^/]*$", "")
    signature = F.when(F.col("error").isNull(), F.sha2(F.to_json("columns"), 256))
    return checkpointed(
        files.select("path", "file_size").join(found, "path", "left")
        .withColumn("relative_path", relative)
        .withColumn("partition_dir", F.when(folder == "", ".").otherwise(folder))
        .withColumn("partition_values", partition_values(F.col("partition_dir")))
        .withColumn("schema_signature", signature)
        .select(*SCAN_COLUMNS)
    )


def schema_groups(scan: DataFrame) -> DataFrame:
    """``schema_signature, file_count, sample_file``; files with errors form the group ``unreadable``."""
    key = F.coalesce("schema_signature", F.lit("unreadable")).alias("schema_signature")
    return scan.groupBy(key).agg(F.count(F.lit(1)).alias("file_count"), F.min("relative_path").alias("sample_file"))


def missing_partition_keys(scan: DataFrame) -> DataFrame:
    """Files whose path lacks a partition key that other files have.

    The set of keys (folder levels of the data set) is a scalar subquery.
    """
    keys = scan.select(F.explode(F.map_keys("partition_values")).alias("k")).agg(F.sort_array(F.collect_set("k")).alias("keys")).scalar()
    missing = F.array_except(keys, F.map_keys("partition_values"))
    return scan.select("relative_path", missing.alias("missing_keys")).filter(F.size("missing_keys") > 0)


def small_files(scan: DataFrame) -> DataFrame:
    return scan.filter((F.col("file_size") > 0) & (F.col("file_size") < SMALL_FILE)).select("relative_path", "file_size", "row_count")


def empty_files(scan: DataFrame) -> DataFrame:
    return scan.filter((F.col("file_size") == 0) | (F.col("row_count") == 0)).select("relative_path", "file_size", "row_count")


def unreadable_files(scan: DataFrame) -> DataFrame:
    return scan.filter("error IS NOT NULL").select("relative_path", "error")


def partition_sizes(scan: DataFrame) -> DataFrame:
    return scan.groupBy("partition_dir").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
    )


def uneven_partitions(scan: DataFrame) -> DataFrame:
    """One row when the largest partition is ten times the smallest or more, else none."""
    sized = partition_sizes(scan).filter("total_size > 0")
    ends = sized.agg(F.min("total_size").alias("smallest_size"), F.max("total_size").alias("largest_size"), F.count(F.lit(1)).alias("n"))
    ratio = F.col("largest_size") / F.col("smallest_size")
    return ends.filter((F.col("n") > 1) & (ratio >= UNEVEN_RATIO)).select("smallest_size", "largest_size", F.round(ratio, 3).alias("ratio"))


def dataset_totals(scan: DataFrame) -> DataFrame:
    return scan.agg(
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
        F.count_distinct(F.coalesce("schema_signature", F.lit("unreadable"))).alias("schema_groups"),
    )


def dataset_warnings(scan: DataFrame) -> DataFrame:
    """``level, category, subject, message, recommendation``, in the shape of the doctor's issues."""
    n = F.count(F.lit(1)).alias("n")
    tests = {
        "inconsistent_schemas": schema_groups(scan).agg(n).select((F.col("n") > 1).alias("on")),
        "missing_partition_keys": missing_partition_keys(scan).agg(n).select((F.col("n") > 0).alias("on")),
        "empty_files": empty_files(scan).agg(n).select((F.col("n") > 0).alias("on")),
        "small_files": small_files(scan).agg(n).select((F.col("n") > 0).alias("on")),
        "uneven_partitions": uneven_partitions(scan).agg(n).select((F.col("n") > 0).alias("on")),
        "unreadable_files": unreadable_files(scan).agg(n).select((F.col("n") > 0).alias("on")),
    }
    rows = [
        found.filter("on").select(
            F.lit("warning").alias("level"),
            F.lit("dataset").alias("category"),
            F.lit("folder").alias("subject"),
            F.lit(name).alias("message"),
            F.lit(ADVICE[name]).alias("recommendation"),
        )
        for name, found in tests.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def compact_dataset(spark: SparkSession, root: str, out: str, target_mb: int = 256) -> None:
    """Rewrite a partitioned Parquet folder with files of about ``target_mb``.

    A rebalance on the partition columns lets AQE merge small and split large
    shuffle partitions by size, so one heavy partition value becomes many
    files written in parallel. Partition values stay as they are spelled.
    """
    settings = {
        "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{target_mb}MB",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        reader = spark.read.option("mergeSchema", True)
        table = reader.parquet(root)
        plain = reader.option("recursiveFileLookup", True).parquet(root)
        keys = [c for c in table.columns if c not in plain.columns]
        writer = table.hint("rebalance", *keys).write.mode("errorifexists")
        (writer.partitionBy(*keys) if keys else writer).parquet(out)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
