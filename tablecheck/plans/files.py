"""Listing files and reading their footers inside tasks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from .shipping import ship_package
from .small import small_frame

# The four bytes at both ends of a Parquet file, least size of one.
PARQUET_MAGIC = b"PAR1"
LEAST_PARQUET_SIZE = 8

#: Bytes of a file that one value may hold.
LONGEST_CONTENT = 1 << 30

_UNITS = {"milliseconds": "MILLIS", "microseconds": "MICROS", "nanoseconds": "NANOS"}

COLUMN_STRUCT = (
    "path string, name string, parent_path string, depth int, physical_type string, logical_type string, "
    "converted_type string, nullable_status string, repetition_level int, definition_level int, "
    "decimal_precision int, decimal_scale int, timestamp_unit string, is_adjusted_to_utc boolean, type_signature string"
)
CHUNK_STRUCT = (
    "column string, compression string, encodings array<string>, num_values bigint, compressed_size bigint, "
    "uncompressed_size bigint, min_value string, max_value string, null_count bigint, distinct_count bigint"
)
FOOTER_SCHEMA = (
    "path string, file_size bigint, starts_with_magic boolean, ends_with_magic boolean, row_groups int, error string, "
    f"columns array<struct<{COLUMN_STRUCT}>>, row_group int, row_count bigint, chunks array<struct<{CHUNK_STRUCT}>>"
)


def scheme_of(path: str) -> str:
    """The scheme of a path or URI, or nothing."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/", path)
    return found.group(1).lower() if found else ""


def qualified(spark: SparkSession, path: str) -> str:
    """A path without a scheme as Spark takes it: in its own file system and working folder, which need not be those of Python."""
    if scheme_of(path):
        return path
    plain = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = plain.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub(r"^file:/+", "/", system.makeQualified(plain).toString())


def access_settings(spark: SparkSession) -> dict[str, str]:
    """What tasks need to open objects of a store themselves: the session's own settings of it."""
    given = dict(spark.sparkContext.getConf().getAll())
    return {k.removeprefix("spark.hadoop."): v for k, v in given.items() if k.startswith("spark.hadoop.fs.s3a.")}


def file_system(path: str, settings: dict[str, str] | None = None):
    """pyarrow file system of a qualified path or URI, and the path inside it."""
    import pyarrow.fs as pafs

    kind = scheme_of(path)
    if kind in ("", "file"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    if kind in ("s3", "s3a", "s3n"):
        inner = path.split(":", 1)[1].lstrip("/")
        return _object_store(inner.split("/", 1)[0], settings or {}), inner
    return pafs.FileSystem.from_uri(path)


def _object_store(bucket: str, settings: dict[str, str]):
    import pyarrow.fs as pafs

    def of(name: str) -> str | None:
        return settings.get(f"fs.s3a.bucket.{bucket}.{name}") or settings.get(f"fs.s3a.{name}")

    given = {
        "access_key": of("access.key"),
        "secret_key": of("secret.key"),
        "session_token": of("session.token"),
        "region": of("endpoint.region"),
        "endpoint_override": of("endpoint"),
        "scheme": "http" if of("connection.ssl.enabled") == "false" else None,
        "anonymous": True if "Anonymous" in (of("aws.credentials.provider") or "") else None,
    }
    return pafs.S3FileSystem(**{k: v for k, v in given.items() if v})


def opens_directly(root: str, settings: dict[str, str]) -> bool:
    """Whether tasks can open files below ``root`` at any place; others come whole through Spark's reader."""
    if scheme_of(root) in ("", "file", "s3", "s3a", "s3n"):
        return True
    try:
        file_system(root, settings)
    except Exception:  # no driver for this kind of store, or it cannot be loaded here
        return False
    return True


def open_file(path: str, settings: dict[str, str], content: bytes | None = None):
    """The file for reading at any place, from its bytes if they are at hand."""
    import pyarrow as pa

    if content is not None:
        return pa.BufferReader(content)
    system, inner = file_system(path, settings)
    return system.open_input_file(inner)


def plain_path(uri: Column) -> Column:
    """Local files without their scheme."""
    return F.regexp_replace(uri, "^file:/+", "/")


def path_of_uri(uri: Column) -> Column:
    """The ``_metadata.file_path`` of a row as the listing spells it: nothing escaped, local files without their scheme."""
    return plain_path(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))))


def load_paths(reader: DataFrameReader, roots: list[str]) -> DataFrame:
    """``reader.load`` of files, folders and globs. A path that is none as a glob is taken by the letter."""
    try:
        return reader.load(roots)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
    try:
        return reader.load([re.sub(r"([\\\[\]{}*?])", r"\\\1", root) for root in roots])
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(", ".join(roots)) from None


def list_files(spark: SparkSession, root: str | list[str], names: str | None = None, content: bool = False) -> DataFrame:
    """``path, file_size`` (and ``content``) of every file below the given files, folders and globs.

    Spark lists them with its own file systems and credentials, whatever the
    scheme, in a job of its own where there are many folders; no list comes to
    Python. ``names`` is a glob of file names. Hidden files are left out, as in
    every read of Spark's. ``content`` is null where a file is too long for one
    value.
    """
    roots = [root] if isinstance(root, str) else list(root)
    if not roots:
        return small_frame(spark, [], "path string, file_size bigint" + (", content binary" if content else ""))
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = load_paths(reader.option("pathGlobFilter", names) if names else reader, roots)
    columns = [plain_path(F.col("path")).alias("path"), F.col("length").alias("file_size")]
    sized, empty = found.select(*columns), _empty_files(spark, found)
    if not content:
        return sized.unionByName(empty)
    # The filters reach the reader, which opens no file they leave out.
    short = found.filter(F.col("length") <= LONGEST_CONTENT).select(*columns, "content")
    long = found.filter(F.col("length") > LONGEST_CONTENT).select(*columns, F.lit(None).cast("binary").alias("content"))
    return short.unionByName(long).unionByName(empty.withColumn("content", F.lit(b"")))


def _empty_files(spark: SparkSession, found: DataFrame) -> DataFrame:
    """``path, file_size`` of files without a byte, which a scan leaves out: those of Spark's own list that it does not give.

    The list stays in the JVM, where the scan holds it anyway.
    """
    jvm, named = spark._jvm, found._jdf.inputFiles()
    objects = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, len(named))  # the type that asList takes
    jvm.java.lang.System.arraycopy(named, 0, objects, 0, len(named))
    listed = jvm.java.util.Arrays.asList(objects)
    every = DataFrame(spark._jsparkSession.createDataset(listed, jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    paths = every.select(path_of_uri(F.col("value")).alias("path")).distinct()
    seen = found.select(plain_path(F.col("path")).alias("path"))
    return paths.join(seen, "path", "left_anti").select("path", F.lit(0).cast("bigint").alias("file_size"))


def files_to_open(spark: SparkSession, root: str | list[str], names: str | None = None) -> DataFrame:
    """``path, file_size, content`` for ``open_file`` in tasks; the content is null where tasks open files themselves."""
    settings = access_settings(spark)
    roots = [qualified(spark, r) for r in ([root] if isinstance(root, str) else root)]
    direct = [r for r in roots if opens_directly(r, settings)]
    others = [r for r in roots if r not in direct]
    nothing = F.lit(None).cast("binary").alias("content")
    if not others:
        return list_files(spark, direct, names).select("path", "file_size", nothing)
    found = list_files(spark, others, names, content=True)
    return found.unionByName(list_files(spark, direct, names).select("path", "file_size", nothing)) if direct else found


def relative_path(root: str, path: Column) -> Column:
    """The path below the qualified root, or below the last folder before the first wild card of it."""
    parts = re.sub(r"^file:/+", "/", root).rstrip("/").split("/")
    wild = next((i for i, part in enumerate(parts) if re.search(r"[*?{\[]", part)), len(parts))
    base = "/".join(parts[:wild]) + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def any_case(*extensions: str) -> str:
    """Glob of file names with one of the extensions, whatever the case."""
    spelled = ["".join(f"[{c.lower()}{c.upper()}]" for c in e.lstrip(".")) for e in extensions]
    return "*.{" + ",".join(spelled) + "}"


def read_footers(files: DataFrame, decode: bool = False) -> DataFrame:
    """Parquet footers: a row per file (``columns`` set) and per row group (``chunks`` set).

    Reads the first and last bytes and the footer only, unless ``decode`` asks
    for a full read as well. A file that cannot be read gives a row with
    ``error``; nothing is raised. ``files`` is what ``files_to_open`` gives.
    """
    ship_package(files.sparkSession)
    settings = access_settings(files.sparkSession)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size, content in zip(batch["path"], batch["file_size"], batch["content"]):
                yield pd.DataFrame(footer_rows(path, int(size), decode, settings, content), columns=_FOOTER_COLUMNS)

    return files.select("path", "file_size", "content").mapInPandas(scan, FOOTER_SCHEMA)


_FOOTER_COLUMNS = [
    "path",
    "file_size",
    "starts_with_magic",
    "ends_with_magic",
    "row_groups",
    "error",
    "columns",
    "row_group",
    "row_count",
    "chunks",
]


def footer_rows(path: str, size: int, decode: bool, settings: dict[str, str], content: bytes | None = None) -> list[tuple]:
    import pyarrow.parquet as pq

    starts = ends = False
    try:
        if size < LEAST_PARQUET_SIZE:
            raise ValueError(f"only {size} bytes long")
        with open_file(path, settings, content) as source:
            starts = source.read(4) == PARQUET_MAGIC
            source.seek(size - 4)
            ends = source.read(4) == PARQUET_MAGIC
            source.seek(0)
            parquet = pq.ParquetFile(source)
            meta = parquet.metadata
            if decode:
                for _ in parquet.iter_batches():
                    pass
            rows = [(path, size, starts, ends, meta.num_row_groups, None, _columns(parquet.schema), None, meta.num_rows, None)]
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                chunks = [_chunk(group.column(c)) for c in range(group.num_columns)]
                rows.append((path, size, starts, ends, None, None, None, g, group.num_rows, chunks))
            return rows
    except Exception as problem:  # the report must list every file, readable or not
        return [(path, size, starts, ends, None, f"{type(problem).__name__}: {problem}", None, None, None, None)]


def _leaves(schema) -> list[tuple[str, int]]:
    """Repetition word and depth of each leaf, in order, from the nesting of the schema's own text form."""
    leaves, depth = [], 0
    for line in (line.strip() for line in str(schema).splitlines()):
        if line.endswith(";"):
            leaves.append((line.split()[0], depth))
        depth += line.endswith("{") - (line == "}")
    return leaves


def _columns(schema) -> list[dict]:
    result = []
    for i, (repetition, depth) in enumerate(_leaves(schema)):
        leaf = schema.column(i)
        logical = json.loads(leaf.logical_type.to_json())
        kind = logical.get("Type")
        kind = None if kind in (None, "None", "Unknown", "Undefined") else kind.upper()
        decimal = kind == "DECIMAL"
        stamped = kind in ("TIMESTAMP", "TIME")
        converted = None if leaf.converted_type == "NONE" else leaf.converted_type
        result.append(
            {
                "path": leaf.path,
                "name": leaf.name,
                # A name may hold dots, so the path is not split at them.
                "parent_path": leaf.path.removesuffix(leaf.name).removesuffix(".") or None,
                "depth": depth,
                "physical_type": leaf.physical_type,
                "logical_type": kind,
                "converted_type": converted,
                "nullable_status": {"optional": "nullable", "required": "required"}.get(repetition, "repeated"),
                "repetition_level": leaf.max_repetition_level,
                "definition_level": leaf.max_definition_level,
                "decimal_precision": logical.get("precision") if decimal else None,
                "decimal_scale": logical.get("scale") if decimal else None,
                "timestamp_unit": _UNITS.get(logical.get("timeUnit")) if stamped else None,
                "is_adjusted_to_utc": logical.get("isAdjustedToUTC") if stamped else None,
                "type_signature": _signature(leaf.physical_type, kind),
            }
        )
    return result


def _signature(physical: str, logical: str | None) -> str:
    if logical in ("STRING", "ENUM", "JSON"):
        return "TEXT"
    if logical in ("DATE", "TIME", "TIMESTAMP") or physical == "INT96":
        return "TEMPORAL"
    if logical in ("INT", "DECIMAL", "FLOAT16") or (logical is None and physical in ("INT32", "INT64", "FLOAT", "DOUBLE")):
        return "NUMERIC"
    return "BOOLEAN" if physical == "BOOLEAN" else (logical or physical)


def _chunk(column) -> dict:
    stats = column.statistics
    known = stats is not None
    limits = known and stats.has_min_max
    return {
        "column": column.path_in_schema,
        "compression": column.compression,
        "encodings": list(column.encodings),
        "num_values": column.num_values,
        "compressed_size": column.total_compressed_size,
        "uncompressed_size": column.total_uncompressed_size,
        "min_value": str(stats.min) if limits else None,
        "max_value": str(stats.max) if limits else None,
        "null_count": stats.null_count if known and stats.has_null_count else None,
        "distinct_count": stats.distinct_count if known and stats.has_distinct_count else None,
    }


def footers(spark: SparkSession, path: str | list[str], decode: bool = False) -> DataFrame:
    """Footers of every ``.parquet`` file below ``path``."""
    return read_footers(files_to_open(spark, path, any_case("parquet")), decode)
