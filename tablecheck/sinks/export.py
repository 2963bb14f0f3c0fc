"""Writing tables: Parquet with chosen types, and export to every other format."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names, values
from ..functions import types as ty
from ..operators.joins import join_tables
from ..operators.query import run_sql
from ..operators.writetypes import as_write_type
from ..plans.files import list_files
from ..sources.arrowfile import write_arrow
from ..sources.catalog import open_relation
from ..sources.options import DELIMITERS, format_of

# Codecs, export formats.
CODECS = ("uncompressed", "snappy", "gzip", "brotli", "zstd")
# Moments as text, with all their digits.
MOMENTS = {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"}
TEXT_FORMATS = (*DELIMITERS, "json", "jsonl", "ndjson")
EXPORT_FORMATS = ("csv", "tsv", "psv", "json", "jsonl", "ndjson", "parquet", "avro", "orc", "arrow", "feather", "ipc")
# Codecs of text exports; readers tell them by the extension of the parts.
TEXT_CODECS = ("gzip", "bzip2", "deflate", "lz4", "snappy")
JOBS_AT_ONCE = 4
# Rows of a JSON array or delimited file: one task reads such a file whole where values have line breaks.
ROWS_PER_FILE = 50_000


@dataclass(frozen=True)
class Exported:
    path: str
    format: str
    rows: int
    files: int


@dataclass(frozen=True)
class OutputColumn:
    """A source column, its new name and write type."""

    source: str
    name: str = ""
    type: str = "VARCHAR"


@dataclass
class _Counted:
    """Counts rows while they are written, so that the query runs once."""

    df: DataFrame
    seen: Observation = field(default_factory=Observation)

    @property
    def rows(self) -> DataFrame:
        return self.df.observe(self.seen, F.count(F.lit(1)).alias("rows"))

    def finish(self, path: str, fmt: str) -> Exported:
        return Exported(path, fmt, int(self.seen.get["rows"]), list_files(self.df.sparkSession, path).count())


def typed_columns(df: DataFrame, columns: list[OutputColumn] | None = None) -> DataFrame:
    """Columns renamed (made unique) and cast to their write types; what does not fit is null."""
    columns = columns or [OutputColumn(f.name, f.name, _usual_type(f.dataType)) for f in df.schema.fields]
    if not columns:
        raise ValueError("Choose at least one column to write.")
    blanks = [c.name.strip() or f"column_{i}" for i, c in enumerate(columns, 1)]
    wanted = names.unique_names(blanks)
    return df.select(
        *[as_write_type(names.col(c.source), df.schema[c.source].dataType, c.type).alias(n) for c, n in zip(columns, wanted)]
    )


def _usual_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "BOOLEAN"
    if isinstance(dtype, T.IntegralType):
        return "BIGINT"
    if isinstance(dtype, T.DecimalType):
        return "DECIMAL"
    if ty.is_numeric(dtype):
        return "DOUBLE"
    if isinstance(dtype, T.DateType):
        return "DATE"
    return "TIMESTAMP" if ty.is_temporal(dtype) else "VARCHAR"


def create_parquet(
    df: DataFrame,
    path: str,
    columns: list[OutputColumn] | None = None,
    compression: str = "snappy",
    row_group_size: int | None = None,
    mode: str = "errorifexists",
) -> Exported:
    """Parquet with chosen names, write types, codec and rows per row group."""
    codec = (compression or "snappy").lower()
    if codec not in CODECS:
        raise ValueError(f"Unknown codec {compression!r}; use one of {', '.join(CODECS)}.")
    counted = _Counted(typed_columns(df, columns))
    writer = counted.rows.write.mode(mode).option("compression", codec)
    if row_group_size is not None:
        if int(row_group_size) < 1:
            raise ValueError("A row group has one row at least.")
        writer = writer.option("parquet.block.row.count.limit", int(row_group_size))
    writer.parquet(path)
    return counted.finish(path, "parquet")


def json_array_lines(df: DataFrame) -> DataFrame:
    """Lines of JSON arrays of ``ROWS_PER_FILE`` rows: ``[``, the rows with commas between, ``]``; the last array of a partition may be shorter.

    Rows stream through as Arrow text; a partition's text is never held as a whole.
    """
    objects = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", **MOMENTS}).alias("value"))
    most = ROWS_PER_FILE

    def bracket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        def lines(values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([values], names=["value"])

        yield lines(pa.array(["["], pa.string()))
        held = 0
        for batch in batches:
            values = batch.column(0)
            while len(values):
                if held == most:
                    yield lines(pa.array(["]", "["], pa.string()))
                    held = 0
                taken = values.slice(0, most - held if held else 1)
                yield lines(pc.binary_join_element_wise(pa.scalar("", values.type), taken, pa.scalar(",", values.type)) if held else taken)
                values, held = values.slice(len(taken)), held + len(taken)
        yield lines(pa.array(["]"], pa.string()))

    return objects.mapInArrow(bracket, "value string")


def _plain(df: DataFrame) -> DataFrame:
    """Nested values as JSON text, for formats without nesting."""
    return df.select(
        *[
            values.as_text(names.col(f.name), f.dataType).alias(f.name)
            if ty.is_nested(f.dataType) or isinstance(f.dataType, T.BinaryType)
            else names.col(f.name)
            for f in df.schema.fields
        ]
    )


def export_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "errorifexists", compression: str | None = None) -> Exported:
    """Write a table to a folder of part files in one of ``EXPORT_FORMATS``; counts rows on the way.

    Texts are written plain, or packed by one of ``TEXT_CODECS``: a table is many times as long in text as in Parquet.
    """
    fmt = (fmt or format_of(path)[1]).lower()
    if fmt not in EXPORT_FORMATS:
        raise ValueError(f"Unknown export format {fmt!r}; use one of {', '.join(EXPORT_FORMATS)}.")
    if compression is not None and (compression not in TEXT_CODECS or fmt not in TEXT_FORMATS):
        raise ValueError(f"{fmt} cannot be packed by {compression!r}; {', '.join(TEXT_FORMATS)} can, by {', '.join(TEXT_CODECS)}.")
    packed = {"compression": compression} if compression else {}
    named = df.toDF(*names.unique_names(df.columns))
    counted = _Counted(_plain(named) if fmt in DELIMITERS else named)
    rows = counted.rows
    if fmt in DELIMITERS:
        writer = rows.write.mode(mode).options(**MOMENTS, **packed).option("header", True).option("sep", DELIMITERS[fmt])
        writer.option("escape", '"').option("maxRecordsPerFile", ROWS_PER_FILE).csv(path)
    elif fmt == "json":
        # A file for each array: its rows and two brackets.
        json_array_lines(rows).write.mode(mode).options(**packed).option("maxRecordsPerFile", ROWS_PER_FILE + 2).text(path)
    elif fmt in ("jsonl", "ndjson"):
        rows.write.mode(mode).options(**MOMENTS, **packed).option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        rows.write.mode(mode).parquet(path)
    elif fmt == "orc":
        rows.write.mode(mode).orc(path)
    elif fmt == "avro":
        try:
            rows.write.mode(mode).format("avro").save(path)
        except AnalysisException as problem:
            raise RuntimeError("Avro needs the org.apache.spark:spark-avro package on the cluster.") from problem
    else:
        write_arrow(rows, path, fmt, mode)
    return counted.finish(path, fmt)


def export_join(base: DataFrame, other: DataFrame, base_column: str, join_column: str, how: str, path: str) -> Exported:
    """The whole join (not a preview) as CSV."""
    return export_table(join_tables(base, other, base_column, join_column, how), path, "csv")


def export_query(spark: SparkSession, df: DataFrame, sql: str | None, path: str, fmt: str) -> Exported:
    """Scope ``query``: the result of a query over the open table."""
    return export_table(run_sql(spark, df, sql), path, fmt)


def export_relations(spark: SparkSession, relations: list, folder: str, fmt: str) -> list[Exported]:
    """Scopes ``relation`` and ``allRelations``: one output folder per relation.

    Names are ``<schema>_<name>``, made unique. The writes are independent
    Spark jobs; a few run at a time.
    """
    outputs = names.unique_view_names([f"{r['schema']}_{r['name']}".replace(".", "_") for r in relations])

    def write(pair) -> Exported:
        relation, output = pair
        return export_table(open_relation(spark, relation), f"{folder.rstrip('/')}/{output}", fmt)

    with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
        return list(pool.map(write, zip(relations, outputs)))


def save_edited_copy(rows: DataFrame, source_path: str, path: str) -> Exported:
    """Edited rows in the format of their source, never over an existing file.

    A table left without rows is written with text columns.
    """
    fmt = format_of(source_path)[1]
    if fmt == "xlsx":
        raise ValueError("Workbooks cannot be written; choose another format.")
    if rows.isEmpty():
        rows = rows.select(*[values.as_text(names.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields])
    return export_table(rows, path, fmt)
