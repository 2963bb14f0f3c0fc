"""One entry point for every file format."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..functions import names
from ..plans.files import load_paths
from .arrowfile import read_arrow
from .jsonrecords import flatten_json, require_records
from .options import DELIMITERS, format_of, normalize_options
from .workbooks import read_workbooks

# Spark's names of the supported encodings.
CHARSETS = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1", "utf-16": "UTF-16"}


def read_table(spark: SparkSession, path: str, options: dict | None = None) -> DataFrame:
    """Read a file, a folder of part files or a glob by its extension.

    ``options`` are the reader options of the format (see ``sources.options``)
    plus, for any text format, ``schema`` to skip the pass that infers types
    and ``multi_line`` for line breaks inside values (such files are not split).
    ``format`` overrides the extension; ``merge_schema`` unites the columns of
    Parquet files that differ; ``only_workbooks`` raises an error where a file
    with the ending of a workbook is none.
    """
    given = dict(options or {})
    family = given.pop("format", None) or format_of(path)[0]
    chosen = normalize_options(family, given)
    if family == "parquet":
        return load_paths(spark.read.format("parquet").option("mergeSchema", bool(given.get("merge_schema"))), [path])
    if family == "orc":
        return load_paths(spark.read.format("orc"), [path])
    if family in DELIMITERS:
        return _read_delimited(spark, path, chosen, given)
    if family == "json":
        return _read_json(spark, path, chosen, given)
    if family in ("arrow", "feather"):
        return read_arrow(spark, path)
    if family == "avro":
        return read_avro(spark, path)
    return read_workbooks(spark, path, chosen, bool(given.get("only_workbooks")))


def _read_delimited(spark: SparkSession, path: str, chosen: dict, given: dict) -> DataFrame:
    reader = spark.read.options(
        header=chosen["header"], sep=chosen["delimiter"], encoding=CHARSETS[chosen["encoding"]], nullValue=chosen["null_string"]
    )
    reader = reader.option("quote", chosen["quote"]).option("escape", chosen["escape"] or "\u0000")
    # A UTF-16 line break is two bytes, which the line splitter does not know.
    if given.get("multi_line") or chosen["encoding"] == "utf-16":
        reader = reader.option("multiLine", True)
    if given.get("schema"):
        return load_paths(reader.schema(given["schema"]).format("csv"), [path])
    df = load_paths(reader.option("inferSchema", True).format("csv"), [path])
    return df if chosen["header"] else df.toDF(*[f"column{i}" for i in range(len(df.columns))])


def _read_json(spark: SparkSession, path: str, chosen: dict, given: dict) -> DataFrame:
    whole = path.lower().rstrip("/").endswith(".json") if "multi_line" not in given else given["multi_line"]
    reader = spark.read.option("multiLine", whole)
    if chosen["require_objects"]:
        reader = reader.option("mode", "FAILFAST")
    df = load_paths((reader.schema(given["schema"]) if given.get("schema") else reader).format("json"), [path])
    if chosen["record_path"]:
        df = require_records(df, chosen["record_path"])
    return flatten_json(df) if chosen["flatten"] else df


def read_avro(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.format("avro").load(path)
    except AnalysisException as problem:
        if "avro" in str(problem).lower():
            raise RuntimeError("Avro needs the org.apache.spark:spark-avro package on the cluster.") from problem
        raise


def unique_columns(df: DataFrame) -> DataFrame:
    """Repeated or blank column names made unique: ``x, x_2, column``."""
    return df.toDF(*names.unique_names(df.columns))
