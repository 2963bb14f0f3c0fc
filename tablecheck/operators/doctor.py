"""Health checks of files and tables; each gives rows, ``doctor`` unites them as issues."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names, values
from ..functions import types as ty
from ..plans.aggregate import column_metrics, distinct_rows
from ..plans.files import any_case, footers, load_paths, path_of_uri, qualified
from ..plans.small import small_frame
from ..plans.storage import checkpointed
from ..sources.folder import tables_below
from .schema import parquet_schema

# Thresholds and word lists of the checks.
HIGH_NULL_RATIO = 0.5
DEFAULT_WORDS = ("unknown", "n/a", "na", "null", "none", "0")
DEFAULT_SHARE = 0.1
EARLIEST, LATEST = "1900-01-01", "2200-01-01"
SMALL_ROW_GROUP = 100
LARGE_ROW_GROUP = 1_000_000
WEAK_COMPRESSION = 1.1
WORTH_COMPRESSING = 1024 * 1024
LOW_CARDINALITY, HIGH_CARDINALITY = 0.1, 0.8
SAFE_PRECISION = 18
PENALTY = 25
# Tables of a folder that are judged side by side.
TABLES_AT_ONCE = 8

# What each finding means and what to do about it.
ADVICE = {
    "too_short": "Write the file again; it is shorter than any Parquet file.",
    "bad_header": "Check that this is a Parquet file and not another kind renamed.",
    "bad_footer": "Write the file again; its end is missing.",
    "unreadable": "Write the file again or restore it from its source.",
    "text_not_bytes": "Compare the writer's schema with the meaning of the column.",
    "decimal_incomplete": "State precision and scale in the writer's schema.",
    "timestamp_without_unit": "State the timestamp unit in the writer's schema.",
    "bytes_without_meaning": "Annotate the column as text if it holds text.",
    "decimal_scale_above_precision": "Correct the decimal's scale.",
    "decimal_very_precise": "Check that readers can hold this many digits.",
    "floating_point": "Use a decimal where exact amounts matter.",
    "timezone_unknown": "State whether the timestamps are in UTC.",
    "empty_row_group": "Write row groups of even, larger size.",
    "small_row_group": "Write row groups of even, larger size.",
    "large_row_group": "Write row groups of even, smaller size.",
    "no_compressed_size": "Write the file again with complete metadata.",
    "no_statistics": "Write the file with column statistics.",
    "no_min_max": "Write the file with column statistics.",
    "no_null_count": "Write the file with column statistics.",
    "only_nulls": "Drop the column if nothing fills it.",
    "one_value": "Drop the column if it never varies.",
    "high_null_ratio": "Find out why values are missing.",
    "empty_strings": "Write nulls instead of empty text.",
    "default_values": "Write nulls instead of placeholder words.",
    "all_zero": "Check that the source fills this column.",
    "min_out_of_range": "Check the date for a wrong unit or placeholder.",
    "max_out_of_range": "Check the date for a wrong unit or placeholder.",
    "duplicate_rows": "Remove the copies unless they are meant.",
    "weak_compression": "Choose another codec or encoding.",
    "uncompressed": "Write the column with a codec.",
    "missing_dictionary": "Turn on dictionary encoding for this column.",
    "needless_dictionary": "Turn off dictionary encoding for this column.",
    "no_columns": "Check the reader options; no column was found.",
    "blank_column_name": "Give the column a name.",
    "several_relations": "Name the table to be read.",
    "short_read": "Write the file again; its footer promises more rows than can be read.",
    "not_scanned": "Repair the files, then run the checks again.",
}


def _found(*tests: tuple[str, Column]) -> Column:
    """Names of the tests that hold, in order."""
    flags = [F.when(condition, F.lit(name)) for name, condition in tests]
    return F.array_compact(F.array(*flags))


def file_integrity(spark: SparkSession, path: str | list[str], decode: bool = False, scanned: DataFrame | None = None) -> DataFrame:
    """Size, magic bytes and readability of each Parquet file."""
    rows = scanned if scanned is not None else footers(spark, path, decode)
    return rows.filter("row_group IS NULL").select(
        "path",
        "file_size",
        "starts_with_magic",
        "ends_with_magic",
        F.col("error").isNull().alias("readable"),
        F.col("row_groups").cast("long").alias("row_groups"),
        "error",
        _found(
            ("too_short", F.col("file_size") < 8),
            ("bad_header", (F.col("file_size") >= 8) & ~F.col("starts_with_magic")),
            ("bad_footer", (F.col("file_size") >= 8) & ~F.col("ends_with_magic")),
            ("unreadable", (F.col("file_size") >= 8) & F.col("error").isNotNull()),
        ).alias("issues"),
    )


def schema_validation(spark: SparkSession, path: str | list[str], scanned: DataFrame | None = None) -> DataFrame:
    """Annotations of each column of each file that do not fit its stored type."""
    bytes_stored = F.col("physical_type").isin("BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY")
    kind = F.coalesce(F.col("logical_type"), F.lit(""))
    half_decimal = F.col("decimal_precision").isNull() | F.col("decimal_scale").isNull()
    return parquet_schema(spark, path, scanned).select(
        "file",
        F.col("path").alias("column"),
        "physical_type",
        "logical_type",
        "nullable_status",
        _found(
            ("text_not_bytes", (kind == "STRING") & ~bytes_stored),
            ("decimal_incomplete", (kind == "DECIMAL") & half_decimal),
            ("timestamp_without_unit", (kind == "TIMESTAMP") & F.col("timestamp_unit").isNull()),
            ("bytes_without_meaning", bytes_stored & (kind == "")),
        ).alias("issues"),
    )


def decimal_timestamp_diagnostics(spark: SparkSession, path: str | list[str], scanned: DataFrame | None = None) -> DataFrame:
    """Columns whose decimal, floating-point or timestamp type needs care."""
    kind = F.coalesce(F.col("logical_type"), F.lit(""))
    precision, scale = F.col("decimal_precision"), F.col("decimal_scale")
    complete = precision.isNotNull() & scale.isNotNull()
    decimal, stamp = kind == "DECIMAL", kind == "TIMESTAMP"
    checked = parquet_schema(spark, path, scanned).select(
        "file",
        F.col("path").alias("column"),
        "physical_type",
        "logical_type",
        "decimal_precision",
        "decimal_scale",
        "timestamp_unit",
        "is_adjusted_to_utc",
        _found(
            ("decimal_incomplete", decimal & ~complete),
            ("decimal_scale_above_precision", decimal & complete & (scale > precision)),
            ("decimal_very_precise", decimal & complete & (scale <= precision) & (precision > SAFE_PRECISION)),
            ("floating_point", F.col("physical_type").isin("FLOAT", "DOUBLE") & ~decimal),
            ("timestamp_without_unit", stamp & F.col("timestamp_unit").isNull()),
            ("timezone_unknown", stamp & F.col("is_adjusted_to_utc").isNull()),
        ).alias("issues"),
    )
    return checked.filter(F.size("issues") > 0)


def _chunks(spark: SparkSession, path: str | list[str], scanned: DataFrame | None) -> DataFrame:
    rows = scanned if scanned is not None else footers(spark, path)
    groups = rows.filter("row_group IS NOT NULL")
    return groups.select("path", "row_group", "row_count", F.inline("chunks"))


def row_groups(spark: SparkSession, path: str | list[str], scanned: DataFrame | None = None) -> DataFrame:
    """Size, compression and findings of each row group of each file.

    A row group's chunks arrive as one array, so nothing is shuffled.
    """
    rows = scanned if scanned is not None else footers(spark, path)
    groups = rows.filter("row_group IS NOT NULL")

    def total(field: str) -> Column:
        return F.aggregate("chunks", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.coalesce(c[field], F.lit(0)))

    codecs = F.array_sort(F.array_distinct(F.transform("chunks", lambda c: c["compression"])))
    sized = groups.select(
        "path",
        F.col("row_group").cast("long").alias("row_group"),
        "row_count",
        F.array_join(codecs, ", ").alias("compression"),
        total("compressed_size").alias("compressed_size"),
        total("uncompressed_size").alias("uncompressed_size"),
    )
    n, stored = F.col("row_count"), F.col("compressed_size")
    return sized.select(
        "*",
        F.when(stored > 0, F.round(F.col("uncompressed_size") / stored, 3)).alias("compression_ratio"),
        _found(
            ("empty_row_group", n == 0),
            ("small_row_group", (n > 0) & (n < SMALL_ROW_GROUP)),
            ("large_row_group", n > LARGE_ROW_GROUP),
            ("no_compressed_size", (stored == 0) & (n > 0)),
        ).alias("issues"),
    )


def column_statistics(spark: SparkSession, path: str | list[str], scanned: DataFrame | None = None) -> DataFrame:
    """Which statistics each column has in every file, and what they say over all.

    A column counts as constant when the set of its minima equals the set of
    its maxima; the sets are compared by grouping, never gathered.
    """
    chunks = checkpointed_if_needed(_chunks(spark, path, scanned), scanned)
    by_file = chunks.groupBy("path", "column").agg(
        F.count("min_value").alias("mins"),
        F.count("max_value").alias("maxes"),
        F.count("null_count").alias("null_counts"),
        F.count("distinct_count").alias("distinct_counts"),
        F.sum("null_count").alias("nulls"),
        F.sum("distinct_count").alias("distincts"),
        F.coalesce(F.sum("num_values"), F.lit(0)).alias("total"),
    )
    # A column has a statistic if every file has it: one file must not hide another.
    bare = (F.col("mins") == 0) & (F.col("maxes") == 0) & (F.col("null_counts") == 0) & (F.col("distinct_counts") == 0)
    limitless = ~bare & ((F.col("mins") == 0) | (F.col("maxes") == 0))
    merged = by_file.groupBy("column").agg(
        *[F.min(c).alias(c) for c in ("mins", "maxes", "null_counts", "distinct_counts")],
        *[F.sum(c).alias(c) for c in ("nulls", "distincts", "total")],
        F.count_if(bare).alias("files_without_statistics"),
        F.count_if(limitless).alias("files_without_min_max"),
        F.count_if(F.col("null_counts") == 0).alias("files_without_null_count"),
    )
    ends = chunks.select("column", F.explode(F.array(
        F.struct(F.col("min_value").alias("v"), F.lit(True).alias("is_min")), F.struct(F.col("max_value").alias("v"), F.lit(False).alias("is_min"))
    )).alias("e")).select("column", "e.*").filter("v IS NOT NULL")
    equal = (
        ends.groupBy("column", "v")
        .agg((F.bool_or("is_min") & F.bool_or(~F.col("is_min"))).alias("both"))
        .groupBy("column")
        .agg(F.bool_and("both").alias("equal_ends"))
    )
    limits = (F.col("mins") > 0) & (F.col("maxes") > 0)
    counted, distinct = F.col("null_counts") > 0, F.col("distinct_counts") > 0
    total, nulls = F.col("total"), F.coalesce(F.col("nulls"), F.lit(0))
    stated = merged.join(equal, "column", "left").select(
        "column",
        limits.alias("has_min_max"),
        counted.alias("has_null_count"),
        distinct.alias("has_distinct_count"),
        F.when(counted, nulls).alias("null_count"),
        F.when(distinct, F.col("distincts")).alias("distinct_count"),
        ((total > 0) & counted & (nulls >= total)).alias("all_null"),
        (limits & F.coalesce(F.col("equal_ends"), F.lit(False)) & (total - nulls > 0)).alias("constant_value"),
        _found(
            ("no_statistics", F.col("files_without_statistics") > 0),
            ("no_min_max", F.col("files_without_min_max") > 0),
            ("no_null_count", F.col("files_without_null_count") > 0),
        ).alias("lacks"),
    )
    says = _found(("only_nulls", F.col("all_null")), ("one_value", F.col("constant_value")))
    return stated.select("*", F.concat("lacks", says).alias("issues")).drop("lacks")


def checkpointed_if_needed(df: DataFrame, scanned: DataFrame | None) -> DataFrame:
    """A fresh footer scan that is used twice is stored once."""
    return df if scanned is not None else checkpointed(df)


def compression_encoding(spark: SparkSession, path: str | list[str], scanned: DataFrame | None = None) -> DataFrame:
    """Sizes, codecs and encodings of each column over all its chunks.

    The sets gathered here hold codec and encoding names, of which there are
    about a dozen.
    """
    grouped = _chunks(spark, path, scanned).groupBy("column").agg(
        F.collect_set("compression").alias("codecs"),
        F.array_distinct(F.flatten(F.collect_set("encodings"))).alias("codes"),
        F.coalesce(F.sum("compressed_size"), F.lit(0)).alias("compressed_size"),
        F.coalesce(F.sum("uncompressed_size"), F.lit(0)).alias("uncompressed_size"),
        F.coalesce(F.sum("distinct_count"), F.lit(0)).alias("distincts"),
        F.coalesce(F.sum("num_values"), F.lit(0)).alias("total"),
        # Chunk by chunk, so that a compressed file does not hide one that is not.
        F.bool_or(F.coalesce("compression", F.lit("")).isin("", "UNCOMPRESSED")).alias("some_uncompressed"),
        F.bool_or((F.col("compressed_size") == 0) & (F.col("uncompressed_size") > 0)).alias("some_unsized"),
    )
    stored, plain = F.col("compressed_size"), F.col("uncompressed_size")
    known = (F.col("distincts") > 0) & (F.col("total") > 0)
    sized = grouped.select(
        "column",
        F.array_join(F.array_sort("codecs"), ", ").alias("compression"),
        F.array_join(F.array_sort("codes"), ", ").alias("encodings"),
        "compressed_size",
        "uncompressed_size",
        F.when(stored > 0, F.round(plain / stored, 3)).alias("compression_ratio"),
        F.when(known, F.round(F.col("distincts") / F.col("total"), 4)).alias("cardinality_ratio"),
        "some_uncompressed",
        "some_unsized",
    )
    dictionary = F.col("encodings").contains("DICTIONARY")
    spread = F.col("cardinality_ratio")
    return sized.select(
        "*",
        _found(
            ("no_compressed_size", F.col("some_unsized")),
            ("weak_compression", (F.col("compression_ratio") < WEAK_COMPRESSION) & (plain > WORTH_COMPRESSING)),
            ("uncompressed", F.col("some_uncompressed")),
            ("missing_dictionary", (spread < LOW_CARDINALITY) & ~dictionary),
            ("needless_dictionary", (spread > HIGH_CARDINALITY) & dictionary),
        ).alias("issues"),
    ).drop("some_uncompressed", "some_unsized")


_QUALITY = {
    "total_rows": "bigint",
    "null_count": "bigint",
    "empty_string_count": "bigint",
    "suspicious_default_count": "bigint",
    "min_value": "string",
    "max_value": "string",
    "zero_range": "boolean",
}


def _quality_metrics(name: str, dtype: T.DataType) -> dict[str, Column]:
    value = names.col(name)
    metrics = {"total_rows": F.count(F.lit(1)), "null_count": F.count_if(value.isNull())}
    if ty.is_text(dtype):
        metrics["empty_string_count"] = F.count_if(value == "")
        metrics["suspicious_default_count"] = F.count_if(F.lower(F.trim(value)).isin(*DEFAULT_WORDS))
    elif ty.is_numeric(dtype) or ty.is_temporal(dtype):
        low, high = values.plain_zero(F.min(value), dtype), values.plain_zero(F.max(value), dtype)
        metrics["min_value"], metrics["max_value"] = low.cast("string"), high.cast("string")
        if ty.is_numeric(dtype):
            metrics["zero_range"] = (F.min(value) == 0) & (F.max(value) == 0)
    return metrics


def data_quality(df: DataFrame) -> DataFrame:
    """Nulls, empty text, placeholder words, ranges: all columns in one pass."""
    rows = [(i, f.dataType.simpleString(), ty.is_temporal(f.dataType)) for i, f in enumerate(df.schema.fields)]
    declared = small_frame(df.sparkSession, rows, "pos int, data_type string, temporal boolean")
    # One row per column of the schema.
    measured = column_metrics(df, _quality_metrics, _QUALITY).join(F.broadcast(declared), "pos")
    total = F.col("total_rows")
    ratio = F.when(total > 0, F.round(F.col("null_count") / total, 4)).otherwise(F.lit(0.0))
    low, high = F.col("min_value"), F.col("max_value")
    return measured.select(
        "column",
        "data_type",
        "null_count",
        ratio.alias("null_ratio"),
        "empty_string_count",
        "suspicious_default_count",
        "min_value",
        "max_value",
        _found(
            ("high_null_ratio", (total > 0) & (ratio >= HIGH_NULL_RATIO)),
            ("empty_strings", F.col("empty_string_count") > 0),
            ("default_values", (total > 0) & (F.col("suspicious_default_count") / total >= DEFAULT_SHARE)),
            ("all_zero", F.col("zero_range")),
            ("min_out_of_range", F.col("temporal") & ((low < EARLIEST) | (low > LATEST))),
            ("max_out_of_range", F.col("temporal") & ((high < EARLIEST) | (high > LATEST))),
        ).alias("issues"),
    )


def data_quality_totals(df: DataFrame) -> DataFrame:
    """``total_rows, distinct_rows, duplicate_rows``: one shuffle of compact row keys."""
    keys = [values.group_key(names.col(f.name), f.dataType) for f in df.schema.fields]
    counted = distinct_rows(df, keys)
    return counted.select("*", (F.col("total_rows") - F.col("distinct_rows")).alias("duplicate_rows"))


def table_structure(df: DataFrame) -> DataFrame:
    """``row_count, column_count, blank_names, issues`` of any table."""
    blank = sum(not c.strip() for c in df.columns)
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        F.lit(len(df.columns)).cast("long").alias("column_count"),
        F.lit(blank).cast("long").alias("blank_names"),
        _found(("no_columns", F.lit(not df.columns)), ("blank_column_name", F.lit(blank > 0))).alias("issues"),
    )


def catalog_check(relations: DataFrame, selected: str | None = None) -> DataFrame:
    """``tables, views, selected, issues`` of a list of relations."""
    counted = relations.agg(
        F.count_if(F.col("type") == "BASE TABLE").alias("tables"),
        F.count_if(F.col("type") == "VIEW").alias("views"),
    )
    several = F.col("tables") + F.col("views") > 1
    return counted.select("*", F.lit(selected).cast("string").alias("selected"), _found(("several_relations", several)).alias("issues"))


def _as_issues(df: DataFrame, level: str, category: str, subject: Column) -> DataFrame:
    """One row per finding of a check."""
    found = df.select(subject.alias("subject"), F.explode("issues").alias("message"))
    return found.select(F.lit(level).alias("level"), F.lit(category).alias("category"), "subject", "message")


def _report(checks: dict[str, DataFrame]) -> DataFrame:
    """Findings of all checks, and a ``pass`` row for each check without any.

    The findings are stored first, so that each check runs once.
    """
    found = checkpointed(reduce(DataFrame.unionByName, checks.values()))
    every = small_frame(found.sparkSession, [("pass", c, "all", "passed") for c in checks], "level string, category string, subject string, message string")
    return _with_advice(found.unionByName(every.join(found.select("category").distinct(), "category", "left_anti").select(*found.columns)))


def _with_advice(rows: DataFrame) -> DataFrame:
    pairs = [F.lit(x) for item in ADVICE.items() for x in item]
    return rows.select("*", F.create_map(*pairs)[F.col("message")].alias("recommendation"))


def _quality_issues(df: DataFrame) -> dict[str, DataFrame]:
    copies = data_quality_totals(df).select(_found(("duplicate_rows", F.col("duplicate_rows") > 0)).alias("issues"))
    return {
        "data_quality": _as_issues(data_quality(df), "warning", "data_quality", F.col("column")),
        "duplicates": _as_issues(copies, "warning", "duplicates", F.lit("table")),
    }


def doctor_table(df: DataFrame) -> DataFrame:
    """Issues of any table, whatever format it came from."""
    structure = _as_issues(table_structure(df), "warning", "structure", F.lit("table"))
    return _report({"structure": structure, **_quality_issues(df)})


def rows_read(table: DataFrame, scanned: DataFrame) -> DataFrame:
    """``path, row_count, rows_read, issues`` of each file with a footer: rows it promises and rows that could be read.

    ``table`` reads the files with errors ignored, which drops the rest of a
    bad file without a trace. Every column is decoded, as a count alone would
    be answered from the footers.
    """
    decoded = [F.size(names.col(f.name)) if isinstance(f.dataType, T.MapType) else names.col(f.name) for f in table.schema.fields]
    place = path_of_uri(F.col("_metadata.file_path"))
    read = table.select(place.alias("place"), F.xxhash64(*decoded).alias("digest") if _hashable(table.schema) else F.to_json(F.struct(*decoded)).alias("digest"))
    counted = read.groupBy("place").agg(F.count(F.lit(1)).alias("rows_read"), F.max("digest").alias("decoded"))
    promised = scanned.filter("row_group IS NULL AND error IS NULL").select("path", "row_count", F.regexp_replace("path", "^file:/+", "/").alias("place"))
    both = promised.join(counted, "place", "left").select("path", "row_count", F.coalesce("rows_read", F.lit(0)).alias("rows_read"), F.col("decoded").isNotNull().alias("seen"))
    return both.select("path", "row_count", "rows_read", _found(("short_read", (F.col("rows_read") < F.col("row_count")) | (~F.col("seen") & (F.col("row_count") > 0)))).alias("issues"))


def _hashable(dtype: T.DataType) -> bool:
    """Whether the hash functions take the type: all but maps inside other types."""
    if isinstance(dtype, T.StructType):
        return all(_hashable(f.dataType) or isinstance(f.dataType, T.MapType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return not isinstance(dtype.elementType, T.MapType) and _hashable(dtype.elementType)
    return True


def doctor(spark: SparkSession, path: str | list[str], decode: bool = False) -> DataFrame:
    """Issues of the Parquet files below ``path`` that form one table.

    Footers are read once into a checkpoint and serve six checks. Files that
    cannot be read, or not whole, are errors; the data checks run on the rest.
    """
    return _doctor(spark, path, checkpointed(footers(spark, path, decode)))


def doctor_folder(spark: SparkSession, root: str, decode: bool = False) -> DataFrame:
    """Issues of every Parquet table below a folder, with the path of the ``table``.

    A table is a file, or a folder of part files. The footers of all of them
    are read in one scan; the data checks run table by table, a few at a time.
    """
    root = qualified(spark, root).rstrip("/")
    scanned = checkpointed(footers(spark, root, decode))
    tables = sorted(r.path for r in tables_below(spark, root).filter("format = 'parquet'").collect())  # a report each
    if not tables:
        raise ValueError(f"There is no Parquet table below {root!r}.")

    def judged(table: str) -> DataFrame:
        place = re.sub(r"^file:/+", "/", f"{root}/{table}")
        own = scanned.filter((F.col("path") == place) | F.startswith("path", F.lit(place + "/")))
        return _doctor(spark, f"{root}/{table}", own).select(F.lit(table).alias("table"), "*")

    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
        return reduce(DataFrame.unionByName, pool.map(judged, tables))


def _doctor(spark: SparkSession, path: str | list[str], scanned: DataFrame) -> DataFrame:
    per_column = F.concat_ws(": ", "file", "column")
    group = F.concat_ws("#", "path", F.col("row_group").cast("string"))
    column = F.col("column")
    found = {
        "integrity": (file_integrity(spark, path, scanned=scanned), "error", F.col("path")),
        "schema": (schema_validation(spark, path, scanned), "warning", per_column),
        "numbers_and_times": (decimal_timestamp_diagnostics(spark, path, scanned), "warning", per_column),
        "row_groups": (row_groups(spark, path, scanned), "warning", group),
        "statistics": (column_statistics(spark, path, scanned), "warning", column),
        "compression": (compression_encoding(spark, path, scanned), "warning", column),
    }
    checks = {name: _as_issues(rows, level, name, subject) for name, (rows, level, subject) in found.items()}
    try:
        paths = [path] if isinstance(path, str) else path
        reader = spark.read.options(ignoreCorruptFiles=True, recursiveFileLookup=True, mergeSchema=True)
        table = load_paths(reader.format("parquet").option("pathGlobFilter", any_case("parquet")), paths)
        checks |= _quality_issues(table)
        checks["rows_read"] = _as_issues(rows_read(table, scanned), "error", "rows_read", F.col("path"))
    except PySparkException:  # no file can be read, or their columns contradict each other
        unread = spark.createDataFrame([(["not_scanned"],)], "issues array<string>")
        checks["data_quality"] = _as_issues(unread, "warning", "data_quality", F.lit("table"))
    return _report(checks)


def health(issues: DataFrame) -> DataFrame:
    """``health_score, errors, warnings, passed``; only errors lower the score."""
    counted = issues.agg(*[F.count_if(F.col("level") == k).alias(v) for k, v in (("error", "errors"), ("warning", "warnings"), ("pass", "passed"))])
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - PENALTY * F.col("errors"))).cast("long")
    return counted.select(score.alias("health_score"), "errors", "warnings", "passed")


def recommendations(issues: DataFrame) -> DataFrame:
    """Each piece of advice once."""
    return issues.filter("recommendation IS NOT NULL").select("recommendation").distinct()
