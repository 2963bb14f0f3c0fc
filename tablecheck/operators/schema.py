"""Schema views, search, documentation and drift."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..functions import types as ty
from ..plans.files import COLUMN_STRUCT, footers
from ..plans.shipping import ship_package
from ..plans.small import small_frame
from ..plans.storage import checkpointed

# Least likeness of names for a rename, its rounding; documentation columns.
RENAME_LIKENESS = 0.62
LIKENESS_DIGITS = 3
DOC_COLUMNS = (
    "Path",
    "Physical Type",
    "Logical Type",
    "Nullable",
    "Repetition Level",
    "Definition Level",
    "Decimal",
    "Timestamp",
)
SEARCHED = ("name", "path", "physical_type", "logical_type", "converted_type", "nullable_status", "repetition_type")

TREE_SCHEMA = COLUMN_STRUCT + ", num_children int"
DRIFT_SCHEMA = (
    "change string, column string, other_column string, current_signature string, "
    "reference_signature string, similarity double"
)


def schema_columns(df: DataFrame) -> DataFrame:
    """Every field of the schema, nested ones too, depth first; metadata only."""
    rows: list[tuple] = []
    for field in df.schema.fields:
        _walk(field.name, field.dataType, field.nullable, [], 0, 0, rows)
    return small_frame(df.sparkSession, rows, TREE_SCHEMA)


def _walk(name: str, dtype: T.DataType, nullable: bool, parents: list[str], repetition: int, definition: int, rows: list) -> None:
    if isinstance(dtype, T.StructType):
        children = [(f.name, f.dataType, f.nullable) for f in dtype.fields]
    elif isinstance(dtype, T.ArrayType):
        children = [("element", dtype.elementType, dtype.containsNull)]
    elif isinstance(dtype, T.MapType):
        children = [("key", dtype.keyType, False), ("value", dtype.valueType, dtype.valueContainsNull)]
    else:
        children = []
    repeated = isinstance(dtype, (T.ArrayType, T.MapType))
    definition += int(nullable)
    decimal = isinstance(dtype, T.DecimalType)
    zoned = {T.TimestampType: True, T.TimestampNTZType: False}.get(type(dtype))
    rows.append(
        (
            ".".join([*parents, name]),
            name,
            ".".join(parents) or None,
            len(parents) + 1,
            dtype.simpleString(),
            dtype.simpleString(),
            None,
            "nullable" if nullable else "required",
            repetition,
            definition,
            dtype.precision if decimal else None,
            dtype.scale if decimal else None,
            None if zoned is None else "MICROS",
            zoned,
            ty.signature(dtype),
            len(children),
        )
    )
    for child, child_type, child_nullable in children:
        _walk(child, child_type, child_nullable, [*parents, name], repetition + repeated, definition + repeated, rows)


def parquet_schema(spark: SparkSession, path: str | list[str], scanned: DataFrame | None = None) -> DataFrame:
    """Leaf columns of each Parquet file as its footer states them."""
    rows = scanned if scanned is not None else footers(spark, path)
    return rows.filter("columns IS NOT NULL").select(F.col("path").alias("file"), F.inline("columns"))


def search_columns(columns: DataFrame, text: str) -> DataFrame:
    """Rows of a schema view whose names or types contain the text, whatever the case."""
    wanted = text.strip().lower()
    fields = [F.coalesce(F.col(c), F.lit("-")) for c in SEARCHED if c in columns.columns]
    return columns.filter(F.lower(F.concat_ws("\n", *fields)).contains(wanted)) if wanted else columns


def nested_field_count(columns: DataFrame) -> DataFrame:
    """One row ``nested_fields``: groups of ``schema_columns`` that have children."""
    return columns.agg(F.count_if(F.col("num_children") > 0).alias("nested_fields"))


def _cell(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit("-"))
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"\r?\n", " ")


def schema_markdown(columns: DataFrame) -> DataFrame:
    """``path, line``: one Markdown table row per column; ``DOC_COLUMNS`` is the heading."""
    decimal = F.when(
        F.col("decimal_precision").isNotNull(),
        F.concat(F.lit("precision "), "decimal_precision", F.lit(", scale "), F.coalesce(F.col("decimal_scale").cast("string"), F.lit("-"))),
    )
    zone = F.when(F.col("is_adjusted_to_utc"), "UTC").when(~F.col("is_adjusted_to_utc"), "local").otherwise("-")
    stamp = F.when(F.col("timestamp_unit").isNotNull(), F.concat("timestamp_unit", F.lit(" / "), zone))
    cells = [F.col(c) for c in ("path", "physical_type", "logical_type", "nullable_status", "repetition_level", "definition_level")]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[_cell(c) for c in [*cells, decimal, stamp]]), F.lit(" |"))
    return columns.select("path", line.alias("line"))


def schema_document(df: DataFrame, title: str = "Table") -> str:
    """Markdown text for one table's schema (as many lines as it has columns)."""
    columns = schema_columns(df)
    lines = [row.line for row in schema_markdown(columns).collect()]
    heading = "| " + " | ".join(DOC_COLUMNS) + " |"
    rule = "|" + " --- |" * len(DOC_COLUMNS)
    return "\n".join([f"# {title} schema", "", f"Columns: {len(lines)}", "", heading, rule, *lines])


def schema_json(columns: DataFrame) -> DataFrame:
    """``path, json``: one JSON object per column."""
    return columns.select("path", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def drift(current: Iterable[tuple[str, str]], reference: Iterable[tuple[str, str]]) -> list[tuple]:
    """Drift rows of two lists of (column, signature); runs on metadata only."""
    now, then = dict(current), dict(reference)
    added, removed = sorted(now.keys() - then.keys()), sorted(then.keys() - now.keys())
    rows = [("added", c, None, now[c], None, None) for c in added]
    rows += [("removed", c, None, None, then[c], None) for c in removed]
    rows += [("type_changed", c, None, now[c], then[c], None) for c in sorted(now.keys() & then.keys()) if now[c] != then[c]]
    for old in removed:
        for new in added:
            alike = names.likeness(old.lower(), new.lower())
            if now[new] == then[old] and alike >= RENAME_LIKENESS:
                rows.append(("rename_candidate", new, old, now[new], then[old], round(alike, LIKENESS_DIGITS)))
    return rows


def _leaves(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, ty.signature(f.dataType)) for f in df.schema.fields]


def schema_drift(current: DataFrame, reference: DataFrame) -> DataFrame:
    """Added, removed and type-changed columns, and pairs that look renamed."""
    return small_frame(current.sparkSession, drift(_leaves(current), _leaves(reference)), DRIFT_SCHEMA)


def drift_summary(current: DataFrame, reference: DataFrame) -> DataFrame:
    rows = drift(_leaves(current), _leaves(reference))
    count = {kind: sum(r[0] == kind for r in rows) for kind in ("added", "removed", "type_changed", "rename_candidate")}
    return small_frame(current.sparkSession, [(len(current.columns), len(reference.columns), *count.values())],
        "current_columns bigint, reference_columns bigint, added bigint, removed bigint, type_changed bigint, rename_candidates bigint",
    )


def schema_drift_dataset(spark: SparkSession, path: str | list[str], reference: str) -> DataFrame:
    """Drift of every Parquet file below ``path`` against one reference file.

    Files are reduced to their distinct schemas before names are compared, so
    the work grows with the number of schemas, not of files.
    """
    ship_package(spark)
    known = parquet_schema(spark, reference).select("path", "type_signature").collect()
    then = [(r.path, r.type_signature) for r in known]
    files = footers(spark, path).filter("columns IS NOT NULL")
    listed = files.select("path", F.transform("columns", lambda c: F.struct(c["path"], c["type_signature"])).alias("now"))
    listed = checkpointed(listed.withColumn("schema_key", F.sha2(F.to_json("now"), 256)))
    distinct = listed.groupBy("schema_key").agg(F.first("now").alias("now"))

    @F.pandas_udf(f"array<struct<{DRIFT_SCHEMA}>>")
    def compare(schemas: pd.Series) -> pd.Series:
        fields = ("change", "column", "other_column", "current_signature", "reference_signature", "similarity")
        return schemas.map(lambda s: [dict(zip(fields, r)) for r in drift([tuple(c.values()) for c in s], then)])

    changes = distinct.select("schema_key", F.explode(compare("now")).alias("d"))
    return listed.select(F.col("path").alias("file"), "schema_key").join(changes, "schema_key").select("file", "d.*")
