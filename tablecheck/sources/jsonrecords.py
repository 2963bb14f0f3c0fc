"""Choosing records inside JSON documents and flattening them into columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from .options import record_path

ALONE = "value"


def _step(value: Column, dtype: T.DataType, part: str) -> tuple[Column, T.DataType] | None:
    if isinstance(dtype, T.StructType):
        if part not in dtype.names:
            return None
        return value.getField(part), dtype[part].dataType
    if isinstance(dtype, T.ArrayType) and part.isdigit():
        return F.get(value, F.lit(int(part))), dtype.elementType
    if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
        return F.try_element_at(value, F.lit(part)), dtype.valueType
    return None


def select_records(df: DataFrame, path: str) -> DataFrame:
    """Records at a dotted path (keys and list positions) of each row, lazily.

    A list gives a row per element; a missing or null value gives none;
    elements that are not objects come as a column ``value``.
    """
    parts = [p for p in record_path(path).split(".") if p]
    if not parts:
        return df
    value, dtype = F.struct(*[names.col(c) for c in df.columns]), df.schema
    for part in parts:
        found = _step(value, dtype, part)
        if found is None:
            raise ValueError(f"No record has {part!r} on the path {path!r}.")
        value, dtype = found
    is_list = isinstance(dtype, T.ArrayType)
    rows = df.select((F.explode(value) if is_list else value).alias(ALONE))
    if not is_list:
        rows = rows.filter(F.col(ALONE).isNotNull())
    record = dtype.elementType if is_list else dtype
    return rows.select(F.col(ALONE + ".*")) if isinstance(record, T.StructType) else rows


def require_records(df: DataFrame, path: str) -> DataFrame:
    """As ``select_records``, but an error when no record is found at all."""
    rows = select_records(df, path)
    if rows.isEmpty():
        raise ValueError(f"No records at {path!r}.")
    return rows


def json_record_path(df: DataFrame, json_col: str, path: str, keep: list[str] | None = None) -> DataFrame:
    """Records at a path of a JSON text column: ``<keep>, pos, value`` (a variant).

    For documents whose shapes differ: no common schema is needed. ``pos`` is
    the place in the list, 0 for a single value.
    """
    kept = [names.col(c) for c in keep or []]
    parts = [p for p in record_path(path).split(".") if p]
    parsed = df.select(*kept, F.try_parse_json(names.col(json_col)).alias("__doc"))
    value = F.col("__doc")
    for part in parts:
        escaped = part.replace("\\", "\\\\").replace("'", "\\'")
        inside = F.try_variant_get(value, f"$['{escaped}']", "variant")
        if part.isdigit():
            inside = F.coalesce(F.try_variant_get(value, f"$[{part}]", "variant"), inside)
        value = inside
    found = parsed.select(*kept, value.alias("__at")).filter("__at IS NOT NULL AND NOT is_variant_null(__at)")
    items = F.col("__at").try_cast("array<variant>")
    return found.select(*kept, F.posexplode(F.coalesce(items, F.array("__at"))).alias("pos", "value"))


def flatten_json(df: DataFrame) -> DataFrame:
    """Nested objects as dotted columns, lists as JSON text, empty objects as null."""
    columns = []

    def walk(value: Column, dtype: T.DataType, name: str) -> None:
        if isinstance(dtype, T.StructType) and dtype.fields:
            for field in dtype.fields:
                walk(value.getField(field.name), field.dataType, f"{name}.{field.name}")
        elif isinstance(dtype, T.StructType):
            columns.append(F.lit(None).cast("string").alias(name))
        elif isinstance(dtype, (T.ArrayType, T.MapType, T.VariantType)):
            columns.append(F.to_json(value).alias(name))
        else:
            columns.append(value.alias(name))

    for field in df.schema.fields:
        walk(names.col(field.name), field.dataType, field.name)
    return df.select(*columns)
