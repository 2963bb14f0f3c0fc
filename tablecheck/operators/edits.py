"""Applying a table of edits as a new copy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..functions import types as ty

# Kinds of edits, the word that sets a cell to null.
UPDATE, INSERT, DELETE = "update", "insert", "delete"
NULL_WORD = "null"


def parse_edit(text: Column, dtype: T.DataType) -> Column:
    """Cell text as a value of the column's type; null if it does not fit."""
    trimmed = F.trim(text)
    if ty.is_text(dtype):
        value = text
    elif isinstance(dtype, T.BooleanType):
        value = F.when(F.lower(trimmed).isin("true", "false"), F.lower(trimmed) == "true")
    elif isinstance(dtype, T.VariantType):
        value = F.try_parse_json(trimmed)
    elif ty.is_nested(dtype):
        value = F.from_json(trimmed, dtype)
    else:
        value = trimmed.try_cast(dtype)
    return F.when(_is_null(text), F.lit(None).cast(dtype)).otherwise(value)


def _is_null(text: Column) -> Column:
    return text.isNull() | (F.lower(F.trim(text)) == NULL_WORD)


def judged_edits(df: DataFrame, edits: DataFrame) -> DataFrame:
    """The edits with a ``reason`` column: why an edit cannot be applied, or null."""
    unfit = F.lit(False)
    for f in df.schema.fields:
        wrong = (F.col("column") == f.name) & ~_is_null(F.col("value")) & parse_edit(F.col("value"), f.dataType).isNull()
        unfit = unfit | F.coalesce(wrong, F.lit(False))
    setting = F.col("op").isin(UPDATE, INSERT)
    reason = (
        F.when(~F.coalesce(F.col("op").isin(UPDATE, INSERT, DELETE), F.lit(False)), "unknown_operation")
        .when(setting & ~F.coalesce(F.col("column").isin(*df.columns), F.lit(False)), "unknown_column")
        .when(setting & unfit, "value_does_not_fit")
    )
    return edits.withColumn("reason", reason)


@dataclass(frozen=True)
class Edited:
    rows: DataFrame
    rejects: DataFrame


def _by_key(df: DataFrame, edits: DataFrame, op: str) -> DataFrame:
    """One row per edited key: for each column whether it is set, and to what.

    Of several edits of one cell the last in ``seq`` counts, else the greatest text.
    """
    order = F.struct(*([F.col("seq")] if "seq" in edits.columns else []), F.coalesce(F.col("value"), F.lit("")))
    cells = []
    for i, f in enumerate(df.schema.fields):
        here = F.col("column") == f.name
        cells.append(F.max_by(F.struct(F.col("value")), F.when(here, order)).alias(f"s{i}"))
    return edits.filter(F.col("op") == op).groupBy(F.col("key").alias("__edited")).agg(*cells)


def apply_edits(df: DataFrame, edits: DataFrame, key: str) -> Edited:
    """Copy of ``df`` with updates, inserts and deletes of ``edits`` applied.

    ``edits`` has ``op, key, column, value`` (all text) and optionally ``seq``.
    Unset cells of an inserted row are null; a cell can be set to null.
    Edits that do not fit go to ``rejects`` and change nothing. A key repeated
    in ``df`` is edited in every row; such a hot key can be split by AQE,
    since the edited side has one row per key.
    """
    judged = judged_edits(df, edits)
    good, rejects = judged.filter("reason IS NULL"), judged.filter("reason IS NOT NULL")
    fields = df.schema.fields
    key_text = names.col(key).cast("string")
    updates = _by_key(df, good, UPDATE)
    deletes = good.filter(F.col("op") == DELETE).select(F.col("key").alias("__gone")).distinct()
    # A row with a null key cannot be named by an edit.
    kept = df.withColumn("__key", key_text).join(deletes, F.col("__key") == F.col("__gone"), "left_anti")
    changed = kept.join(updates, F.col("__key") == F.col("__edited"), "left").select(
        *[
            F.when(F.col(f"s{i}").isNotNull(), parse_edit(F.col(f"s{i}.value"), f.dataType))
            .otherwise(names.col(f.name))
            .alias(f.name)
            for i, f in enumerate(fields)
        ]
    )
    added = _by_key(df, good, INSERT).select(
        *[
            (
                F.coalesce(parse_edit(F.col(f"s{i}.value"), f.dataType), F.col("__edited").try_cast(f.dataType))
                if f.name == key
                else parse_edit(F.col(f"s{i}.value"), f.dataType)
            ).alias(f.name)
            for i, f in enumerate(fields)
        ]
    )
    return Edited(changed.unionByName(added), rejects)


def rename_columns(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Columns under new names: trimmed, not blank, different also when case is ignored."""
    unknown = [c for c in renames if c not in df.columns]
    if unknown:
        raise ValueError(f"There is no column {unknown[0]!r}.")
    wanted = [str(renames.get(c, c)).strip() for c in df.columns]
    for pos, name in enumerate(wanted, 1):
        if not name:
            raise ValueError(f"Column {pos} has a blank name.")
    lowered = [n.lower() for n in wanted]
    for name in wanted:
        if lowered.count(name.lower()) > 1:
            raise ValueError(f"Column name {name!r} is used twice.")
    return df.toDF(*wanted)


def edit_summary(df: DataFrame, edits: DataFrame, key: str, renamed: int = 0) -> DataFrame:
    """``renamed_columns, changed_cells, row_delta, changes``.

    ``changes`` counts renames, cells that take another value, and every cell
    of the rows gained or lost.
    """
    fields = df.schema.fields
    good = judged_edits(df, edits).filter("reason IS NULL")
    updates = _by_key(df, good, UPDATE)
    deletes = good.filter(F.col("op") == DELETE).select(F.col("key").alias("__gone")).distinct()
    rows = df.withColumn("__key", names.col(key).cast("string"))
    gone = rows.join(deletes, F.col("__key") == F.col("__gone"), "left_semi").agg(F.count(F.lit(1)).alias("n")).scalar()
    new = good.filter(F.col("op") == INSERT).agg(F.count_distinct("key").alias("n")).scalar()
    kept = rows.join(deletes, F.col("__key") == F.col("__gone"), "left_anti").join(updates, F.col("__key") == F.col("__edited"))
    cells = F.lit(0)
    for i, f in enumerate(fields):
        value = parse_edit(F.col(f"s{i}.value"), f.dataType)
        differs = F.col(f"s{i}").isNotNull() & ~value.eqNullSafe(names.col(f.name)) if ty.can_be_grouped(f.dataType) else F.col(f"s{i}").isNotNull()
        cells = cells + F.when(differs, 1).otherwise(0)
    counted = kept.agg(F.coalesce(F.sum(cells), F.lit(0)).cast("long").alias("changed_cells"))
    delta = new - gone
    return counted.select(
        F.lit(renamed).cast("long").alias("renamed_columns"),
        "changed_cells",
        delta.alias("row_delta"),
        (F.lit(renamed) + F.col("changed_cells") + F.abs(delta) * max(len(fields), 1)).cast("long").alias("changes"),
    )
