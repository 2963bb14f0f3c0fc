"""Many metrics of many columns in one pass."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names, values
from .small import small_frame
from .spreading import is_scan, is_small, spread

# Beyond this many aggregates in one plan node the generated code outgrows the JVM limits.
AGGREGATES_PER_PASS = 400
# Columns stacked into (column, value) pairs by one plan node; each pass reads its columns only.
COLUMNS_PER_PASS = 200
# Passes over a large table. A task holds the distinct values of the columns of its pass, which may be as many as its rows.
PASSES = 16

Metrics = dict[str, Column]


def column_metrics(
    df: DataFrame,
    metrics_of: Callable[[str, T.DataType], Metrics],
    schema: dict[str, str],
    columns: list[str] | None = None,
) -> DataFrame:
    """One row per column: ``pos, column, <metrics>``.

    ``metrics_of(name, type)`` gives the aggregates of a column; metrics of
    ``schema`` it leaves out become null. All columns share one aggregate, so
    the table is read once and one row per task is shuffled; very wide tables
    are split into several such passes.
    """
    wanted = [
        (pos, field.name, metrics_of(field.name, field.dataType))
        for pos, field in enumerate(df.schema.fields)
        if columns is None or field.name in columns
    ]
    per_pass = max(1, AGGREGATES_PER_PASS // max(1, len(schema)))
    passes = [wanted[i : i + per_pass] for i in range(0, len(wanted), per_pass)]
    if not passes:
        empty = ", ".join(f"{names.quoted(k)} {v}" for k, v in schema.items())
        return small_frame(df.sparkSession, [], f"pos int, `column` string, {empty}")
    return reduce(DataFrame.unionByName, [_one_pass(df, part, schema) for part in passes])


def _one_pass(df: DataFrame, wanted: list[tuple[int, str, Metrics]], schema: dict[str, str]) -> DataFrame:
    aggregates, rows = [F.count(F.lit(1)).alias("n_rows")], []
    for pos, name, metrics in wanted:
        fields = [F.lit(pos).alias("pos"), F.lit(name).alias("column")]
        for metric, dtype in schema.items():
            if metric in metrics:
                slot = f"c{pos}_{metric}"
                aggregates.append(metrics[metric].cast(dtype).alias(slot))
                fields.append(F.col(slot).alias(metric))
            else:
                fields.append(F.lit(None).cast(dtype).alias(metric))
        rows.append(F.struct(*fields))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def passes_over(df: DataFrame, fields: list[tuple[int, T.StructField]]) -> list[list[tuple[int, T.StructField]]]:
    """The columns whose values are counted together: many of a small table, one or a few of a large one, as each pass reads its columns only.

    What a join or another costly step gives is not worked out again for each pass; store it first if it is large.
    """
    most = COLUMNS_PER_PASS if is_small(df) or not is_scan(df) else min(COLUMNS_PER_PASS, max(1, math.ceil(len(fields) / PASSES)))
    return [fields[i : i + most] for i in range(0, len(fields), most)]


def value_counts(df: DataFrame, labelled: bool = False, fields: list[tuple[int, T.StructField]] | None = None) -> DataFrame:
    """``pos, key[, label], n`` for every distinct text value of every column, or of the given ones.

    ``pos`` is the place of the column in the schema. Missing values (null or
    empty) have a null key. Map-side combining keeps a value that fills a
    third of the table to one row per task; long texts travel as their
    digest, if ``labelled`` with the value cut for display beside it.
    """
    fields = list(enumerate(df.schema.fields)) if fields is None else fields
    return reduce(DataFrame.unionByName, [_value_counts(df, part, labelled) for part in passes_over(df, fields)])


def _value_counts(df: DataFrame, fields: list[tuple[int, T.StructField]], labelled: bool) -> DataFrame:
    texts = [values.as_text(names.col(f.name), f.dataType).alias(f"v{i}") for i, f in fields]
    pairs = ", ".join(f"{i}, v{i}" for i, _ in fields)
    long = spread(df).select(*texts).selectExpr(f"stack({len(fields)}, {pairs}) as (pos, v)")
    v = F.when(F.col("v") != "", F.col("v"))
    keys = [F.col("pos"), values.compact(v).alias("key")]
    if not labelled:
        return long.select(*keys).groupBy("pos", "key").agg(F.count(F.lit(1)).alias("n"))
    # A short text is its own label; only a digest needs one beside it.
    cut = F.when(values.is_long(v), label(v)).alias("cut")
    counted = long.select(*keys, cut).groupBy("pos", "key", "cut").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("pos", "key", F.coalesce("cut", label(F.col("key"))).alias("label"), "n")


def column_names(df: DataFrame) -> DataFrame:
    """``pos, column``: one row per column of the schema."""
    return small_frame(df.sparkSession, list(enumerate(df.columns)), "pos int, `column` string")


def label(text: Column, width: int = 24) -> Column:
    """Text cut for display."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("..."))).otherwise(text)


def distinct_rows(df: DataFrame, keys: list[Column]) -> DataFrame:
    """One row: ``total_rows, distinct_rows`` over the given key columns."""
    return (
        df.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_rows"),
            F.count(F.lit(1)).cast("long").alias("distinct_rows"),
        )
    )
