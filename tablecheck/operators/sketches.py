"""Distinct counts and quantiles from mergeable sketches, kept for each file and put together at will.

A file is read once. Its sketches, a few kilobytes per column, are rows of a table that can be stored; reports on any choice of files, and on files added
later, merge these rows and read no data. Distinct counts are HyperLogLog, quantiles KLL; both merge without loss against one sketch of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names, values
from ..functions import types as ty
from ..plans.files import path_of_uri

#: Registers of a distinct sketch, as a power of two: a standard deviation of 1.04 / sqrt(2 ** LG_REGISTERS), 1.6 per cent.
LG_REGISTERS = 12
DISTINCT_ERROR = 1.04 / 2 ** (LG_REGISTERS / 2)
#: Size of a quantile sketch; ranks are off by RANK_ERROR at most with a probability of 99 per cent.
QUANTILE_SIZE = 800
RANK_ERROR = 0.005
# Columns sketched by one aggregate.
COLUMNS_PER_PASS = 50


def _number(value: Column, dtype: T.DataType) -> Column:
    """What quantiles are taken of: numbers, and dates and times as microseconds; text is not tested for numbers."""
    if ty.is_numeric(dtype):
        return values.number_of(value, dtype)
    if isinstance(dtype, T.DateType):
        return F.unix_date(value).cast("double") * 86_400_000_000
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value).cast("double")
    return F.lit(None).cast("double")


def _distinct_key(value: Column, dtype: T.DataType) -> Column:
    """A value of a type that the distinct sketch takes; equal for equal values."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType)):
        return value
    return values.as_text(value, dtype)


def sketch_files(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``file, column, row_count, filled_count, distincts, quantiles``: a row per file and column of a table read from files.

    One pass: sketches are built in the tasks that read, and a file that is
    split is put together from its parts. ``quantiles`` is null where a column
    has no numbers.
    """
    return sketch_groups(df.withColumn("__file", path_of_uri(F.col("_metadata.file_path"))), "__file", columns or df.columns).withColumnRenamed("__file", "file")


def sketch_groups(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """The same for each value of a column."""
    fields = [df.schema[c] for c in columns]
    found = None
    for first in range(0, len(fields), COLUMNS_PER_PASS):
        part = _sketched(df, group, fields[first : first + COLUMNS_PER_PASS])
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("Choose at least one column.")
    return found


def _sketched(df: DataFrame, group: str, fields: list[T.StructField]) -> DataFrame:
    wanted, rows = [F.count(F.lit(1)).alias("n")], []
    for i, f in enumerate(fields):
        value = names.col(f.name)
        filled = F.when(values.present(value), value) if ty.is_text(f.dataType) else value
        wanted.append(F.count(filled).alias(f"c{i}"))
        wanted.append(F.hll_sketch_agg(_distinct_key(filled, f.dataType), LG_REGISTERS).alias(f"h{i}"))
        numeric = ty.is_numeric(f.dataType) or isinstance(f.dataType, (T.DateType, T.TimestampType))
        if numeric:
            wanted.append(F.kll_sketch_agg_double(_number(value, f.dataType), QUANTILE_SIZE).alias(f"k{i}"))
        quantiles = F.col(f"k{i}") if numeric else F.lit(None).cast("binary")
        item = [F.lit(f.name).alias("column"), F.col("n").alias("row_count"), F.col(f"c{i}").alias("filled_count"), F.col(f"h{i}").alias("distincts"), quantiles.alias("quantiles")]
        rows.append(F.struct(*item))
    return df.groupBy(names.col(group)).agg(*wanted).select(names.col(group), F.inline(F.array(*rows)))


def merge_sketches(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sketches of the rows put together: by column, or by the given columns and it."""
    return sketches.groupBy(*[names.col(c) for c in by or []], "column").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("filled_count").alias("filled_count"),
        F.hll_union_agg("distincts").alias("distincts"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )


def estimates(merged: DataFrame, ranks: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """``..., distinct_estimate, quantile_estimates`` in the place of the sketches."""
    some = F.col("quantiles").isNotNull() & (F.expr("kll_sketch_get_n_double(quantiles)") > 0)
    kept = [c for c in merged.columns if c not in ("distincts", "quantiles")]
    found = F.kll_sketch_get_quantile_double("quantiles", F.array(*[F.lit(float(r)) for r in ranks]))
    # Where nothing is filled there is nothing to estimate, and no more values than rows can differ.
    distinct = F.least(F.hll_sketch_estimate("distincts"), F.col("filled_count"))
    return merged.select(*kept, distinct.alias("distinct_estimate"), F.when(some, found).alias("quantile_estimates"))
