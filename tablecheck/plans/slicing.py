"""Cutting a number line into slices that hold about equally many rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names


def number_line(df: DataFrame, column: str) -> Column:
    """A numeric, date or timestamp column as double."""
    kind = df.schema[column].dataType.typeName()
    value = names.col(column)
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    return value.cast("double")


def cut_points(df: DataFrame, value: Column, slices: int) -> list[float]:
    """At most ``slices - 1`` approximate quantiles, from mergeable sketches."""
    wanted = [i / slices for i in range(1, slices)]
    if not wanted:
        return []
    return sorted(set(df.select(value.alias("v")).approxQuantile("v", wanted, 0.25 / slices)))


def slice_number(value: Column, cuts: list[float]) -> Column:
    """How many cut points are below the value; 0 for null.

    Looked up in two steps (block, then place in the block), so a row meets
    about ``2 * sqrt(n)`` of the n points. Built without lambda functions,
    over which the optimizer of Spark 4.1 can trip when unions follow.
    """
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts) - 1) + 1
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]

    def below(points: Column) -> Column:
        return F.array_position(F.sort_array(F.array_append(points, value)), value).cast("int") - 1

    block = F.coalesce(below(_doubles([b[0] for b in blocks])), F.lit(0))
    inside = below(F.element_at(F.array(*[_doubles(b) for b in blocks]), F.greatest(block, F.lit(1))))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + inside)


def _doubles(points: list[float]) -> Column:
    return F.array(*[F.lit(float(p)) for p in points])
