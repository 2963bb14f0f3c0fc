"""Data behind bar, line, scatter and histogram charts, from the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, values

# Points or bins where none are asked for.
USUAL_POINTS = 25
NO_LABEL = "-"


def _points(limit: int | None) -> int:
    if limit is not None and limit < 1:
        raise ValueError("A chart has one point at least.")
    return limit or USUAL_POINTS


def _number(df: DataFrame, name: str) -> Column:
    return values.number_of(names.col(name), df.schema[name].dataType)


def _grouped(df: DataFrame, x: str, y: str | None, agg: str) -> DataFrame:
    text = values.as_text(names.col(x), df.schema[x].dataType)
    labelled = F.when(values.present(text), text).otherwise(F.lit(NO_LABEL)).alias("label")
    if agg == "count":
        return df.select(labelled).groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("value"))
    if agg not in ("sum", "avg", "min", "max"):
        raise ValueError(f"Unknown chart aggregate {agg!r}.")
    if not y:
        raise ValueError("This aggregate needs a numeric column for the y axis.")
    usable = df.select(labelled, _number(df, y).alias("y")).filter("y IS NOT NULL")
    return usable.groupBy("label").agg(getattr(F, agg)("y").alias("value"))


def bar_data(df: DataFrame, x: str, y: str | None = None, agg: str = "count", limit: int | None = None) -> DataFrame:
    """``label, value`` of the largest bars by absolute value."""
    return _grouped(df, x, y, agg).orderBy(F.abs("value").desc(), "label").limit(_points(limit))


def line_data(df: DataFrame, x: str, y: str | None = None, agg: str = "count", limit: int | None = None) -> DataFrame:
    """``label, value`` along the x axis: numbers, then dates, then other labels."""
    number, moment = values.as_number(F.col("label")), values.as_moment(F.col("label"))
    order = [number.asc_nulls_last(), moment.asc_nulls_last(), F.col("label").asc()]
    return _grouped(df, x, y, agg).orderBy(*order).limit(_points(limit))


def scatter_data(df: DataFrame, x: str, y: str, limit: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    """``x, y`` of the first rows in a stated order where both are numbers."""
    dots = _points(limit)
    order = [names.col(c).asc_nulls_last() for c in order_by or []]
    px, py = _number(df, x).alias("x"), _number(df, y).alias("y")
    both = df.select("*", px, py).filter("x IS NOT NULL AND y IS NOT NULL") if not {"x", "y"} & set(df.columns) else None
    if both is None:
        renamed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        at = {c: f"c{i}" for i, c in enumerate(df.columns)}
        return scatter_data(renamed, at[x], at[y], limit, [at[c] for c in order_by or []])
    return both.orderBy(*order, F.col("x"), F.col("y")).limit(dots).select("x", "y")


def histogram(df: DataFrame, x: str, limit: int | None = None) -> DataFrame:
    """``bin, bin_start, bin_end, count``: bins of equal width over min..max.

    The last bin is closed; a constant column falls into bin 0 of width 1;
    empty bins are kept. The bounds are a scalar subquery, so the table is
    read twice and only bin counts are shuffled.
    """
    bins = _points(limit)
    numbers = df.select(_number(df, x).alias("v")).filter("v IS NOT NULL")
    ends = numbers.agg(F.struct(F.min("v").alias("low"), F.max("v").alias("high")).alias("ends")).scalar()
    low, high = F.col("ends.low"), F.col("ends.high")
    width = F.when(high == low, F.lit(1.0)).otherwise((high - low) / bins)
    place = F.when(high == low, F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("v") - low) / width)))
    placed = numbers.select("v", ends.alias("ends")).select(place.cast("int").alias("bin"))
    counted = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), ends.alias("ends"))
    # As many rows on either side as there are bins.
    filled = frame.join(F.broadcast(counted), "bin", "left")
    start, end = low + F.col("bin") * width, low + (F.col("bin") + 1) * width
    return filled.select("bin", start.alias("bin_start"), end.alias("bin_end"), F.coalesce("count", F.lit(0)).alias("count"))
