"""As-of join and range join: SQL users have them, Spark SQL does not (or only as a nested loop)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..plans.slicing import cut_points, number_line, slice_number
from ..plans.storage import shuffle_partitions, stored


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, left_by: str, right_by: str, how: str = "inner") -> DataFrame:
    """Each left row with the latest right row of the same key at or before it.

    Right columns must not share names with left ones. Of right rows with the
    same key and time the greatest row counts.

    Both sides are ranged together by (key, time), in one shuffle, so a key or
    a single time that holds a large part of all rows is cut like any other
    stretch. Within a partition the last right row of the key goes down to the
    left rows after it. What a partition ends with, one row, is handed to
    those that begin with the same key: a table of a row per partition, which
    is broadcast.
    """
    if how not in ("inner", "left"):
        raise ValueError("An as-of join is 'inner' or 'left'.")
    columns, spark = left.columns, left.sparkSession
    # The time leads, so the greatest of several rows is the latest one.
    row = F.struct(names.col(right_on), *[names.col(c) for c in right.columns if c != right_on])
    here = names.col(left_by).isNotNull() & names.col(left_on).isNotNull()
    asked = left.filter(here).select(names.col(left_by).alias("by"), names.col(left_on).alias("at"), F.lit(2).alias("turn"), F.struct(*[names.col(c) for c in columns]).alias("l"))
    known = right.filter(names.col(right_by).isNotNull() & names.col(right_on).isNotNull())
    known = known.select(names.col(right_by).alias("by"), names.col(right_on).alias("at"), F.lit(1).alias("turn"), row.alias("r"))
    # Copies are told apart by their place in the input, so that they can be cut.
    tagged = asked.unionByName(known, allowMissingColumns=True).withColumn("copy", F.monotonically_increasing_id())
    order = ["by", "at", "turn", "r", "copy"]
    ranged = tagged.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    ranged = ranged.select(_comparable(ranged.schema["by"].dataType).alias("by"), "turn", "l", "r")
    kinds = T.StructType([*ranged.schema.fields, T.StructField("part", T.IntegerType())])
    filled = stored(ranged.mapInArrow(_fill_down, kinds))

    ends = filled.filter("turn = 0").select("part", "by", "r")
    earlier = Window.partitionBy("by").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ended = ends.withColumn("c", F.last("r", ignorenulls=True).over(earlier)).select(F.col("by").alias("b"), "part", "c", F.col("r").alias("e"))
    # A partition begins where the one before it ended: with its key and the last right row of it.
    handed = ended.select(F.col("b"), F.lead("part").over(Window.orderBy("part")).alias("p"), F.coalesce("e", "c").alias("c")).filter("p IS NOT NULL AND c IS NOT NULL")
    rows = filled.filter("turn = 2").join(F.broadcast(handed), (F.col("part") == F.col("p")) & (F.col("by") == F.col("b")) & F.col("r").isNull(), "left")
    found = F.coalesce("r", "c")
    chosen = [F.col("l").getField(c).alias(c) for c in columns]
    matched = rows.filter(found.isNotNull()) if how == "inner" else rows
    joined = matched.select(*chosen, *[found.getField(c).alias(c) for c in right.columns])
    if how == "inner":
        return joined
    nothing = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in right.columns]
    return joined.unionByName(left.filter(~here).select(*[names.col(c) for c in columns], *nothing))


def _comparable(kind: T.DataType) -> Column:
    """Keys as values that Arrow compares like Spark: fractions and nested ones as text, in which NaN equals itself and zero has no sign."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (F.col("by") + F.lit(0.0)).cast("string")
    return F.to_json(F.struct("by")) if isinstance(kind, (T.StructType, T.ArrayType)) else F.col("by")


def _fill_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Left rows (turn 2) with the last right row (turn 1) of their key in this partition; and one row (turn 0) of the key and right row at its end."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, target = None, None  # one row: key and right row; the schema of all that is given back
    for batch in batches:
        if target is None:
            target = pa.schema([*[pa.field(f.name, f.type) for f in batch.schema], pa.field("part", pa.int32())])
        if not batch.num_rows:
            continue
        # Batches say of some columns that they are never null, the row that goes on does not: the types are the same.
        rows = pa.Table.from_arrays(batch.columns, schema=pa.schema(list(target)[:-1]))
        rows = pa.concat_tables([rows] if last is None else [last, rows]).combine_chunks()
        turn = rows["turn"].to_numpy()
        n = len(turn)
        by = rows["by"].combine_chunks()
        starts = np.concatenate([[True], pc.not_equal(by.slice(1), by.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool)])
        key_start = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        source = np.maximum.accumulate(np.where(turn == 1, np.arange(n), -1))
        source = np.where(source >= key_start, source, -1)
        asked = np.flatnonzero(turn == 2)
        if len(asked):
            taken = rows["r"].take(pa.array(source[asked], pa.int64(), mask=source[asked] < 0))
            yield from _batches(rows.take(pa.array(asked)).set_column(3, "r", taken), part, target)
        end = int(source[-1])
        # The right row goes on as one that is known (turn 1); without one the key alone goes on.
        last = rows.slice(n - 1, 1) if end < 0 else rows.slice(end, 1)
        last = last.set_column(1, "turn", pa.array([1 if end >= 0 else 0], pa.int32()))
    if last is not None:
        yield from _batches(last.set_column(1, "turn", pa.array([0], pa.int32())).set_column(2, "l", pa.nulls(1, last["l"].type)), part, target)


def _batches(rows: pa.Table, part: int, schema: pa.Schema) -> list[pa.RecordBatch]:
    columns = [*rows.columns, pa.array(np.full(len(rows), part, np.int32))]
    return pa.Table.from_arrays(columns, schema=schema).to_batches()


def range_join(points: DataFrame, point: str, ranges: DataFrame, low: str, high: str) -> DataFrame:
    """Rows of ``points`` with every row of ``ranges`` where ``low <= point <= high``.

    The number line is cut at quantiles of the points. A range is repeated for
    each slice it touches, then both sides meet on the slice number in an
    equi-join, whose hot partitions AQE can split; Spark's own plan for such a
    condition compares every point with every range.
    """
    cuts = cut_points(points, number_line(points, point), shuffle_partitions(points.sparkSession))
    left = points.filter(names.col(point).isNotNull()).withColumn("__slice", slice_number(number_line(points, point), cuts))
    touched = F.sequence(slice_number(number_line(ranges, low), cuts), slice_number(number_line(ranges, high), cuts))
    right = ranges.filter(names.col(low) <= names.col(high)).withColumn("__range_slice", F.explode(touched))
    inside = (names.col(point) >= names.col(low)) & (names.col(point) <= names.col(high))
    joined = left.join(right, (F.col("__slice") == F.col("__range_slice")) & inside)
    return joined.drop("__slice", "__range_slice")
