"""Pieces that several operators share: lookups, bindings inside expressions, folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablecheck.plans.shipping import ship_package
from tablecheck.plans.storage import checkpointed, scratch_folder, shuffle_partitions

__all__ = ["bind", "checkpointed", "load", "map_slices", "seeded_hash", "ship_package", "shuffle_partitions", "stored", "words_of"]

#: Rows that a Python task has in hand at once, apart from Spark's own Arrow batch.
SLICE = 128

#: Words of the result contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def seeded_hash(seed: str, *columns: str) -> Column:
    """A whole number from 0 to 2^60 - 1, from the MD5 of the seed and the columns."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    digest = F.md5(F.concat_ws(":", F.lit(seed), *parts))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: lineage and plan end here, and later plans know the true size."""
    folder = scratch_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def map_slices(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` in short slices, which bounds the memory that long texts take in Python.

    ``start`` runs once in each task and returns the function of a slice.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                if (made := work(batch.slice(first, SLICE))) is not None:
                    yield made
        # The worker lives on beside those of other tasks: what Arrow keeps for later goes back.
        del work
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with one more column, or another one in the place of that name."""
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), values], names=[*names, name])


def schema_with(df: DataFrame, name: str, kind) -> StructType:
    """The schema that ``with_column`` leads to."""
    return StructType([f for f in df.schema.fields if f.name != name]).add(name, kind)
