"""Frames of a few rows that describe a schema."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows as a local relation: Catalyst knows their size, no job reads them.

    For metadata only (a row per column or the like).
    """
    fields = T.StructType.fromDDL(schema)
    columns = [[r[i] for r in rows] for i in range(len(fields.fields))]
    target = to_arrow_schema(fields)
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)
    return spark.createDataFrame(table, fields)
