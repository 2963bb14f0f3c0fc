"""Cutting lineage where a result must stay the same when it is read twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def use_checkpoint_folder(spark: SparkSession) -> None:
    """Checkpoint into the folder the cluster names in ``spark.checkpoint.dir``."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder all executors can reach.")
        folder = tempfile.mkdtemp(prefix="tablecheck-checkpoint-")
    context.setCheckpointDir(folder)


def scratch_folder(spark: SparkSession) -> str:
    """A new path below the checkpoint folder, which all executors can reach."""
    use_checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, unlike a local one."""
    use_checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: lineage and plan end here, and later plans know the true size.

    Columns are kept by position, so any names may be stored. Types that files cannot hold are checkpointed instead.
    """
    if _unstorable(df.schema):
        return checkpointed(df)
    folder = scratch_folder(df.sparkSession)
    plain = [f"c{i}" for i in range(len(df.columns))]
    df.toDF(*plain).write.parquet(folder)
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(plain, df.schema.fields)])
    return df.sparkSession.read.schema(schema).parquet(folder).toDF(*df.columns)


def _unstorable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return not kind.fields or any(_unstorable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _unstorable(kind.elementType)
    if isinstance(kind, T.MapType):
        return _unstorable(kind.keyType) or _unstorable(kind.valueType)
    return isinstance(kind, (T.NullType, T.CalendarIntervalType))
