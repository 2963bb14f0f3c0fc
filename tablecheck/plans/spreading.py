"""Using all cores for tables that arrive as one or a few splits."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .joining import estimated_bytes

# Larger tables are split over the cores by the scan itself.
SMALL_TABLE = 256 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt out to all cores before costly tests of each cell.

    A file with one row group is one task, however many cores there are. The
    shuffle this adds is bounded by ``SMALL_TABLE``.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if cores > 1 and is_small(df) else df


def is_small(df: DataFrame) -> bool:
    return estimated_bytes(df) <= SMALL_TABLE


def is_scan(df: DataFrame) -> bool:
    """Whether rows come from files without a shuffle or Python on the way, so that reading some columns once more costs little."""
    return not re.search("Exchange|Python|InArrow|InPandas", df._jdf.queryExecution().executedPlan().toString())
