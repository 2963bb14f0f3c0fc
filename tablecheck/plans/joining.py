"""Joins that stay spread out when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import types as ty
from ..functions import values
from .storage import shuffle_partitions


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (file sizes for scans)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def fits_broadcast(df: DataFrame) -> bool:
    limit = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    digits = "".join(ch for ch in limit if ch.isdigit() or ch == "-")
    bound = int(digits or -1)
    scale = limit.strip("-0123456789bB ").lower()
    bound *= {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(scale[:1], 1)
    return 0 <= estimated_bytes(df) <= bound


# Counters of the frequency sketch: as many as it takes for each shuffle partition, up to what the function allows.
COUNTERS_PER_PARTITION, MOST_COUNTERS = 20, 1_000_000


def hot_keys(df: DataFrame, key: Column) -> set[str | None]:
    """Keys (as text) with more rows than an average shuffle partition holds.

    One pass over the key column with a mergeable frequency sketch, which
    keeps every key of that share. There are fewer such keys than partitions.
    """
    most = shuffle_partitions(df.sparkSession)
    sketch = F.expr(f"approx_top_k(k, {most}, {min(MOST_COUNTERS, max(1_000, COUNTERS_PER_PARTITION * most))})")
    found = df.select(key.alias("k")).agg(sketch.alias("top"), F.count(F.lit(1)).alias("n")).first()
    return {t["item"] for t in found["top"] or [] if t["count"] * most > found["n"]}


def _comparable_texts(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> tuple[Column, Column] | None:
    """Both keys as text such that equal keys have equal texts, or None if that cannot be promised."""
    left_type, right_type = left.select(left_key).schema[0].dataType, right.select(right_key).schema[0].dataType
    if left_type != right_type:
        if ty.is_numeric(left_type) and ty.is_numeric(right_type):
            common = T.DoubleType()
        elif ty.is_temporal(left_type) and ty.is_temporal(right_type):
            common = T.TimestampType()
        else:
            return None
        left_key, right_key, left_type, right_type = left_key.cast(common), right_key.cast(common), common, common
    return values.as_text(left_key, left_type), values.as_text(right_key, right_type)


def _is_hot(key: Column, hot: set[str | None]) -> Column:
    named = F.coalesce(key.isin(*[k for k in hot if k is not None]), F.lit(False))
    return named | key.isNull() if None in hot else named


def outer_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, how: str, null_safe: bool) -> DataFrame:
    """Join of two frames with different column names, safe against hot keys.

    AQE splits a skewed partition on either side of an inner join, but in an
    outer join only the side whose rows are all kept, and in a full join
    neither. So keys that are hot on either side are looked for first (key
    columns only). Without any, the join is the plain one. Else the rows of
    hot keys are joined apart, as an inner join plus the rows whose key the
    other side does not have; that is decided against the other side's
    distinct hot keys, of which there are at most two for each partition.
    """
    match = left_key.eqNullSafe(right_key) if null_safe else left_key == right_key
    small = {"left": right, "right": left}.get(how)
    if how == "inner" or (small is not None and fits_broadcast(small)):
        return left.join(right, match, how)
    texts = _comparable_texts(left, right, left_key, right_key)
    hot = hot_keys(left, texts[0]) | hot_keys(right, texts[1]) if texts else set()
    if not hot:
        return left.join(right, match, how)
    left_text, right_text = texts
    left_hot, right_hot = _is_hot(left_text, hot), _is_hot(right_text, hot)
    hot_left, hot_right = left.filter(left_hot), right.filter(right_hot)
    result = left.filter(~left_hot).join(right.filter(~right_hot), match, how).unionByName(hot_left.join(hot_right, match, "inner"))
    if how in ("left", "full"):
        theirs = F.broadcast(hot_right.select(right_key.alias("__key")).distinct())
        found = left_key.eqNullSafe(F.col("__key")) if null_safe else left_key == F.col("__key")
        result = result.unionByName(hot_left.join(theirs, found, "left_anti"), allowMissingColumns=True)
    if how in ("right", "full"):
        theirs = F.broadcast(hot_left.select(left_key.alias("__key")).distinct())
        found = right_key.eqNullSafe(F.col("__key")) if null_safe else right_key == F.col("__key")
        result = result.unionByName(hot_right.join(theirs, found, "left_anti"), allowMissingColumns=True)
    return result
