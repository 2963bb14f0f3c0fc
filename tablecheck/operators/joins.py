"""Two-table join with prefixed columns, its preview, its size, key candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions import types as ty
from ..plans.joining import outer_join
from ..plans.small import small_frame

# Join kinds and the usual size of the preview.
JOIN_KINDS = ("inner", "left", "right", "full")
USUAL_PREVIEW = 100


def _checked(base: DataFrame, other: DataFrame, base_column: str, join_column: str, how: str) -> str:
    kind = (how or "inner").lower()
    if kind not in JOIN_KINDS:
        raise ValueError(f"Unknown join kind {how!r}; use one of {', '.join(JOIN_KINDS)}.")
    for frame, name, side in ((base, base_column, "base"), (other, join_column, "join")):
        if name not in frame.columns:
            raise ValueError(f"The {side} table has no column {name!r}.")
    return kind


def join_tables(base: DataFrame, other: DataFrame, base_column: str, join_column: str, how: str = "inner") -> DataFrame:
    """Join on one column; columns become ``base.<c>`` and ``join.<c>``.

    A null key matches nothing. Every kind of join stays spread out on a hot
    key (see ``plans.joining``).
    """
    kind = _checked(base, other, base_column, join_column, how)
    left = base.toDF(*[f"base.{c}" for c in base.columns])
    right = other.toDF(*[f"join.{c}" for c in other.columns])
    return outer_join(left, right, names.col(f"base.{base_column}"), names.col(f"join.{join_column}"), kind, False)


def join_count(base: DataFrame, other: DataFrame, base_column: str, join_column: str, how: str = "inner") -> DataFrame:
    """One row ``total_rows``: size of the join, without producing its pairs.

    Both sides are first counted by key; keys then meet by the comparison
    that the join itself makes, so a text key may meet several numbers' rows.
    A pair of keys with m and n rows adds m * n.
    """
    kind = _checked(base, other, base_column, join_column, how)
    left = base.groupBy(names.col(base_column).alias("b")).agg(F.count(F.lit(1)).alias("m"))
    right = other.groupBy(names.col(join_column).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    met = left.join(right, F.col("b") == F.col("j"), kind)
    pairs = F.coalesce("m", F.lit(1)) * F.coalesce("n", F.lit(1))
    return met.agg(F.coalesce(F.sum(pairs), F.lit(0)).cast("long").alias("total_rows"))


@dataclass(frozen=True)
class JoinPreview:
    rows: DataFrame
    total: DataFrame

    def total_rows(self) -> int:
        return self.total.first()[0]


def join_preview(
    base: DataFrame, other: DataFrame, base_column: str, join_column: str, how: str = "inner", limit: int = USUAL_PREVIEW
) -> JoinPreview:
    """First rows of the join beside its full size."""
    if limit < 1:
        raise ValueError("A preview has one row at least.")
    rows = join_tables(base, other, base_column, join_column, how).limit(limit)
    return JoinPreview(rows, join_count(base, other, base_column, join_column, how))


def join_candidates(base: DataFrame, other: DataFrame) -> DataFrame:
    """``base_column, join_column, type_signature, same_name`` of columns that can be joined."""
    rows = [
        (b.name, o.name, ty.signature(b.dataType), b.name.lower() == o.name.lower())
        for b in base.schema.fields
        for o in other.schema.fields
        if ty.signature(b.dataType) == ty.signature(o.dataType) and ty.can_be_key(b.dataType)
    ]
    return small_frame(base.sparkSession, rows, "base_column string, join_column string, type_signature string, same_name boolean"
    )
