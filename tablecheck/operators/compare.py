"""Comparing two tables row by row in a given order, over a column mapping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, values
from ..functions import types as ty
from ..plans.ordering import Key, with_row_index
from ..plans.small import small_frame

# Row states and how many rows a preview shows.
MISSING_IN_BASE = "missing_in_base"
MISSING_IN_COMPARE = "missing_in_compare"
VALUE_MISMATCH = "value_mismatch"
UNCHANGED = "unchanged"
PREVIEW_ROWS = 1000


@dataclass(frozen=True)
class Pair:
    """A base column with the compare column it stands for."""

    base: str
    compare: str
    match_type: str = "exact"
    confidence: float = 1.0

    @property
    def display(self) -> str:
        return self.base if self.base == self.compare else f"{self.base} -> {self.compare}"


def compare_metadata(base: DataFrame, other: DataFrame) -> DataFrame:
    """Columns of both tables with type, nullability, decimal size and signature."""
    rows = []
    for side, df in (("base", base), ("compare", other)):
        for pos, f in enumerate(df.schema.fields):
            precision, scale = getattr(f.dataType, "precision", None), getattr(f.dataType, "scale", None)
            kind = "nullable" if f.nullable else "required"
            rows.append((side, pos, f.name, f.dataType.simpleString(), kind, precision, scale, ty.signature(f.dataType)))
    return small_frame(base.sparkSession, rows,
        "side string, pos int, `column` string, data_type string, nullable_status string, "
        "decimal_precision int, decimal_scale int, type_signature string",
    )


def _checked_pair(base: DataFrame, other: DataFrame, pair: Pair, role: str) -> None:
    for df, name, side in ((base, pair.base, "base"), (other, pair.compare, "compare")):
        if name not in df.columns:
            raise ValueError(f"{role}: the {side} table has no column {name!r}.")
    if ty.signature(base.schema[pair.base].dataType) != ty.signature(other.schema[pair.compare].dataType):
        raise ValueError(f"{role}: {pair.base!r} and {pair.compare!r} are of different types.")


def check_mapping(base: DataFrame, other: DataFrame, mapping: list[tuple[str, str]] | list[Pair] | None = None) -> list[Pair]:
    """The mapping as checked pairs; none given means equal columns in equal order."""
    if mapping is None:
        if base.columns != other.columns:
            raise ValueError("Without a mapping both tables need the same columns in the same order.")
        mapping = [(c, c) for c in base.columns]
    if not mapping:
        raise ValueError("Map at least one column.")
    pairs = [m if isinstance(m, Pair) else Pair(*m) for m in mapping]
    for pair in pairs:
        _checked_pair(base, other, pair, "Mapping")
    for side in ("base", "compare"):
        used = [getattr(p, side) for p in pairs]
        twice = sorted({n for n in used if used.count(n) > 1})
        if twice:
            raise ValueError(f"Mapping: {side} column {twice[0]!r} is used more than once.")
    return pairs


def check_order(base: DataFrame, other: DataFrame, order: tuple[str, str] | None) -> Pair:
    if not order:
        raise ValueError("Choose the column both tables are ordered by.")
    pair = Pair(*order)
    _checked_pair(base, other, pair, "Order")
    return pair


def compared_columns(
    base: DataFrame, other: DataFrame, pairs: list[Pair], in_base: Column, in_compare: Column, nan_differs: bool
) -> tuple[Column, Column]:
    """Row state and the list of differing columns, from ``base.*`` and ``compare.*`` columns."""
    flags = []
    for p in pairs:
        a, b = names.col(f"base.{p.display}"), names.col(f"compare.{p.display}")
        kinds = base.schema[p.base].dataType, other.schema[p.compare].dataType
        opaque = next((k for k in kinds if not ty.can_be_grouped(k)), kinds[0])
        flags.append(F.when(~values.same(a, b, opaque, nan_differs), F.lit(p.display)))
    changed = F.array_compact(F.array(*flags))
    every = F.array(*[F.lit(p.display) for p in pairs])
    mismatched = F.when(in_base & in_compare, changed).otherwise(every)
    status = (
        F.when(~in_base, MISSING_IN_BASE)
        .when(~in_compare, MISSING_IN_COMPARE)
        .when(F.size(changed) > 0, VALUE_MISMATCH)
        .otherwise(UNCHANGED)
    )
    return status, mismatched


def positional_compare(
    base: DataFrame,
    other: DataFrame,
    mapping: list[tuple[str, str]] | None = None,
    order: tuple[str, str] | None = None,
    nan_as_mismatch: bool = False,
) -> DataFrame:
    """Rows that differ when both tables are sorted and paired by position.

    Both sides are numbered without a one-partition window, then joined on
    the row number, which is unique and so spreads evenly. Ties in the order
    column are broken by the mapped columns in mapping order.
    """
    pairs = check_mapping(base, other, mapping)
    by = check_order(base, other, order)

    def side(df: DataFrame, which: str, order_column: str) -> DataFrame:
        columns = [names.col(getattr(p, which)).alias(f"{which}.{p.display}") for p in pairs]
        mapped = {getattr(p, which): f"{which}.{p.display}" for p in pairs}
        extra = [] if order_column in mapped else [names.col(order_column).alias("__order")]
        key = names.col(mapped.get(order_column, "__order"))
        key = values.sort_key(key, df.schema[order_column].dataType)
        return with_row_index(df.select(*columns, *extra), [Key(key)]).drop("__order").withColumn(f"in_{which}", F.lit(True))

    left, right = side(base, "base", by.base), side(other, "compare", by.compare)
    joined = left.join(right, "row_index", "full")
    status, mismatched = compared_columns(
        base, other, pairs, F.col("in_base").isNotNull(), F.col("in_compare").isNotNull(), nan_as_mismatch
    )
    shown = [names.col(f"{which}.{p.display}") for which in ("base", "compare") for p in pairs]
    rows = joined.select("row_index", status.alias("status"), mismatched.alias("mismatched_columns"), *shown)
    return rows.filter(F.col("status") != UNCHANGED)


def compare_summary(base: DataFrame, other: DataFrame, mismatches: DataFrame) -> DataFrame:
    """Row totals of both tables, mismatch count, and whether a preview would be cut."""
    totals = mismatches.agg(
        F.count(F.lit(1)).alias("mismatch_count"),
        F.count_if(F.col("status") == VALUE_MISMATCH).alias("value_mismatches"),
        F.count_if(F.col("status") == MISSING_IN_BASE).alias("missing_in_base"),
        F.count_if(F.col("status") == MISSING_IN_COMPARE).alias("missing_in_compare"),
    )
    size = F.count(F.lit(1)).alias("n")
    left, right = base.agg(size).scalar(), other.agg(size).scalar()
    return totals.select(
        left.alias("total_rows_base"),
        right.alias("total_rows_compare"),
        F.greatest(left, right).alias("rows_compared"),
        "*",
        (F.col("mismatch_count") > PREVIEW_ROWS).alias("truncated"),
    )


def preview(mismatches: DataFrame, order: str, n: int = PREVIEW_ROWS) -> DataFrame:
    """First ``n`` rows of a diff; the whole diff stays available as a DataFrame."""
    ties = [names.col(c).asc_nulls_last() for c in mismatches.columns if c != order and c != "mismatched_columns"]
    return mismatches.orderBy(names.col(order).asc_nulls_last(), *ties).limit(n)
