"""Read-only SQL over a table, paging, quick aggregates, sorting, column choice."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, values
from ..functions import types as ty
from ..plans.aggregate import column_metrics
from ..plans.ordering import Key, RowOrder, row_order, with_row_index
from ..plans.small import small_frame

# Names under which the open table can be queried.
TABLE_ALIASES = ("file_data", "parquet_data")
# Page sizes offered, usual number of groups.
PAGE_SIZES = (100, 500, 1000, 5000)
USUAL_GROUPS = 100
AGGREGATES = ("count", "sum", "avg", "min", "max")
# One query is planned at a time, as names and dialect belong to the session.
_PLANNING = threading.RLock()


def run_sql(spark: SparkSession, tables: DataFrame | dict[str, DataFrame], sql: str | None = None) -> DataFrame:
    """Run a SELECT over ``file_data`` (or over the named tables) lazily.

    Blank text reads the whole table. The text is always placed as a subquery,
    so statements other than queries do not parse.
    """
    frames = tables if isinstance(tables, dict) else dict.fromkeys(TABLE_ALIASES, tables)
    if not frames:
        raise ValueError("There is no table to query.")
    text = (sql or "").strip().rstrip("; \t\r\n") or f'SELECT * FROM "{next(iter(frames))}"'
    if text.split(None, 1)[0].lower().split("(")[0] not in ("select", "with"):
        raise ValueError("Only queries that begin with SELECT or WITH can be run.")
    # The names are views for the moment of planning only; views of the user that have these names come back.
    setting = "spark.sql.ansi.doubleQuotedIdentifiers"
    with _PLANNING:
        before = spark.conf.get(setting)
        hidden = {name: spark.table(f"`{name}`") for name in frames if _is_view(spark, name)}
        for name, frame in frames.items():
            frame.createOrReplaceTempView(name)
        spark.conf.set(setting, "true")
        try:
            return spark.sql(f"SELECT * FROM (\n{text}\n) AS query_result")
        finally:
            spark.conf.set(setting, before)
            for name in frames:
                spark.catalog.dropTempView(name)
            for name, frame in hidden.items():
                frame.createOrReplaceTempView(name)


def _is_view(spark: SparkSession, name: str) -> bool:
    return any(t.isTemporary and t.name.lower() == name.lower() for t in spark.catalog.listTables())


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    probe: DataFrame

    def has_more(self) -> bool:
        return not self.probe.isEmpty()


def total_order(df: DataFrame, order_by: list[Column | str] | None = None) -> list[Column]:
    """The asked order, made total by the remaining columns, nulls last."""
    asked = [names.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order_by or []]
    named = {o for o in order_by or [] if isinstance(o, str)}
    rest = [f for f in df.schema.fields if f.name not in named]
    return asked + [values.sort_key(names.col(f.name), f.dataType).asc_nulls_last() for f in rest]


def page(df: DataFrame, order_by: list[Column | str] | None = None, offset: int = 0, limit: int = 1000) -> Page:
    """Rows ``offset .. offset+limit`` of a total order (a top-k in each task)."""
    ordered = df.orderBy(*total_order(df, order_by))
    return Page(ordered.offset(offset).limit(limit), ordered.offset(offset + limit).limit(1))


@dataclass(frozen=True)
class Pages:
    """A table in a total order, stored once, with pages at any offset.

    A page reads the files that hold its rows and no others, however deep it
    lies: its place is known from the sizes of the sorted partitions.
    """

    order: RowOrder

    @property
    def total(self) -> int:
        return self.order.total

    def rows(self, offset: int, limit: int = 1000) -> DataFrame:
        """Rows ``offset .. offset+limit`` in order."""
        found = self.order.slice(offset, limit, "__index")
        return found.orderBy("__index").drop("__index")

    def page(self, offset: int, limit: int = 1000) -> Page:
        return Page(self.rows(offset, limit), self.rows(offset + limit, 1))


def open_pages(df: DataFrame, order_by: list[str] | None = None) -> Pages:
    """Pages in the asked order, nulls last, made total by the remaining columns in turn."""
    keys = [Key(values.sort_key(names.col(c), df.schema[c].dataType)) for c in order_by or []]
    return Pages(row_order(df, keys))


def page_after(df: DataFrame, order_by: list[str], last: dict[str, object] | None, limit: int = 1000) -> DataFrame:
    """Next page after the row with the order values ``last`` (deep pages stay cheap).

    ``order_by`` must identify a row. The filter keeps only later rows, so no
    task holds the rows of earlier pages. Nulls come last.
    """
    later = df
    if last is not None:
        condition, equal = F.lit(False), F.lit(True)
        for name in order_by:
            value, c = last[name], names.col(name)
            beyond = F.lit(False) if value is None else (c.isNull() | (c > F.lit(value)))
            condition = condition | (equal & beyond)
            equal = equal & c.eqNullSafe(F.lit(value))
        later = df.filter(condition)
    return later.orderBy(*[names.col(o).asc_nulls_last() for o in order_by]).limit(limit)


def quick_aggregate(
    df: DataFrame, group: str | None, func: str = "count", metric: str | None = None, limit: int = USUAL_GROUPS
) -> DataFrame:
    """Largest groups by one aggregate; a single row without a group column."""
    if func not in AGGREGATES:
        raise ValueError(f"Unknown aggregate {func!r}; use one of {', '.join(AGGREGATES)}.")
    if func == "count":
        alias, aggregate = "row_count", F.count(F.lit(1))
    elif metric:
        alias, aggregate = f"{func}_{metric}", getattr(F, func)(names.col(metric))
    else:
        raise ValueError("This aggregate needs a metric column.")
    if not group:
        return df.agg(aggregate.alias(alias))
    if limit < 1:
        raise ValueError("At least one group must be asked for.")
    return (
        df.groupBy(names.col(group))
        .agg(aggregate.alias(alias))
        .orderBy(names.col(alias).desc_nulls_last(), names.col(group).asc_nulls_last())
        .limit(limit)
    )


def _sort_keys(df: DataFrame, column: str, direction: str) -> list[Key]:
    down = direction == "desc"
    dtype = df.schema[column].dataType
    value = names.col(column)
    if not ty.is_text(dtype):
        return [Key(values.sort_key(value, dtype), down, nulls_first=down)]
    number, moment = values.as_number(value), values.as_moment(value)
    rank = F.when(value.isNull(), 3).when(number.isNotNull(), 0).when(moment.isNotNull(), 1).otherwise(2)
    text = F.when(rank == 2, value)
    moment = F.when(rank == 1, moment)
    return [Key(k, down, nulls_first=down) for k in (rank, number, moment, text)]


def sort_rows(df: DataFrame, column: str, direction: str = "asc") -> DataFrame:
    """Type-aware sort: numbers (also as text), then dates, then other text.

    Nulls come last ascending and first descending; ties by all columns.
    """
    keys = [k.order(k.value) for k in _sort_keys(df, column, direction)]
    return df.orderBy(*keys, *total_order(df))


def sorted_positions(df: DataFrame, column: str, direction: str = "asc") -> DataFrame:
    """The rows of ``sort_rows`` with their position from 0."""
    return with_row_index(df, _sort_keys(df, column, direction), "position")


def choose_columns(df: DataFrame, visible: list[str]) -> DataFrame:
    """Visible columns in table order; nothing chosen means all."""
    chosen = [c for c in df.columns if c in set(visible)] or df.columns
    return df.select(*[names.col(c) for c in chosen])


def numeric_columns(df: DataFrame) -> DataFrame:
    """``pos, column`` of columns holding at least one number.

    Numeric types are known from the schema; all text columns are tested in
    one pass.
    """
    numeric = [(i, f.name) for i, f in enumerate(df.schema.fields) if ty.is_numeric(f.dataType)]
    texts = [f.name for f in df.schema.fields if ty.is_text(f.dataType)]
    known = small_frame(df.sparkSession, numeric, "pos int, `column` string")
    if not texts:
        return known
    tested = column_metrics(
        df,
        lambda name, _: {"numeric": F.coalesce(F.bool_or(values.as_number(names.col(name)).isNotNull()), F.lit(False))},
        {"numeric": "boolean"},
        texts,
    )
    return known.unionByName(tested.filter("numeric").select("pos", "column"))
