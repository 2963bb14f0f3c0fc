"""Row numbers over a whole table without a one-partition window."""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, values
from ..functions import types as ty
from .small import small_frame
from .storage import shuffle_partitions, stored

# ``monotonically_increasing_id`` has the partition above this bit, the place in it below.
_PLACE_BITS = 33


@dataclass(frozen=True)
class Key:
    """Leading sort key of a row order."""

    value: Column
    descending: bool = False
    nulls_first: bool = False

    def order(self, column: Column) -> Column:
        if self.descending:
            return column.desc_nulls_first() if self.nulls_first else column.desc_nulls_last()
        return column.asc_nulls_first() if self.nulls_first else column.asc_nulls_last()


@dataclass(frozen=True)
class RowOrder:
    """A table stored in order, with what it takes to find any place in it.

    ``placed`` has the rows with ``__place`` (partition and place in it), which
    grows with the order and so bounds every file; ``before`` has, for each
    partition, the number of rows before it. Both serve any number of reads.
    """

    placed: DataFrame
    before: list[tuple[int, int]]
    total: int

    @property
    def columns(self) -> list[str]:
        return self.placed.columns[:-1]

    def indexed(self, index: str = "row_index", rows: DataFrame | None = None) -> DataFrame:
        """``index`` = 0..n-1 and all columns."""
        placed = self.placed if rows is None else rows
        part, place = F.shiftrightunsigned("__place", _PLACE_BITS), F.col("__place").bitwiseAND((1 << _PLACE_BITS) - 1)
        # A row per range partition.
        before = F.broadcast(small_frame(placed.sparkSession, self.before, "__part bigint, __before bigint"))
        columns = [names.col(c) for c in self.columns]
        return placed.join(before, part == F.col("__part")).select((F.col("__before") + place).alias(index), *columns)

    def slice(self, first: int, count: int, index: str = "row_index") -> DataFrame:
        """The rows ``first`` to ``first + count - 1``: one range of places, which reaches the scan."""
        last = min(first + count, self.total) - 1
        if first < 0 or last < first:
            return self.indexed(index, self.placed.limit(0))
        return self.indexed(index, self.placed.filter(F.col("__place").between(self._place(first), self._place(last))))

    def _place(self, position: int) -> int:
        k = bisect.bisect_right([n for _, n in self.before], position) - 1
        part, before = self.before[k]
        return (part << _PLACE_BITS) + position - before


def row_order(df: DataFrame, keys: list[Key]) -> RowOrder:
    """The table in the order of ``keys``, ties by all columns. One range shuffle.

    1. Rows are range-partitioned on the whole sort key and, last, on their
       place in the input, so neither a heavy value nor a row copied over a
       third of the table lands in one task.
    2. They are sorted there and stored with their place in the partition,
       since a second run of the range partitioner may choose other bounds.
    3. The sizes of the partitions, a number each, tell the rest.
    """
    fields = df.schema.fields
    opaque = {f.name: f"__text{i}" for i, f in enumerate(fields) if not ty.can_be_grouped(f.dataType)}
    columns = [names.col(f.name) for f in fields]
    keyed = df.select(
        *columns,
        *[k.value.alias(f"__key{i}") for i, k in enumerate(keys)],
        *[values.as_text(names.col(f.name), f.dataType).alias(opaque[f.name]) for f in fields if f.name in opaque],
        F.monotonically_increasing_id().alias("__copy"),
    )
    order = [k.order(F.col(f"__key{i}")) for i, k in enumerate(keys)]
    order += [names.col(opaque.get(f.name, f.name)).asc_nulls_last() for f in fields]
    order.append(F.col("__copy"))
    ranged = keyed.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = stored(ranged.select(*columns, F.monotonically_increasing_id().alias("__place")))
    sizes = placed.groupBy(F.shiftrightunsigned("__place", _PLACE_BITS)).count().collect()
    before, total = [], 0
    for part, size in sorted(map(tuple, sizes)):
        before.append((part, total))
        total += size
    return RowOrder(placed, before, total)


def with_row_index(df: DataFrame, keys: list[Key], index: str = "row_index") -> DataFrame:
    """Add ``index`` = 0..n-1 in the order of ``keys``, ties by all columns."""
    return row_order(df, keys).indexed(index)
