"""Types a table should be written with, and casting to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names, values
from ..functions import types as ty
from ..plans.aggregate import column_metrics
from ..plans.spreading import spread

# Write types and the Spark types they stand for; cut of a sample value.
WRITE_TYPES = {
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "BIGINT": "bigint",
    "DOUBLE": "double",
    "DECIMAL(18, 4)": "decimal(18,4)",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
}


def write_type(text: str | None) -> str:
    """A known write type; any decimal becomes DECIMAL(18, 4), anything else VARCHAR."""
    wanted = str(text or "VARCHAR").strip().upper()
    if wanted.startswith("DECIMAL"):
        return "DECIMAL(18, 4)"
    return wanted if wanted in WRITE_TYPES else "VARCHAR"


_TESTS = {
    "present": "bigint",
    "missing_count": "bigint",
    "all_boolean": "boolean",
    "all_integer": "boolean",
    "all_number": "boolean",
    "all_date": "boolean",
    "any_clock": "boolean",
    "sample_value": "string",
}


def _known_tests(value: Column, dtype: T.DataType) -> dict[str, Column]:
    """Tests of a column that is not text: mostly answered by its type."""
    yes, no = F.lit(True), F.lit(False)
    tests = {"all_boolean": no, "all_integer": no, "all_number": no, "all_date": no, "any_clock": no}
    if isinstance(dtype, T.BooleanType):
        tests["all_boolean"] = yes
    elif ty.is_numeric(dtype):
        number = values.number_of(value, dtype)
        tests["all_number"] = yes if isinstance(dtype, T.IntegralType) else F.every(F.when(value.isNotNull(), number.isNotNull()))
        whole = F.coalesce(F.floor(number) == number, no)
        tests["all_integer"] = yes if isinstance(dtype, T.IntegralType) else F.every(F.when(value.isNotNull(), whole))
    elif ty.is_temporal(dtype):
        tests["all_date"] = yes
        tests["any_clock"] = F.lit(not isinstance(dtype, T.DateType))
    sample = F.min(value) if ty.can_be_grouped(dtype) else F.min(values.as_text(value, dtype))
    shown = values.as_text(sample, dtype) if ty.can_be_grouped(dtype) else sample
    return tests | {"present": F.count(value), "missing_count": F.count_if(value.isNull()), "sample_value": shown}


def infer_write_types(df: DataFrame) -> DataFrame:
    """``column, write_type, sample_value, missing_count`` from all values, in one pass.

    The sample is the least value, so that it does not depend on row order.
    """
    # Text cells are tested in a projection below the aggregate, once per cell.
    below: list[Column] = []
    tests: dict[str, dict[str, Column]] = {}
    for i, f in enumerate(df.schema.fields):
        value = names.col(f.name)
        if not ty.is_text(f.dataType):
            tests[f.name] = _known_tests(value, f.dataType)
            continue
        here, number = values.present(value), values.as_number(value)
        below += [
            number.alias(f"number{i}"),
            F.when(here, values.is_boolean_text(value)).alias(f"boolean{i}"),
            F.when(here, number.isNull() & values.as_moment(value).isNotNull()).alias(f"date{i}"),
            value.rlike(values.CLOCK_PATTERN).alias(f"clock{i}"),
        ]
        found, shown = F.col(f"number{i}"), F.when(here, value)
        tests[f.name] = {
            "present": F.count_if(here),
            "missing_count": F.count_if(~here),
            "all_boolean": F.every(f"boolean{i}"),
            "all_integer": F.every(F.when(here, F.coalesce(F.floor(found) == found, F.lit(False)))),
            "all_number": F.every(F.when(here, found.isNotNull())),
            "all_date": F.every(f"date{i}"),
            "any_clock": F.bool_or(f"clock{i}"),
            "sample_value": F.min(shown),
        }
    tested = column_metrics(spread(df).select(*[names.col(c) for c in df.columns], *below), lambda name, _: tests[name], _TESTS, df.columns)
    kind = (
        F.when(F.col("present") == 0, "VARCHAR")
        .when(F.col("all_boolean"), "BOOLEAN")
        .when(F.col("all_integer"), "BIGINT")
        .when(F.col("all_number"), "DOUBLE")
        .when(F.col("all_date") & F.col("any_clock"), "TIMESTAMP")
        .when(F.col("all_date"), "DATE")
        .otherwise("VARCHAR")
    )
    return tested.select("column", kind.alias("write_type"), "sample_value", "missing_count")


def as_write_type(value: Column, dtype: T.DataType, wanted: str) -> Column:
    """The value in a write type, null where it does not fit.

    Fractions become whole numbers by rounding half to even.
    """
    target = WRITE_TYPES[write_type(wanted)]
    text = values.as_text(value, dtype)
    if target == "string":
        return text
    if target == "bigint":
        if isinstance(dtype, T.IntegralType):
            return value.cast("bigint")
        source = value if ty.is_numeric(dtype) or isinstance(dtype, T.BooleanType) else text
        rounded = F.bround(source.try_cast("double")).try_cast("bigint")
        if ty.is_text(dtype):
            return F.coalesce(text.try_cast("bigint"), rounded)
        return value.try_cast("bigint") if isinstance(dtype, T.BooleanType) else rounded
    if ty.is_nested(dtype) or isinstance(dtype, T.BinaryType):
        return text.try_cast(target)
    if target in ("date", "timestamp_ntz") and not ty.is_temporal(dtype):
        return text.try_cast(target)
    return value.try_cast(target)


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The table with the named columns in the given write types."""
    return df.select(
        *[
            as_write_type(names.col(f.name), f.dataType, types[f.name]).alias(f.name) if f.name in types else names.col(f.name)
            for f in df.schema.fields
        ]
    )
