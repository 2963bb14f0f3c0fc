"""Column expressions for reading values: text form, numbers, dates, group keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import types as ty

# Shape of a decimal number and of an ISO-like date in text.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
DATE_PATTERN = r"^\s*\d{4}-\d{1,2}(-\d{1,2}([T ].*)?)?\s*$"
CLOCK_PATTERN = r"[tT ]\d{1,2}:\d{2}"

LONGEST_PLAIN_KEY = 64
DIGEST_MARK = "#"


def as_text(value: Column, dtype: T.DataType) -> Column:
    """Text form of any value; nested values as compact JSON."""
    if ty.is_text(dtype):
        return value
    if isinstance(dtype, T.MapType):
        value = plain_zero(value, dtype)
        entries = F.sort_array(F.map_entries(value)) if ty.can_be_grouped(dtype.valueType) else F.map_entries(value)
        return F.to_json(entries)
    if ty.is_nested(dtype):
        return F.to_json(plain_zero(value, dtype))
    if isinstance(dtype, T.BinaryType):
        return F.base64(value)
    return plain_zero(value, dtype).cast("string")


def plain_zero(value: Column, dtype: T.DataType) -> Column:
    """0.0 for -0.0, which is the same number but another text; inside nested values as well."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return value + F.lit(0).cast(dtype)
    if isinstance(dtype, T.ArrayType) and _holds_fractions(dtype):
        return F.transform(value, lambda x: plain_zero(x, dtype.elementType))
    if isinstance(dtype, T.StructType) and _holds_fractions(dtype):
        fields = [plain_zero(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.MapType) and _holds_fractions(dtype.valueType):
        return F.transform_values(value, lambda _, x: plain_zero(x, dtype.valueType))
    return value


def _holds_fractions(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_holds_fractions(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _holds_fractions(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _holds_fractions(dtype.valueType)
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def present(text: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(text != "", F.lit(False))


def as_number(text: Column) -> Column:
    """Double when the text is a finite decimal number, else null."""
    number = F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def number_of(value: Column, dtype: T.DataType) -> Column:
    """Double of a numeric or numeric-looking value; null otherwise."""
    if ty.is_numeric(dtype):
        number = plain_zero(value, dtype).cast("double")
        return F.when(F.abs(number) < float("inf"), number)
    if ty.is_text(dtype):
        return as_number(value)
    return F.lit(None).cast("double")


def as_moment(text: Column) -> Column:
    """Timestamp when the text is an ISO-like date or date and time, else null."""
    return F.when(text.rlike(DATE_PATTERN), F.trim(text).try_cast("timestamp_ntz"))


def is_boolean_text(text: Column) -> Column:
    return F.lower(text).isin("true", "false")


def is_long(text: Column) -> Column:
    """Longer than a plain key, and not a number with very many digits."""
    trimmed = F.trim(text)
    return (F.length(trimmed) > LONGEST_PLAIN_KEY) & trimmed.rlike("[^0-9eE.+-]")


def compact(text: Column) -> Column:
    """The text itself, or a mark and the SHA-256 of a long one.

    Grouping whole documents would shuffle them; 64 hex digits stand for the
    whole text (not a prefix of it) and meet only by a SHA-256 collision. A
    digest never reads as a number, date or Boolean, as no long text does.
    """
    return F.when(is_long(text), F.concat(F.lit(DIGEST_MARK), F.sha2(text, 256))).otherwise(text)


def group_key(value: Column, dtype: T.DataType) -> Column:
    """Value to group or compare by: equal keys mean equal values."""
    if ty.is_text(dtype):
        return compact(value)
    if isinstance(dtype, T.BinaryType):
        return F.when(F.length(value) > LONGEST_PLAIN_KEY, F.sha2(value, 256)).otherwise(F.hex(value))
    if ty.is_nested(dtype):
        return compact(as_text(value, dtype))
    return value


def sort_key(value: Column, dtype: T.DataType) -> Column:
    """Value to sort by where the type itself has no order."""
    return value if ty.can_be_grouped(dtype) else as_text(value, dtype)


def same(a: Column, b: Column, dtype: T.DataType, nan_differs: bool = False) -> Column:
    """Null-safe equality; NaN equals NaN unless asked otherwise."""
    if not ty.can_be_grouped(dtype):
        a, b = as_text(a, dtype), as_text(b, dtype)
    equal = a.eqNullSafe(b)
    if nan_differs and isinstance(dtype, (T.FloatType, T.DoubleType)):
        equal = equal & ~F.coalesce(F.isnan(a), F.lit(False))
    return equal
