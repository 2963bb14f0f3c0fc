"""Type families used by the mapping, drift and quality rules."""

from __future__ import annotations

from pyspark.sql import types as T

TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.StructType, T.ArrayType, T.MapType, T.VariantType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, TEMPORAL)


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, NESTED)


def signature(dtype: T.DataType) -> str:
    """Type family; two columns can be mapped onto each other when it is equal.

    Decided by the data type itself, so an interval or a nested type keeps its
    own signature instead of falling into the family its name resembles.
    """
    if is_text(dtype):
        return "TEXT"
    if is_numeric(dtype):
        return "NUMERIC"
    if is_temporal(dtype):
        return "TEMPORAL"
    if isinstance(dtype, T.BooleanType):
        return "BOOLEAN"
    return dtype.simpleString().upper()


def can_be_key(dtype: T.DataType) -> bool:
    return not is_nested(dtype) and not isinstance(dtype, T.BinaryType)


def _holds(dtype: T.DataType, kinds: tuple[type, ...]) -> bool:
    if isinstance(dtype, kinds):
        return True
    if isinstance(dtype, T.StructType):
        return any(_holds(f.dataType, kinds) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _holds(dtype.elementType, kinds)
    return False


def can_be_grouped(dtype: T.DataType) -> bool:
    """Maps and variants can be neither grouped, sorted nor compared by Spark."""
    return not _holds(dtype, (T.MapType, T.VariantType))
