"""One text per value, so that equal values are equal whatever their type."""

from __future__ import annotations

from pyspark.sql import types as T

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _decimal_text(value: str, kind: T.DecimalType) -> str:
    if kind.scale == 0:
        return f"string({value})"
    # A fraction that a double holds exactly enough takes the double's text, so
    # that 0.5 compares equal in both types; a longer one keeps all its digits.
    return (
        f"CASE WHEN {value} = floor({value}) THEN string(floor({value}))"
        f" WHEN try_cast(string(double({value})) AS {kind.simpleString()}) = {value} THEN string(double({value}))"
        f" ELSE rtrim('0', string({value})) END"
    )


def _double_text(value: str) -> str:
    # Whole numbers up to 37 digits take the integer form; -0.0 becomes 0.
    return (
        f"CASE WHEN {value} % 1 = 0 AND abs({value}) < 1e37"
        f" THEN string(try_cast({value} AS decimal(38,0))) ELSE string({value}) END"
    )


def cell_text(value: str, kind: T.DataType) -> str:
    """SQL expression of a column's type-tagged text.

    Numbers compare by value (1 = 1.0 = true), text never equals a number, and
    NaN counts as missing, as NULL does. Integers and decimals stay exact.
    """
    if isinstance(kind, T.NullType):
        return f"string({value})"
    if isinstance(kind, T.BooleanType):
        return f"CASE WHEN {value} THEN 'n:1' WHEN NOT {value} THEN 'n:0' END"
    if isinstance(kind, _INTEGERS):
        return f"concat('n:', string({value}))"
    if isinstance(kind, T.DecimalType):
        return f"concat('n:', {_decimal_text(value, kind)})"
    if isinstance(kind, T.DoubleType):
        return f"CASE WHEN NOT isnan({value}) THEN concat('n:', {_double_text(value)}) END"
    if isinstance(kind, T.FloatType):
        return f"CASE WHEN NOT isnan({value}) THEN concat('n:', {_double_text(f'double(string({value}))')}) END"
    if isinstance(kind, T.StringType):
        return f"concat('s:', {value})"
    if isinstance(kind, T.BinaryType):
        return f"concat('b:', hex({value}))"
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return f"concat('j:', to_json({value}))"
    return f"concat('t:', string({value}))"
