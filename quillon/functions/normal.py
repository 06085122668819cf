"""Values of any schema in the kinds that JSON has, with limits on nesting and on the number of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: levels of nesting.
MOST_DEPTH = 128


def normalised(value: Column, kind: T.DataType, depth: int = 0) -> Column:
    """Timestamps and dates become ISO texts in UTC, maps get text keys (that of a null key is empty), structs, arrays and
    maps are walked to their ends; numbers, texts and truth values stay, NaN and infinities are an error."""
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) and depth >= MOST_DEPTH:
        raise ValueError(f"nesting exceeds {MOST_DEPTH} levels")
    if isinstance(kind, T.TimestampType):
        return F.date_format(F.to_utc_timestamp(value, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return F.date_format(value.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        odd = F.isnan(value) | (F.abs(value) == float("inf"))
        return F.when(odd, F.raise_error(F.lit("a number that is not finite"))).otherwise(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: normalised(x, kind.elementType, depth + 1))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.transform_keys(value, lambda k, _: k.cast("string")), lambda _, v: normalised(v, kind.valueType, depth + 1))
    if isinstance(kind, T.StructType):
        walked = F.struct(*[normalised(value.getField(f.name), f.dataType, depth + 1).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), walked)
    if isinstance(kind, (T.BinaryType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
        raise ValueError(f"a value of the kind {kind.simpleString()}")
    return value


def value_count(value: Column, kind: T.DataType) -> Column:
    """How many values a value holds, itself included: what a limit on expansion counts."""
    one = F.lit(1).cast("long")
    if isinstance(kind, T.ArrayType):
        return one + F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + value_count(x, kind.elementType)), F.lit(0))
    if isinstance(kind, T.MapType):
        return one + F.coalesce(F.aggregate(F.map_values(value), F.lit(0).cast("long"), lambda a, x: a + value_count(x, kind.valueType)), F.lit(0))
    if isinstance(kind, T.StructType):
        inner = sum((value_count(value.getField(f.name), f.dataType) for f in kind.fields), F.lit(0).cast("long"))
        return one + F.when(value.isNotNull(), inner).otherwise(0)
    return one
