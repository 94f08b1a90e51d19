"""Type predicates: over the columns of a frame by its schema, and over Python values."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, types as T

#: What the predicates of a column ask of its type.
COLUMN = {
    "string": T.StringType, "dictionary": T.MapType, "date_time": (T.TimestampNTZType, T.TimestampType, T.DateType), "time_duration": T.DayTimeIntervalType, "float": (T.FloatType, T.DoubleType),
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "numeric": T.NumericType, "bool": T.BooleanType, "vector": T.ArrayType, "iterable": (T.ArrayType, T.MapType, T.StringType), "tuple": T.StructType, "alternative": T.VariantType,
}


def is_(kind: str) -> Callable[[T.DataType], bool]:
    """Whether a type is of a kind of COLUMN."""
    return lambda t: isinstance(t, COLUMN[kind])


def of_type(*kinds: type[T.DataType]) -> Callable[[T.DataType], bool]:
    """A predicate for any of the given type classes."""
    return lambda t: isinstance(t, kinds)


def columns_of(df: DataFrame, predicate: Callable[[T.DataType], bool]) -> list[str]:
    return [f.name for f in df.schema if predicate(f.dataType)]


def verdicts(df: DataFrame, predicate: Callable[[T.DataType], bool]) -> DataFrame:
    """column, holds: for each column of df, whether the predicate holds for its type."""
    return df.sparkSession.createDataFrame([(f.name, predicate(f.dataType)) for f in df.schema], "column string, holds boolean")


#: Predicates over Python values: names and symbols are strings here, and mutable vectors are lists.
VALUE: dict[str, Callable[[object], bool]] = {
    "tag": lambda v: isinstance(v, str) and v.isidentifier(), "symbol": lambda v: isinstance(v, str), "mutable_vector": lambda v: isinstance(v, list), "code": lambda v: inspect.iscode(v) or hasattr(v, "__code__"),
    "class": inspect.isclass, "object": lambda v: not inspect.isclass(v) and not inspect.ismodule(v) and not inspect.isroutine(v), "instance": lambda v: not inspect.isclass(v) and type(v).__module__ != "builtins",
    "module": inspect.ismodule, "function": inspect.isroutine,
}
