"""Frame operators: columns, rows by position, union by name, elementwise arithmetic."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from stratalith.operators.order import with_index


def column_index(df: DataFrame, name: str | int) -> int:
    if isinstance(name, int):
        return name
    if name not in df.columns:
        raise KeyError(name)
    return df.columns.index(name)


def with_names(df: DataFrame, *names: str) -> DataFrame:
    if len(names) != len(df.columns):
        raise ValueError("as many names as columns are needed")
    return df.toDF(*names)


def rename(df: DataFrame, mapping: dict[str | int, str]) -> DataFrame:
    """Unknown names are ignored."""
    return df.withColumnsRenamed({df.columns[k] if isinstance(k, int) else k: v for k, v in mapping.items()})


def add_columns(df: DataFrame, **columns: Column) -> DataFrame:
    for c in columns:
        if c in df.columns:
            raise ValueError(f"there is a column {c} already")
    return df.withColumns(columns)


def replace_column(df: DataFrame, name: str, value: Column | Callable[[Column], Column]) -> DataFrame:
    column_index(df, name)
    return df.withColumn(name, value(F.col(name)) if callable(value) and not isinstance(value, Column) else value)


def drop_columns(df: DataFrame, *names: str | int) -> DataFrame:
    """By name or index; missing ones are no error."""
    return df.drop(*(df.columns[n] if isinstance(n, int) and n < len(df.columns) else str(n) for n in names))


def each(df: DataFrame, f: Callable[[Column], Column], *columns: str) -> DataFrame:
    """f on every cell (of the given columns)."""
    return df.select(*(f(F.col(c)).alias(c) if not columns or c in columns else F.col(c) for c in df.columns))


def row_sum(df: DataFrame, *columns: str) -> Column:
    return reduce(add, (F.coalesce(F.col(c), F.lit(0)) for c in columns or df.columns))


def dot(df: DataFrame, weights: dict[str, float]) -> Column:
    return reduce(add, (F.col(c) * F.lit(w) for c, w in weights.items()))


def plus(a: Column, b: Column) -> Column:
    """Addition in which null is neutral."""
    return F.coalesce(a + b, a, b)


def combine(left: DataFrame, right: DataFrame, op: Callable[[Column, Column], Column], on: str) -> DataFrame:
    """Elementwise by matching name, rows matched by `on`; unmatched columns pass through, from the left first."""
    both = left.alias("l").join(right.alias("r"), F.col(f"l.{on}") == F.col(f"r.{on}"))
    out = [F.col(f"l.{on}").alias(on)]
    for c in left.columns:
        if c != on:
            out.append((op(F.col(f"l.{c}"), F.col(f"r.{c}")) if c in right.columns else F.col(f"l.{c}")).alias(c))
    return both.select(*out, *(F.col(f"r.{c}") for c in right.columns if c not in left.columns))


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name; missing columns are null."""
    return a.unionByName(b, allowMissingColumns=True)


def drop_value(df: DataFrame, value) -> DataFrame:
    """Without the rows that hold the value (None: null; nan) in any column."""
    if value is None:
        return df.dropna()
    same = [F.col(c).cast("string") == F.lit(str(value)) if not isinstance(value, float) else F.col(c).eqNullSafe(F.lit(value)) for c, t in df.dtypes if isinstance(value, str) == (t == "string")]
    return df.where(~reduce(lambda x, y: x | y, (F.coalesce(s, F.lit(False)) for s in same), F.lit(False)))


def slice_rows(df: DataFrame, order: list, start: int | None = None, end: int | None = None, step: int = 1) -> DataFrame:
    """Rows [start, end) by position in a total order; negative positions count from the end."""
    n = df.count() if (start or 0) < 0 or (end or 0) < 0 else None
    lo = 0 if start is None else start if start >= 0 else max(0, n + start)
    hi = None if end is None else end if end >= 0 else max(0, n + end)
    d = with_index(df, *order, name="_ix").where(F.col("_ix") >= lo)
    d = d if hi is None else d.where(F.col("_ix") < hi)
    return d.where((F.col("_ix") - lo) % step == 0).drop("_ix")


def head(df: DataFrame, order: list, n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, order: list, n: int = 5) -> DataFrame:
    return slice_rows(df, order, -n)


def iloc(df: DataFrame, order: list, i: int):
    n = df.count()
    if not -n <= i < n:
        raise IndexError(i)
    return slice_rows(df, order, i % n, i % n + 1).first()


def lookup(df: DataFrame, key: str | Callable[[DataFrame], Column], value) -> DataFrame:
    """Rows of one key; none for a missing key."""
    return df.where((F.col(key) if isinstance(key, str) else key(df)).eqNullSafe(F.lit(value)))


def equals(a: DataFrame, b: DataFrame) -> bool:
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
