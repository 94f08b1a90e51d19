"""Client shapes over ordered frames: Frame, Series, Index and groups.

A Frame is a DataFrame with a row position (`_ix`); its operators are lazy and
keep the position, so they compose without a new sort. What fetches rows to the
driver (a row, a list, a matrix) checks the size first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from stratalith.operators.order import with_index

IX = "_ix"
#: Rows that may be fetched at once.
FETCH = 100_000


def fetch(df: DataFrame, most: int = FETCH) -> list[Row]:
    """All rows, or an error where there are more than `most`; no more than one too many is read."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: fetch them by partitions, or write them")
    return rows


class Series:
    """A column with row positions: _ix, x."""

    def __init__(self, df: DataFrame):
        self.df = df.select(IX, "x")

    @classmethod
    def of(cls, spark: SparkSession, values: Sequence, kind: str = "double") -> Series:
        return cls(spark.createDataFrame(list(enumerate(values)), f"{IX} long, x {kind}"))

    @classmethod
    def uniform(cls, spark: SparkSession, value, count: int) -> Series:
        return cls(spark.range(count).select(F.col("id").alias(IX), F.lit(value).alias("x")))

    @classmethod
    def range(cls, spark: SparkSession, count: int, f: Callable[[Column], Column] = lambda i: i) -> Series:
        return cls(spark.range(count).select(F.col("id").alias(IX), f(F.col("id")).alias("x")))

    def __len__(self) -> int:
        return self.df.count()

    def apply(self, f: Callable[[Column], Column]) -> Series:
        return Series(self.df.withColumn("x", f(F.col("x"))))

    def apply_with_index(self, f: Callable[[Column, Column], Column]) -> Series:
        return Series(self.df.withColumn("x", f(F.col("x"), F.col(IX))))

    def _with(self, other, op: Callable[[Column, Column], Column]) -> Series:
        if not isinstance(other, Series):
            return self.apply(lambda x: op(x, F.lit(other)))
        both = self.df.alias("a").join(other.df.alias("b"), IX)
        return Series(both.select(IX, op(F.col("a.x"), F.col("b.x")).alias("x")))

    def __add__(self, other) -> Series:
        return self._with(other, lambda a, b: a + b)

    def __sub__(self, other) -> Series:
        return self._with(other, lambda a, b: a - b)

    def __mul__(self, other) -> Series:
        return self._with(other, lambda a, b: a * b)

    def sum(self):
        return self.df.agg(F.sum("x")).first()[0]

    def dot(self, other: Series) -> float:
        return (self * other).sum()

    def __contains__(self, value) -> bool:
        return not self.df.where(F.col("x").eqNullSafe(F.lit(value))).isEmpty()

    def index(self, value) -> int:
        """First position of the value, an error without one."""
        at = self.df.where(F.col("x").eqNullSafe(F.lit(value))).agg(F.min(IX)).first()[0]
        if at is None:
            raise ValueError(f"{value} is not in the series")
        return at

    def append(self, other: Series) -> Series:
        n = len(self)
        return Series(self.df.unionByName(other.df.withColumn(IX, F.col(IX) + n)))

    def prepend(self, other: Series) -> Series:
        return other.append(self)

    def reverse(self) -> Series:
        n = len(self)
        return Series(self.df.withColumn(IX, n - 1 - F.col(IX)))

    def sort_values(self) -> Series:
        return Series(with_index(self.df.select("x", F.col(IX).alias("_old")), "x", "_old", name=IX))

    def unique(self) -> Series:
        return Series(with_index(self.df.select("x").distinct(), "x", name=IX))

    def equals(self, other: Series) -> bool:
        return self.df.exceptAll(other.df).isEmpty() and other.df.exceptAll(self.df).isEmpty()

    def to_list(self, most: int = FETCH) -> list:
        return [r.x for r in sorted(fetch(self.df, most))]

    def as_matrix(self) -> Tall:
        return Tall(self.df, ["x"])


class Tall:
    """A matrix whose rows stay distributed, whatever their number; a null is nan. Shape and sums are one aggregate; array() fetches."""

    def __init__(self, df: DataFrame, columns: Sequence[str]):
        self.df = df.select(IX, *(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"c{j}") for j, c in enumerate(columns)))
        self.columns = [f"c{j}" for j in range(len(columns))]

    @cached_property
    def _totals(self) -> tuple[int, list[float]]:
        n, *sums = self.df.agg(F.count("*"), *(F.sum(c) for c in self.columns)).first()
        return n, [x or 0.0 for x in sums]

    @property
    def shape(self) -> tuple[int, int]:
        return self._totals[0], len(self.columns)

    def __len__(self) -> int:
        return self.shape[0]

    def sum(self, axis: int | None = None) -> float | np.ndarray | Series:
        """Of all, of each column (axis 0) or of each row (axis 1)."""
        if axis == 1:
            return Series(self.df.select(IX, sum((F.col(c) for c in self.columns), F.lit(0.0)).alias("x")))
        sums = np.array(self._totals[1])
        return sums if axis == 0 else float(sums.sum())

    def __getitem__(self, at: tuple[slice, int]) -> Series:
        """m[:, j]: a column."""
        rows, j = at
        if rows != slice(None):
            raise IndexError("m[:, j] is a column; rows are fetched by array()")
        return Series(self.df.select(IX, F.col(self.columns[j]).alias("x")))

    def array(self, most: int = FETCH) -> np.ndarray:
        """The rows in order on the driver, or an error where there are more than `most`."""
        rows = sorted(fetch(self.df, most), key=lambda r: r[IX])
        return np.array([r[1:] for r in rows], float).reshape(-1, len(self.columns))

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return self.array().astype(dtype or float)


class Index:
    """Rows of a frame by the value of a key column or expression."""

    def __init__(self, frame: Frame, key: str | Callable[[DataFrame], Column]):
        self.frame, self.key = frame, F.col(key) if isinstance(key, str) else key(frame.df)

    def __getitem__(self, value) -> Frame:
        return Frame(with_index(self.frame.df.where(self.key.eqNullSafe(F.lit(value))).withColumnRenamed(IX, "_old"), "_old", name=IX).drop("_old"))

    def __contains__(self, value) -> bool:
        return not self.frame.df.where(self.key.eqNullSafe(F.lit(value))).isEmpty()

    def row_count_for_key(self, value) -> int:
        return self.frame.df.where(self.key.eqNullSafe(F.lit(value))).count()


class Frame:
    """A DataFrame with row positions."""

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def ordered(cls, df: DataFrame, *order: Column | str) -> Frame:
        return cls(with_index(df, *order, name=IX))

    @classmethod
    def of_columns(cls, spark: SparkSession, columns: dict[str, Sequence]) -> Frame:
        """Columns of equal length; an empty dictionary is the empty frame."""
        if len({len(v) for v in columns.values()}) > 1:
            raise ValueError("columns of different length")
        if not columns:
            return cls(spark.createDataFrame([], f"{IX} long"))
        return cls(spark.createDataFrame([(i, *row) for i, row in enumerate(zip(*columns.values()))], [IX, *columns]))

    @classmethod
    def of_items(cls, spark: SparkSession, items: Sequence[tuple[str, Sequence]]) -> Frame:
        return cls.of_columns(spark, dict(items))

    @classmethod
    def of_rows(cls, spark: SparkSession, rows: Sequence[Sequence], names: Sequence[str] | None = None) -> Frame:
        names = names or [f"C{i}" for i in range(len(rows[0]) if rows else 0)]
        return cls.of_columns(spark, {n: [r[i] for r in rows] for i, n in enumerate(names)})

    @classmethod
    def of_matrix(cls, spark: SparkSession, m: np.ndarray, names: Sequence[str] | None = None) -> Frame:
        return cls.of_rows(spark, np.asarray(m, float).tolist(), names)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != IX]

    @property
    def shape(self) -> tuple[int, int]:
        return len(self), len(self.columns)

    def __len__(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def __str__(self) -> str:
        """The first rows as a grid."""
        rows = [self.columns] + [[str(r[c]) for c in self.columns] for r in self.df.orderBy(IX).limit(20).collect()]
        wide = [max(len(r[i]) for r in rows) for i in range(len(self.columns))]
        return "\n".join(" ".join(v.rjust(w) for v, w in zip(r, wide)) for r in rows)

    def column(self, name: str | int) -> Series:
        name = self.columns[name] if isinstance(name, int) else name
        if name not in self.columns:
            raise KeyError(name)
        return Series(self.df.select(IX, F.col(name).alias("x")))

    def row(self, i: int) -> Row:
        """A row by position, negative from the end; an error outside."""
        i = i + len(self) if i < 0 else i
        got = self.df.where(F.col(IX) == i).select(*self.columns).first()
        if got is None:
            raise IndexError(i)
        return got

    iloc = at = loc = get = row

    def __getitem__(self, what):
        if isinstance(what, str):
            return self.column(what)
        if isinstance(what, int):
            return self.row(what)
        if isinstance(what, slice):
            lo, hi, step = what.indices(len(self)) if (what.start or 0) < 0 or (what.stop or 0) < 0 else (what.start or 0, what.stop, what.step or 1)
            d = self.df.where(F.col(IX) >= lo)
            d = d if hi is None else d.where(F.col(IX) < hi)
            return Frame(d.where((F.col(IX) - lo) % step == 0).withColumn(IX, F.expr(f"({IX} - {lo}) div {step}")))
        return Frame(self.df.select(IX, *what))

    def row_apply(self, f: Callable[[dict[str, Column]], Column]) -> Series:
        return Series(self.df.select(IX, f({c: F.col(c) for c in self.columns}).alias("x")))

    def row_apply_with_index(self, f: Callable[[dict[str, Column], Column], Column]) -> Series:
        return Series(self.df.select(IX, f({c: F.col(c) for c in self.columns}, F.col(IX)).alias("x")))

    def add_column(self, name: str, values: Column | Series) -> Frame:
        if name in self.columns:
            raise ValueError(f"there is a column {name} already")
        if isinstance(values, Series):
            return Frame(self.df.join(values.df.withColumnRenamed("x", name), IX))
        return Frame(self.df.withColumn(name, values))

    def row_major(self) -> DataFrame:
        """_ix and the row as one array, x."""
        return self.df.select(IX, F.array(*self.columns).alias("x"))

    def row_difference(self, other: Frame) -> DataFrame:
        """_ix and the elementwise difference of the rows, x; the frames have to be of one shape."""
        if self.shape != other.shape:
            raise ValueError("frames of different shape")
        both = self.row_major().alias("a").join(other.row_major().alias("b"), IX)
        return both.select(IX, F.zip_with("a.x", "b.x", lambda x, y: x - y).alias("x"))

    def index(self, key: str | Callable[[DataFrame], Column]) -> Index:
        return Index(self, key)

    def as_matrix(self) -> Tall:
        return Tall(self.df, self.columns)

    def dot(self, weights: Sequence[float]) -> Series:
        return self.row_apply(lambda r: sum((r[c] * F.lit(float(w)) for c, w in zip(self.columns, weights)), F.lit(0.0)))

    def groups(self, key: str) -> Iterator[tuple[object, Frame]]:
        """(key, frame) in key order. A frame is a filter on the key, so nothing is gathered; only the keys are fetched."""
        for r in fetch(self.df.select(key).distinct().orderBy(key)):
            yield r[0], Index(self, key)[r[0]]
