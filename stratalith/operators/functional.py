"""User functions over frames: scalar, aggregate, table and grouped; and ways to run and fetch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stratalith.operators.shapes import fetch


def scalar(f: Callable[[pd.Series], pd.Series], kind: str) -> Callable[..., Column]:
    """A function of pandas series as a column function, in Arrow batches."""
    return F.pandas_udf(f, kind)


def fold(df: DataFrame, keys: list[str], seed: Callable[[pd.DataFrame], pd.Series], add: Callable[[object, object], object], merge: Callable[[object, object], object], kind: str, start: object = None) -> DataFrame:
    """keys and value: seed makes each row's value, add takes it to the running one, merge joins two running ones.

    Each task folds what it holds of a group first, so a group is shuffled as
    one value a task, and merged from those: add and merge have to be associative.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, object] = {}
        for batch in batches:
            for k, v in zip(batch[keys].itertuples(index=False, name=None), seed(batch)):
                held[k] = add(held.get(k, start), v) if k in held or start is not None else v
        yield pd.DataFrame([(*k, v) for k, v in held.items()], columns=[*keys, "value"])

    def join(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        values = batch["value"].tolist()
        total = values[0]
        for v in values[1:]:
            total = merge(total, v)
        return pd.DataFrame([(*key, total)], columns=[*keys, "value"])

    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", value {kind}"
    return df.mapInPandas(part, schema).groupBy(*keys).applyInPandas(join, schema)


def flat(df: DataFrame, f: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    """All rows that f yields for each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                out = [t for row in batch.iloc[lo : lo + 1000].to_dict("records") for t in f(row)]
                if out:
                    yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in schema.split(",")])

    return df.mapInPandas(run, schema)


def grouped(df: DataFrame, keys: list[str], f: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f over each group as a pandas frame: a group has to fit in a task (use fold() where it may not)."""
    return df.groupBy(*keys).applyInPandas(f, schema)


def submit(f: Callable, *args):
    """A handle on f(*args), run beside the caller; see Handle."""
    return Handle(f, *args)


class Handle:
    """result() waits; cancel() stops the Spark jobs that f started."""

    def __init__(self, f: Callable, *args):
        self.spark, self.value, self.error = SparkSession.getActiveSession(), None, None
        self.tag = f"handle-{id(self)}"

        def run():
            self.spark.addTag(self.tag)
            try:
                self.value = f(*args)
            except BaseException as e:  # given to whoever asks for the result
                self.error = e

        self.thread = InheritableThread(target=run)
        self.thread.start()

    def result(self):
        self.thread.join()
        if self.error is not None:
            raise self.error
        return self.value

    def cancel(self) -> None:
        self.spark.interruptTag(self.tag)


def define(spark: SparkSession, value):
    """A value that is sent to every task once."""
    return spark.sparkContext.broadcast(value)


def download_small(df: DataFrame, most: int = 10_000) -> list:
    return fetch(df, most)


def evaluate(spark: SparkSession, source: str, **tables: DataFrame) -> DataFrame:
    """A SQL text over the given frames."""
    return spark.sql(source, **tables)


def compile_only(df: DataFrame) -> str:
    """The physical plan, without running anything."""
    return df._jdf.queryExecution().executedPlan().toString()


def inline(spark: SparkSession, name: str, parameters: str, kind: str, body: str) -> Callable[..., Column]:
    """A function from SQL source, compiled into the plan with what calls it: inline(s, "f", "x double, y int", "double", "x * y + 1")."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return lambda *columns: F.call_function(name, *columns)


#: Python types and how their values become columns.
MAPPINGS: dict[type, Callable[[object], Column]] = {}


def mapping(kind: type, f: Callable[[object], Column]) -> None:
    """Values of a type (and of its subtypes) stand for f(value) in lower()."""
    MAPPINGS[kind] = f


def lower(value: object) -> Column:
    """A value as a column: by the mapping of its nearest type, sequences and dictionaries by their parts, others as literals."""
    for t in type(value).__mro__:
        if t in MAPPINGS:
            return MAPPINGS[t](value)
    if isinstance(value, (list, tuple)):
        return F.array(*map(lower, value))
    if isinstance(value, dict):
        return F.create_map(*(x for k, v in value.items() for x in (lower(k), lower(v))))
    return F.lit(value)


def local(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys side by side in one task each, so that what follows by those keys moves nothing."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def paged(df: DataFrame, rows: int) -> DataFrame:
    """In partitions of about `rows` rows."""
    return df.repartition(max(1, -(-df.count() // rows)))
