"""Grouping, user reductions, distinct values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F


def group_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct().orderBy(*keys)


def get_group(df: DataFrame, key: dict) -> DataFrame:
    """Rows of one key; an unknown key is an error."""
    out = df
    for c, v in key.items():
        out = out.where(F.col(c).eqNullSafe(F.lit(v)))
    if out.isEmpty():
        raise KeyError(str(key))
    return out


def reduce_groups(df: DataFrame, group: Column, seed: Callable[[Column], Column], merge: Callable[[Column], Column], name: str = "value") -> DataFrame:
    """seed makes a row's value, merge is the aggregate that joins two; combined before the shuffle."""
    return df.groupBy(group.alias("group")).agg(merge(seed(F.struct("*"))).alias(name))


def flat_map(df: DataFrame, f: Callable[[Column], Column], value: str, name: str = "value") -> DataFrame:
    return df.select(F.explode(f(F.col(value))).alias(name))


def unique(df: DataFrame, value: str) -> DataFrame:
    return df.select(value).distinct().orderBy(value)


def count_distinct(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.count_distinct(value).alias("count_distinct"))


def filter_consecutive(df: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    """Without repeats of the value before, along the order within `by`."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_b", F.lag(F.struct(value)).over(w)).where(F.col("_b").isNull() | ~F.col(value).eqNullSafe(F.col("_b")[value])).drop("_b")


def arg_max(df: DataFrame, value: str, index: str) -> Column:
    """Smallest index of the largest value."""
    return F.max(F.struct(F.col(value), -F.col(index)))
