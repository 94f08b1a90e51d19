"""Operators that depend on row order: row numbers, running sums, ranks, sorts, top-k.

A global order never goes through one task: rows are range partitioned, and
what a partition needs to know of those before it is one number each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalith.plans.session import cut


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df range partitioned and sorted, cut off, with the partition's number _p and a rising row number _r."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_r", F.monotonically_increasing_id()))


def _before(df: DataFrame, what: Column, zero) -> Column:
    """Sum of `what` over the partitions before; one row a partition comes to the driver."""
    total, out = zero, [F.lit(None), F.lit(zero)]
    for p, x in sorted(df.groupBy("_p").agg(what).collect()):
        out += [F.lit(p), F.lit(total)]
        total = total + (x or zero)
    return F.element_at(F.create_map(*out[2:]), F.col("_p")) if len(out) > 2 else F.lit(zero)


def with_index(df: DataFrame, *order: Column | str, name: str = "ix") -> DataFrame:
    """df with the position of each row (from 0) in the given order, which has to be total."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    d = ranged(df, order)
    w = Window.partitionBy("_p").orderBy("_r")
    return d.withColumn(name, F.row_number().over(w) - 1 + _before(d, F.count("*"), 0)).drop("_p", "_r")


def cumsum(df: DataFrame, value: str, *order: Column | str, start=0, name: str = "cumsum") -> DataFrame:
    """df with the running sum of `value` in the given order, from `start`; nulls add nothing."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    d = ranged(df, order)
    kind = df.schema[value].dataType.typeName()
    zero = 0.0 if kind in ("double", "float") else 0
    w = Window.partitionBy("_p").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(zero)) + _before(d, F.sum(value), zero) + F.lit(start)).drop("_p", "_r")


def cumsums(df: DataFrame, values: list[str], *order: Column | str) -> DataFrame:
    """df with the running sum of each of the values, as double columns of the name with a leading underscore."""
    d = ranged(df, [F.col(c) if isinstance(c, str) else c for c in order])
    w = Window.partitionBy("_p").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    ends = {r._p: r for r in d.groupBy("_p").agg(*(F.sum(v).cast("double").alias(v) for v in values)).collect()}
    for v in values:
        total, at = 0.0, [F.lit(-1), F.lit(0.0)]
        for p in sorted(ends):
            at += [F.lit(p), F.lit(total)]
            total += ends[p][v] or 0.0
        d = d.withColumn(f"_{v}", F.coalesce(F.sum(v).over(w).cast("double"), F.lit(0.0)) + F.element_at(F.create_map(*at), F.col("_p")))
    return d.drop("_p", "_r")


def rank(df: DataFrame, value: str, ties: str = "average", reverse: bool = False, name: str = "rank") -> DataFrame:
    """Ranks from 1 with ties by average, min or max. Works on distinct values, so ties are no burden."""
    if ties not in ("average", "min", "max"):
        raise ValueError("ties: average, min or max")
    g = df.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    c = cumsum(g, "_n", F.desc("_v") if reverse else F.asc("_v"), name="_hi")
    low, high = F.col("_hi") - F.col("_n") + 1, F.col("_hi")
    r = {"min": low, "max": high, "average": (low + high) / 2}[ties]
    return df.join(c.select("_v", r.cast("double").alias(name)), F.col(value).eqNullSafe(F.col("_v"))).drop("_v")


def sort(df: DataFrame, *columns: str, descending: bool = False) -> DataFrame:
    return df.orderBy(*(F.desc(c) if descending else F.asc(c) for c in columns))


def is_sorted(df: DataFrame, value: str, *order: str) -> DataFrame:
    """One row, is_sorted: whether value never falls along the order."""
    d = with_index(df, *order)
    nxt = d.select((F.col("ix") - 1).alias("_j"), F.col(value).alias("_next"))
    return d.join(nxt, d.ix == nxt._j).agg((F.count(F.when(F.col(value) > F.col("_next"), 1)) == 0).alias("is_sorted"))


def n_smallest(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """The n first rows in order: each task keeps n, and those are merged."""
    return df.orderBy(*columns).limit(n)


def n_largest(df: DataFrame, n: int, *columns: str) -> DataFrame:
    return df.orderBy(*(F.desc(c) for c in columns)).limit(n)


def quick_select(df: DataFrame, value: str, k: int) -> DataFrame:
    """One row: the k-th smallest value (k from 0), through counts of distinct values."""
    c = cumsum(df.groupBy(value).agg(F.count("*").alias("_n")), "_n", value, name="_hi")
    return c.where((F.col("_hi") > k) & (F.col("_hi") - F.col("_n") <= k)).select(value)
