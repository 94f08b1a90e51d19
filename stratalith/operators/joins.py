"""Equi-joins with a fixed output contract, positional gather, as-of lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stratalith.operators.order import ranged

HOWS = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def join(left: DataFrame, right: DataFrame, on: str, how: str = "left", left_suffix: str = "", right_suffix: str = "", ordered: bool = True) -> DataFrame:
    """Left columns, right columns, the key last; sorted by key. A suffix goes on all non-key columns of its side.

    Null keys match nothing. Names have to be different in the end.
    """
    l = [(c, c + left_suffix) for c in left.columns if c != on]
    r = [(c, c + right_suffix) for c in right.columns if c != on]
    names = [n for _, n in l + r]
    if len(set(names)) < len(names):
        raise ValueError("columns of equal name; give a suffix")
    both = left.alias("l").join(right.alias("r"), F.col(f"l.{on}") == F.col(f"r.{on}"), HOWS[how])
    out = both.select(*(F.col(f"l.{c}").alias(n) for c, n in l), *(F.col(f"r.{c}").alias(n) for c, n in r), F.coalesce(f"l.{on}", f"r.{on}").alias(on))
    return out.orderBy(on) if ordered else out


def take(elements: DataFrame, indices: DataFrame, ix: str = "ix", index: str = "index") -> DataFrame:
    """For each index the element of that position; null for a bad one."""
    return indices.join(elements.withColumnRenamed(ix, index), index, "left")


def as_of(samples: DataFrame, times: DataFrame, t: str, value: str, by: list[str] | None = None, at: str = "at") -> DataFrame:
    """The value in force at each time (`at`), null before the first: a union by time and a forward fill."""
    by = by or []
    a = samples.select(*by, F.col(t).alias("_t"), F.col(value).alias("_x"), F.lit(0).alias("_q"))
    b = times.select(*by, F.col(at).alias("_t"), F.lit(None).cast(samples.schema[value].dataType).alias("_x"), F.lit(1).alias("_q"))
    u = a.unionByName(b)
    if by:
        w = Window.partitionBy(*by).orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0)
        u = u.withColumn("_x", F.last("_x", ignorenulls=True).over(w))
    else:  # one order for all: by ranges of time, with the value that holds at each range's beginning
        u = ranged(u, [F.col("_t"), F.col("_q")])
        ends = sorted(u.where("_x is not null").groupBy("_p").agg(F.max(F.struct("_r", "_x"))["_x"].alias("x")).collect(), key=lambda r: r._p)
        carry = [F.lit(None).cast(samples.schema[value].dataType)]
        for r in reversed(ends):
            carry.append(F.when(F.col("_p") > r._p, F.lit(r.x)))
        w = Window.partitionBy("_p").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
        u = u.withColumn("_x", F.coalesce(F.last("_x", ignorenulls=True).over(w), *carry[1:], carry[0]))
    return u.where("_q = 1").select(*by, F.col("_t").alias(at), F.col("_x").alias(value))


def bounds(df: DataFrame, value: str, probe) -> DataFrame:
    """One row: first position at or above the probe (lower), first above it (upper), in value order."""
    return df.agg(F.count(F.when(F.col(value) < probe, 1)).alias("lower"), F.count(F.when(F.col(value) <= probe, 1)).alias("upper"))
