"""Descriptive statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from stratalith.operators.order import cumsum, rank
from stratalith.plans.session import cut


def harmonic_mean(c: Column) -> Column:
    return F.count(c) / F.sum(1 / c)


def summary(df: DataFrame, value: str) -> DataFrame:
    """mean, sd, min, q1, median, q3, max; counts of categories for strings."""
    if dict(df.dtypes)[value] == "string":
        return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(value)
    return describe(df, value).drop("column")


def quantiles(df: DataFrame, value: str, at: list[float]) -> DataFrame:
    """p and q for each p of `at`, by linear interpolation at p (n - 1).

    Exact through counts of distinct values and their running sum over ranges of
    values, so no task holds all of them; the largest that fits is one row a p.
    """
    if any(not 0 <= p <= 1 for p in at):
        raise ValueError("a quantile is outside [0, 1]")
    g = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    c = cut(cumsum(g, "_n", "_v", name="_hi"))
    n = c.agg(F.max("_hi")).first()[0]
    if not n:
        return df.sparkSession.createDataFrame([(float(p), None) for p in at], "p double, q double")
    places = [(float(p), p * (n - 1)) for p in at]
    asked = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(k).alias("k"), F.lit(x - int(x)).alias("part")) for p, x in places for k in (int(x), min(int(x) + 1, n - 1)))))
    near = c.select("_v", "_hi", "_n", asked.alias("a")).where((F.col("a.k") < F.col("_hi")) & (F.col("a.k") >= F.col("_hi") - F.col("_n")))
    lo, hi = F.min(F.col("_v").cast("double")), F.max(F.col("_v").cast("double"))
    return near.groupBy(F.col("a.p").alias("p"), F.col("a.part").alias("f")).agg(lo.alias("lo"), hi.alias("hi")).select("p", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("f")).alias("q"))


def quantiles_from_histogram(counts: DataFrame, value: str, at: list[float], n: str = "n") -> DataFrame:
    """p and q: the first value up to which at least the share p of the counts lies."""
    c = cumsum(counts.select(value, n), n, value, name="_hi")
    total = counts.agg(F.sum(n)).first()[0]
    asked = F.explode(F.array(*map(F.lit, at)))
    return c.select(value, "_hi", asked.alias("p")).where(F.col("_hi") / F.lit(total) >= F.col("p")).groupBy("p").agg(F.min(value).alias("q"))


def describe(df: DataFrame, *columns: str) -> DataFrame:
    """column, mean, sd, min, q1, median, q3, max of each numeric column."""
    out = None
    for c in columns:
        q = quantiles(df, c, [0.25, 0.5, 0.75]).agg(*(F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))))
        one = df.agg(F.lit(c).alias("column"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).join(q)
        one = one.select("column", "mean", "sd", "min", "q1", "median", "q3", "max")
        out = one if out is None else out.unionByName(one)
    return out


def kendall_tau(df: DataFrame, a: str, b: str, most: int = 20_000) -> DataFrame:
    """tau: tau-a of two columns, for at most `most` rows (the definition is quadratic)."""
    rows = df.select(a, b).limit(most + 1).collect()
    return df.sparkSession.createDataFrame([(kendall([r[0] for r in rows], [r[1] for r in rows]),)], "tau double")


def quantile(value: str, q: float) -> Column:
    """Linear interpolation at q (n - 1), as an aggregate: for groups whose values fit in a task; else quantiles()."""
    if not 0 <= q <= 1:
        raise ValueError("q is outside [0, 1]")
    return F.percentile(value, F.lit(q))


def estimate_five(df: DataFrame, value: str, buckets: int = 10_000) -> DataFrame:
    """min, q1, median, q3, max from an equi-width histogram: at most `buckets` counts are ordered."""
    lo, hi, n = df.agg(F.min(value), F.max(value), F.count(value)).first()
    if not n:
        return df.agg(*(F.lit(None).cast("double").alias(c) for c in ("min", "q1", "median", "q3", "max")))
    width = (hi - lo) / buckets or 1.0
    b = F.least(F.floor((F.col(value) - lo) / F.lit(width)), F.lit(buckets - 1))
    counts = sorted(df.where(F.col(value).isNotNull()).groupBy(b.alias("b")).agg(F.count("*").alias("n")).collect())
    out, seen = {}, 0
    for k, m in counts:
        seen += m
        for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            if name not in out and seen >= q * n:
                out[name] = lo + (k + 0.5) * width
    return df.sparkSession.createDataFrame([(float(lo), out["q1"], out["median"], out["q3"], float(hi))], "min double, q1 double, median double, q3 double, max double")


def histogram(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(value)


def mode(df: DataFrame, value: str) -> DataFrame:
    """The most frequent value (of several the least) and its count."""
    return df.groupBy(F.col(value).alias("mode")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "mode").limit(1)


def additive_histogram(value: Column, lo: float, hi: float, bins: int) -> Column:
    """Bucket of a mergeable fixed-range histogram; what lies outside goes to the edge buckets."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((value - lo) / ((hi - lo) / bins)))).cast("int")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation of average ranks."""
    return rank(rank(df, a, name="_ra"), b, name="_rb").agg(F.corr("_ra", "_rb").alias("spearman"))


def kendall(a, b) -> float:
    """tau-a of two short vectors (quadratic, as its definition; for at most 20,000 values)."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    n = len(a)
    if n != len(b) or n > 20_000:
        raise ValueError("two vectors of one length, at most 20,000, are needed")
    s = sum(float((np.sign(a[i] - a[i + 1 :]) * np.sign(b[i] - b[i + 1 :])).sum()) for i in range(n - 1))
    return s / (n * (n - 1) / 2) if n > 1 else math.nan
