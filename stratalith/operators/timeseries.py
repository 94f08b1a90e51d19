"""Step functions of time: rows (series, t, x), a value holds until the next."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from stratalith.operators.order import ranged
from stratalith.plans.session import cut


def from_rows(df: DataFrame, by: str, t: str, x: str, check: bool = True) -> DataFrame:
    """series, t (double seconds), x; times have to rise strictly within a series."""
    out = df.select(F.col(by).alias("series"), F.col(t).cast("double").alias("t"), F.col(x).cast("double").alias("x"))
    if check and not out.groupBy("series", "t").count().where("count > 1").isEmpty():
        raise ValueError("times must rise strictly")
    return out


def ema(ts: DataFrame, decay: float) -> DataFrame:
    """Exponential moving average in continuous time: the first value, then (1 - r) x_prev + r ema_prev, r = exp(-dt decay).

    Series are range partitioned by (series, t), so a long one lies in several
    partitions. What a piece makes of the average before it is a linear function:
    a first pass gives that for each partition's last series, the driver chains
    them (one row a partition), and a second pass runs from the true starts.
    """
    kind = dict(ts.dtypes)["series"]
    d = ranged(ts.select("series", "t", "x"), [F.col("series"), F.col("t")])

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for b in batches:
            for start, end in runs(b["series"]):
                yield b["_p"].iloc[start], b["series"].iloc[start], b["t"].to_numpy()[start:end], b["x"].to_numpy()[start:end]

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the last series of the partition: ema at its end = a * ema at its beginning + c, and whether it is the only one
        p = one = None
        first = True
        for p, name, t, x in pieces(batches):
            if one is None or name != one[0]:
                first = one is None
                one = [name, t[0], x[0], t[0], x[0], 1.0, 0.0]
                t, x = t[1:], x[1:]
            for u, v in zip(t.tolist(), x.tolist()):
                r = math.exp(-(u - one[3]) * decay)
                one[5], one[6] = r * one[5], (1 - r) * one[4] + r * one[6]
                one[3], one[4] = u, v
        if one is not None:
            yield pd.DataFrame([(p, *one, first)], columns=["_p", "series", "t0", "x0", "t1", "x1", "a", "c", "only"])

    rows = sorted(d.mapInPandas(ends, f"_p int, series {kind}, t0 double, x0 double, t1 double, x1 double, a double, c double, only boolean").collect())
    state, begin = None, {}
    for r in rows:
        begin[r._p] = state  # series, t, x, ema at the end of what lies before
        going = r.only and state is not None and state[0] == r.series
        at = (1 - math.exp(-(r.t0 - state[1]) * decay)) * state[2] + math.exp(-(r.t0 - state[1]) * decay) * state[3] if going else r.x0
        state = (r.series, r.t1, r.x1, r.a * at + r.c)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, new = None, True
        for p, name, t, x in pieces(batches):
            if new:
                now, new = begin.get(p), False
            out = []
            for u, v in zip(t.tolist(), x.tolist()):
                if now is None or now[0] != name:
                    e = v
                else:
                    r = math.exp(-(u - now[1]) * decay)
                    e = (1 - r) * now[2] + r * now[3]
                now = (name, u, v, e)
                out.append(e)
            yield pd.DataFrame({"series": name, "t": t, "ema": out})

    return d.mapInPandas(run, f"series {kind}, t double, ema double")


def runs(keys: pd.Series) -> list[tuple[int, int]]:
    """[start, end) of equal neighbours."""
    if not len(keys):
        return []
    cuts = [0, *np.flatnonzero((keys != keys.shift()).to_numpy()[1:] & ~(keys.isna() & keys.shift().isna()).to_numpy()[1:]) + 1, len(keys)]
    return list(zip(cuts, cuts[1:]))


def lag(ts: DataFrame, by: float) -> DataFrame:
    return ts.withColumn("t", F.col("t") + F.lit(by))


def pairwise(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both series' values (xa, xb) at the union of their times, from the later start on."""
    u = a.select("series", "t", F.col("x").alias("xa"), F.lit(None).cast("double").alias("xb")).unionByName(b.select("series", "t", F.lit(None).cast("double").alias("xa"), F.col("x").alias("xb")))
    u = u.groupBy("series", "t").agg(F.max("xa").alias("xa"), F.max("xb").alias("xb"))
    w = Window.partitionBy("series").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return u.select("series", "t", *(F.last(c, ignorenulls=True).over(w).alias(c) for c in ("xa", "xb"))).where("xa is not null and xb is not null")


def resampled(ts: DataFrame) -> DataFrame:
    """The series as values: written out and cut off from how it was made."""
    return cut(ts)


def coiterate(df: DataFrame, by: str, order: str, f: Callable[[Iterator[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """f, a generator over the rows of one series in order that keeps state of its own, run for each series.

    A series is read a batch at a time within its partition, so its rows need not
    fit in memory; f is a new generator for each.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in b.to_dict("records"))
        out = []
        for _, one in groupby(rows, key=lambda r: r[by]):
            for t in f(one):
                out.append(t)
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return df.repartition(by).sortWithinPartitions(by, order).mapInPandas(run, schema)
