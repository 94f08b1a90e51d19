"""Scalar mathematics: built-in expressions where there are any, Arrow-batched functions for the rest."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from stratalith.functions.special import FUNCTIONS, ibeta


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def floor_div(a: Column, b: Column) -> Column:
    return F.floor(a / b)


def floor_mod(a: Column, b: Column) -> Column:
    """With the divisor's sign."""
    return a - F.floor(a / b) * b


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_base(b: float, c: Column) -> Column:
    return F.log(c) / math.log(b)


def asinh(c: Column) -> Column:
    return F.asinh(c)


def acot(c: Column) -> Column:
    return F.atan(1 / c)


def asec(c: Column) -> Column:
    return F.acos(1 / c)


def acsc(c: Column) -> Column:
    return F.asin(1 / c)


def coth(c: Column) -> Column:
    return 1 / F.tanh(c)


def sech(c: Column) -> Column:
    return 1 / F.cosh(c)


def csch(c: Column) -> Column:
    return 1 / F.sinh(c)


def acoth(c: Column) -> Column:
    return F.atanh(1 / c)


def asech(c: Column) -> Column:
    return F.acosh(1 / c)


def acsch(c: Column) -> Column:
    return F.asinh(1 / c)


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm; 93 steps are enough for any two longs."""
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, 1).otherwise(s["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["x"])


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, 0).otherwise(F.abs(a * b) / g).cast("long")


def combination(n: Column, k: Column) -> Column:
    return F.round(F.aggregate(F.filter(F.sequence(F.lit(0), k), lambda i: i < k), F.lit(1.0), lambda s, i: s * (n - i) / (i + 1)))


# ---------------------------------------------------------------- special functions

SPECIAL = FUNCTIONS
#: Values that a task keeps of a function; with more, it begins anew.
KEPT = 1 << 14


def once(f: Callable[..., np.ndarray], *x: np.ndarray, known: dict[tuple, float] | None = None) -> np.ndarray:
    """f by elements, asked once for arguments that come again, bit by bit, and not for those in `known`, which takes the new ones; as they are where most come once."""
    x = [np.ascontiguousarray(v, float) for v in x]
    n = x[0].size
    row = np.zeros(n, np.int64)
    for bits in (v.view(np.int64) for v in x):
        if (bits != bits[0]).any():
            at = np.unique(bits, return_inverse=True)[1]
            row = np.unique(row * n + at, return_inverse=True)[1] if row.any() else at
    some = np.empty(row.max() + 1, np.int64)
    if 2 * some.size > n:
        return f(*x)
    some[row] = np.arange(n)
    x = [v[some] for v in x]
    if known is None:
        return np.asarray(f(*x))[row]
    keys = list(zip(*(v.view(np.int64).tolist() for v in x)))
    new = np.array([k not in known for k in keys])
    out = np.array([known.get(k, np.nan) for k in keys])
    if new.any():
        out[new] = f(*(v[new] for v in x))
        if len(known) + np.count_nonzero(new) > KEPT:
            known.clear()
        known.update((keys[i], float(out[i])) for i in np.flatnonzero(new)[:KEPT])
    return out[row]


def special(name: str, *columns: Column) -> Column:
    """A function of SPECIAL over columns, an Arrow batch at a time; null where an argument is null or outside the domain."""
    f, known = SPECIAL[name], {}  # a task unpickles its own

    @F.pandas_udf("double")
    def run(table: pd.DataFrame) -> pd.Series:
        out = once(f, *(table[c].to_numpy(float) for c in table), known=known) if len(table) else np.zeros(0)
        return pd.Series(np.where(table.isna().any(axis=1), np.nan, out)).where(lambda x: x.notna(), None).astype("Float64")

    return run(F.struct(*(c.cast("double").alias(f"a{i}") for i, c in enumerate(columns))))


def trapz(y: np.ndarray, x: np.ndarray) -> float:
    y, x = np.asarray(y, float), np.asarray(x, float)
    return float(((y[1:] + y[:-1]) * np.diff(x) / 2).sum())


def quad(f, a: float, b: float, tol: float = 1e-10) -> float:
    """Adaptive Simpson's rule."""

    def go(a, fa, b, fb, m, fm, whole, tol, depth):
        l, r = (a + m) / 2, (m + b) / 2
        fl, fr = f(l), f(r)
        left, right = (m - a) / 6 * (fa + 4 * fl + fm), (b - m) / 6 * (fm + 4 * fr + fb)
        if depth > 50 or abs(left + right - whole) <= 15 * tol:
            return left + right + (left + right - whole) / 15
        return go(a, fa, m, fm, l, fl, left, tol / 2, depth + 1) + go(m, fm, b, fb, r, fr, right, tol / 2, depth + 1)

    m = (a + b) / 2
    fa, fb, fm = f(a), f(b), f(m)
    return go(a, fa, b, fb, m, fm, (b - a) / 6 * (fa + 4 * fm + fb), tol, 0)


def integral(f: Callable[[Column], Column], upper: Column, lower: Column | float = 0.0, steps: int = 64) -> Column:
    """Integral of a column function between two columns, by Simpson's rule with an even number of steps."""
    lo = lower if isinstance(lower, Column) else F.lit(float(lower))
    h = (upper - lo) / steps
    weight = lambda i: F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda s, i: s + weight(i) * f(lo + i * h)) * h / 3


def t_quantile(p: float, freedom: float) -> float:
    """Of Student's distribution: its distribution function is inverted by bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, freedom)
    below = lambda t: 1 - 0.5 * float(ibeta(freedom / 2, 0.5, freedom / (freedom + t * t)))
    top = 1.0
    while below(top) < p:
        top *= 2
    lo, hi = 0.0, top
    for _ in range(100):
        lo, hi = ((lo + hi) / 2, hi) if below((lo + hi) / 2) < p else (lo, (lo + hi) / 2)
    return hi
