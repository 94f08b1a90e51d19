"""Seeded draws as columns: a uniform column from the row's id, and inverse or composed distributions of it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def uniform(key: Column, seed: int = 0) -> Column:
    """In (0, 1), the same for a key wherever the row is."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + 0.5) / float(1 << 53)


def normal(key: Column, mean: float = 0.0, sd: float = 1.0, seed: int = 0) -> Column:
    """Box and Muller."""
    return mean + sd * F.sqrt(-2 * F.log(uniform(key, seed))) * F.cos(2 * math.pi * uniform(key, seed + 7919))


def exponential(key: Column, rate: float = 1.0, seed: int = 0) -> Column:
    return -F.log(uniform(key, seed)) / rate


def cauchy(key: Column, place: float = 0.0, scale: float = 1.0, seed: int = 0) -> Column:
    return place + scale * F.tan(math.pi * (uniform(key, seed) - 0.5))


def logistic(key: Column, place: float = 0.0, scale: float = 1.0, seed: int = 0) -> Column:
    u = uniform(key, seed)
    return place + scale * F.log(u / (1 - u))


def weibull(key: Column, shape: float, scale: float = 1.0, seed: int = 0) -> Column:
    return scale * F.pow(-F.log(uniform(key, seed)), F.lit(1 / shape))


def extreme_value(key: Column, place: float = 0.0, scale: float = 1.0, seed: int = 0) -> Column:
    return place - scale * F.log(-F.log(uniform(key, seed)))


def rayleigh(key: Column, sigma: float = 1.0, seed: int = 0) -> Column:
    return sigma * F.sqrt(-2 * F.log(uniform(key, seed)))


def log_normal(key: Column, mean: float = 0.0, sd: float = 1.0, seed: int = 0) -> Column:
    return F.exp(normal(key, mean, sd, seed))


def triangular(key: Column, lo: float, mode: float, hi: float, seed: int = 0) -> Column:
    u, c = uniform(key, seed), (mode - lo) / (hi - lo)
    return F.when(u < c, lo + F.sqrt(u * (hi - lo) * (mode - lo))).otherwise(hi - F.sqrt((1 - u) * (hi - lo) * (hi - mode)))


def geometric(key: Column, p: float, seed: int = 0) -> Column:
    return F.floor(F.log(uniform(key, seed)) / math.log(1 - p)).cast("long")


def chi_squared(key: Column, n: int, seed: int = 0) -> Column:
    return sum((F.pow(normal(key, seed=seed + 104729 * (i + 1)), F.lit(2.0)) for i in range(n)), F.lit(0.0))


def student_t(key: Column, n: int, seed: int = 0) -> Column:
    return normal(key, seed=seed) / F.sqrt(chi_squared(key, n, seed + 1) / n)


def binomial(key: Column, n: int, p: float, seed: int = 0) -> Column:
    return sum((F.when(uniform(key, seed + 1299709 * (i + 1)) < p, 1).otherwise(0) for i in range(n)), F.lit(0))


def f_ratio(key: Column, n: int, m: int, seed: int = 0) -> Column:
    return (chi_squared(key, n, seed) / n) / (chi_squared(key, m, seed + 15485863) / m)


def uniform_real(key: Column, lo: float, hi: float, seed: int = 0) -> Column:
    return lo + (hi - lo) * uniform(key, seed)


def inverse_chi_squared(key: Column, n: int, seed: int = 0) -> Column:
    return 1 / chi_squared(key, n, seed)


def scaled_inverse_chi_squared(key: Column, n: int, scale: float, seed: int = 0) -> Column:
    return n * scale / chi_squared(key, n, seed)


#: Distributions that numpy draws: its name, or a function of a generator, parameters and size.
_NUMPY = {
    "beta": "beta", "gamma": "gamma", "poisson": "poisson", "f": "f", "hypergeometric": "hypergeometric", "negative_binomial": "negative_binomial", "noncentral_chi_squared": "noncentral_chisquare", "inverse_gaussian": "wald",
    "inverse_gamma": lambda g, size, shape, scale=1.0: 1 / g.gamma(shape, scale, size),
}
#: Keys that share a generator: each takes its own place in what it draws.
BLOCK = 256


def draw(kind: str, key: Column, *parameters: float, seed: int = 0) -> Column:
    """Other distributions, the same for a key wherever its row is.

    A generator is seeded with (seed, block of BLOCK keys) and draws the whole
    block at once; keys that follow one another, as row numbers do, share it. A
    null key has no draw.
    """
    how = _NUMPY[kind]

    @F.pandas_udf("double")
    def run(keys: pd.Series) -> pd.Series:
        out, known = np.full(len(keys), np.nan), keys.notna().to_numpy()
        k = keys[known].to_numpy().astype(np.int64).view(np.uint64)
        blocks, inverse = np.unique(k // np.uint64(BLOCK), return_inverse=True)
        drawn = np.empty((len(blocks), BLOCK))
        for i, b in enumerate(blocks.tolist()):
            g = np.random.default_rng([seed, b])
            drawn[i] = how(g, BLOCK, *parameters) if callable(how) else getattr(g, how)(*parameters, size=BLOCK)
        out[known] = drawn[inverse, (k % np.uint64(BLOCK)).astype(np.int64)]
        return pd.Series(out).where(known)

    return run(key.cast("long"))


class MersenneTwister:
    """The classic generator of numpy's RandomState, for draws in sequence on the driver or in a task."""

    def __init__(self, seed: int = 0):
        self.state = np.random.RandomState(seed)

    def uint32(self, n: int) -> np.ndarray:
        return self.state.randint(0, 2**32, n, dtype=np.uint32)

    def rand(self, *shape: int) -> np.ndarray:
        return self.state.rand(*shape)

    def randn(self, *shape: int) -> np.ndarray:
        return self.state.randn(*shape)

    def uniform(self, lo: float = 0.0, hi: float = 1.0, size=None):
        return self.state.uniform(lo, hi, size)


def multiply_with_carry(seed: int, n: int, a: int = 4294957665, carry: int = 362436) -> list[int]:
    """n words of the lag-1 generator x = a x + c, the carry c being the high word."""
    x, c, out = seed & 0xFFFFFFFF, carry, []
    for _ in range(n):
        t = a * x + c
        x, c = t & 0xFFFFFFFF, t >> 32
        out.append(x)
    return out
