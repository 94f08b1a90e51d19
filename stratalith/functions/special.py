"""Special functions over numpy arrays, in double precision; nan outside the domain.

Series, continued fractions and inverses run over all elements side by side; those
that have converged are set aside, so each costs what it needs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

TINY, EPS, MOST = 1e-300, 1e-16, 10_000
#: A factor of a continued fraction that is as close to 1 has no more digits to give; rounding alone makes it 2 to 4e-16.
ROUND = 1e-15
#: Coefficients of Stirling's series, B(2k) / (2k (2k - 1)).
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)


def _arrays(*x) -> list[np.ndarray]:
    return [np.array(v, float) for v in np.broadcast_arrays(*x)]


def _converge(step: Callable[..., tuple[list[np.ndarray], np.ndarray]], state: list[np.ndarray], most: int = MOST) -> np.ndarray:
    """state[0] when all is converged. step(i, *state): the new state, and what still moves (what is nan doesn't); the rest is set aside, in halves."""
    out, at = np.empty_like(state[0]), np.arange(state[0].size)
    for i in range(1, most):
        state, moving = step(i, *state)
        left = np.count_nonzero(moving)
        if left <= at.size // 2:
            still = ~moving
            out[at[still]] = state[0][still]
            at, state = at[moving], [v[moving] for v in state]
        if not left:
            break
    out[at] = state[0]
    return out


def lgamma(x) -> np.ndarray:
    """Log of the absolute value of gamma: Stirling's series above 10, the recurrence below, reflection below 0."""
    (x,) = _arrays(x)
    out, low = np.full_like(x, np.nan), x <= 0
    z, shift = np.where(low, 1 - x, x), np.zeros_like(x)
    for _ in range(10):
        small = z < 10
        shift = np.where(small, shift + np.log(np.where(small, z, 1.0)), shift)
        z = np.where(small, z + 1, z)
    s, w = np.zeros_like(z), 1 / z
    for c in reversed(_STIRLING):
        s = s * w * w + c
    big = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + s * w - shift
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(low, np.log(np.pi / np.abs(np.sin(np.pi * x))) - big, big)
    return np.where(low & (x == np.floor(x)), np.inf, out)


def tgamma(x) -> np.ndarray:
    (x,) = _arrays(x)
    sign = np.where((x < 0) & (np.floor(x) % 2 != 0), -1.0, 1.0)
    out = sign * np.exp(lgamma(x))
    whole = (x > 0) & (x == np.floor(x)) & (x < 23)  # factorials exactly
    facts = np.cumprod(np.concatenate([[1.0], np.arange(1.0, 23.0)]))
    out = np.where(whole, facts[np.clip(np.where(whole, x, 1.0) - 1, 0, 22).astype(int)], out)
    return np.where((x <= 0) & (x == np.floor(x)), np.nan, out)


def digamma(x) -> np.ndarray:
    (x,) = _arrays(x)
    low = x <= 0
    z, out = np.where(low, 1 - x, x), np.zeros_like(x)
    for _ in range(10):
        small = z < 10
        out = np.where(small, out - 1 / z, out)
        z = np.where(small, z + 1, z)
    y = 1 / (z * z)
    out = out + np.log(z) - 0.5 / z - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(low, out - np.pi / np.tan(np.pi * x), out)
    return np.where(low & (x == np.floor(x)), np.nan, out)


def _gamma_series(n, total, term, a, x):
    term = term * x / (a + n)
    total = total + term
    return [total, term, a, x], np.abs(term) > np.abs(total) * EPS


def _gamma_fraction(i, h, d, c, b, a):
    an = -i * (i - a)
    b = b + 2
    d = an * d + b
    d = 1 / np.where(d == 0, TINY, d)
    c = b + an / c
    c = np.where(c == 0, TINY, c)
    return [h * d * c, d, c, b, a], np.abs(d * c - 1) > ROUND


def _gamma_parts(a, x) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper regularised incomplete gamma, each by what keeps its digits: a series, or a continued fraction (Lentz)."""
    a, x = _arrays(a, x)
    bad = ~((a > 0) & (x >= 0))
    a, x = np.where(bad, 1.0, a), np.where(bad, 1.0, x)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore", under="ignore"):
        front = np.where(x > 0, np.exp(-x + a * np.log(np.where(x > 0, x, 1.0)) - lgamma(a)), 0.0)
        low = x < a + 1
        p, q = np.zeros_like(a), np.zeros_like(a)
        p[low] = front[low] * _converge(_gamma_series, [1 / a[low], 1 / a[low], a[low], x[low]])
        u, z = a[~low], x[~low]
        d = 1 / (z + 1 - u)
        q[~low] = front[~low] * _converge(_gamma_fraction, [d, d, np.full_like(u, 1 / TINY), z + 1 - u, u])
    p, q = np.where(low, p, 1 - q), np.where(low, 1 - p, q)
    infinite = np.isinf(x)
    return np.where(bad, np.nan, np.where(infinite, 1.0, p)), np.where(bad, np.nan, np.where(infinite, 0.0, q))


def gamma_p(a, x) -> np.ndarray:
    return _gamma_parts(a, x)[0]


def gamma_q(a, x) -> np.ndarray:
    return _gamma_parts(a, x)[1]


def erf(x) -> np.ndarray:
    (x,) = _arrays(x)
    return np.sign(x) * gamma_p(0.5, x * x)


def erfc(x) -> np.ndarray:
    (x,) = _arrays(x)
    p, q = _gamma_parts(0.5, x * x)
    return np.where(x >= 0, q, 1 + p)


def lbeta(a, b) -> np.ndarray:
    return lgamma(a) + lgamma(b) - lgamma(np.add(a, b))


def _beta_fraction(m, h, d, c, u, v, x):
    for num in (m * (v - m) * x / ((u + 2 * m - 1) * (u + 2 * m)), -(u + m) * (u + v + m) * x / ((u + 2 * m) * (u + 2 * m + 1))):
        d = 1 + num * d
        d = 1 / np.where(d == 0, TINY, d)
        c = 1 + num / c
        c = np.where(c == 0, TINY, c)
        h = h * c * d
    return [h, d, c, u, v, x], np.abs(c * d - 1) > ROUND


def ibeta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction, from the side where it converges."""
    a, b, x = _arrays(a, b, x)
    bad = ~((a > 0) & (b > 0) & (x >= 0) & (x <= 1))
    a, b, x = (np.where(bad, 0.5, v) for v in (a, b, x))
    turn = x > (a + 1) / (a + b + 2)
    u, v, z = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore", under="ignore"):
        inside = np.where((z > 0) & (z < 1), z, 0.5)
        front = np.exp(u * np.log(inside) + v * np.log1p(-inside) - lbeta(u, v)) / u
        c = np.ones_like(z)
        d = 1 - (u + v) * inside / (u + 1)
        d = 1 / np.where(d == 0, TINY, d)
        h = _converge(_beta_fraction, [v.ravel() for v in (d, d, c, u, v, inside)]).reshape(z.shape)
    out = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * h))
    return np.where(bad, np.nan, np.where(turn, 1 - out, out))


def ibetac(a, b, x) -> np.ndarray:
    return ibeta(b, a, np.subtract(1, x))


def invert(f: Callable[..., np.ndarray], lo, hi, y, *args) -> np.ndarray:
    """Where f(x, *args), which rises from lo to hi in every element, is y; the nearer end where it isn't reached, nan where f is nan.

    Chandrupatla's method (inverse quadratic steps where they are safe, halving
    elsewhere) once the bracket is within a factor of four; before, its ends'
    geometric mean, or the square of the upper one above zero.
    """
    lo, hi, y, *args = _arrays(lo, hi, y, *args)
    shape = y.shape
    lo, hi, y, *args = (v.ravel() for v in (lo, hi, y, *args))
    low, high = f(lo, *args) - y, f(hi, *args) - y
    out = np.where(np.isnan(low) | np.isnan(high), np.nan, np.where(low >= 0, lo, hi))
    live = (low < 0) & (high > 0)
    lo, hi, low, high = lo[live], hi[live], low[live], high[live]
    # x1 is the newest place, x2 the bracket's other end, x3 the place given up last

    def step(_, best, x1, g1, x2, g2, x3, g3, y, *args):
        a, b = np.minimum(x1, x2), np.maximum(x1, x2)
        xi, phi = (x1 - x2) / (x3 - x2), (g1 - g2) / (g3 - g2)
        safe = (phi * phi < xi) & ((1 - phi) * (1 - phi) < 1 - xi)
        t = g1 / (g2 - g1) * g3 / (g2 - g3) + (x3 - x1) / (x2 - x1) * g1 / (g3 - g1) * g2 / (g3 - g2)
        least = 1.2 * EPS * np.abs(best) / (b - a)
        x = x1 + np.clip(np.where(safe, t, 0.5), least, 1 - least) * (x2 - x1)
        x = np.where((a > 0) & (b > 4 * a), np.sqrt(a) * np.sqrt(b), np.where(a == 0, np.maximum(np.where(b < 0.25, b * b, b / 4), TINY), x))
        g = f(x, *args) - y
        same = (g < 0) == (g1 < 0)
        x3, g3 = np.where(same, x1, x2), np.where(same, g1, g2)
        x2, g2 = np.where(same, x2, x1), np.where(same, g2, g1)
        best = np.where(np.abs(g) < np.abs(g2), x, x2)
        return [best, x, g, x2, g2, x3, g3, y, *args], (g != 0) & (np.abs(x2 - x) > 2.5 * EPS * np.abs(best) + TINY)

    with np.errstate(all="ignore"):
        out[live] = _converge(step, [hi, hi, high, lo, low, lo, low, y[live], *(v[live] for v in args)], 300)
    return out.reshape(shape)


def _within(y, out, lo=0.0, hi=1.0) -> np.ndarray:
    (y,) = _arrays(y)
    return np.where((y >= lo) & (y <= hi), out, np.nan)


def erfinv(y) -> np.ndarray:
    (y,) = _arrays(y)
    size = np.abs(y)
    return _within(size, np.sign(y) * np.where(size == 1, np.inf, invert(erf, 0.0, 6.0, size)))


def erfcinv(y) -> np.ndarray:
    """By erfc in its tail, and by erf where 1 - y is exact."""
    (y,) = _arrays(y)
    tail = y < 0.5
    out = erfinv(1 - np.where(tail, 1.0, y))
    out[tail] = np.where(y[tail] == 0, np.inf, invert(lambda x: -erfc(x), 0.4, 27.0, -y[tail]))
    return _within(y, out, 0.0, 2.0)


def _top(a: np.ndarray, short: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """a + 1, doubled until it isn't short any more."""
    hi, at = a + 1, np.arange(a.size)
    for _ in range(60):
        at = at[short(hi.flat[at], at)]
        if not at.size:
            break
        hi.flat[at] *= 2
    return hi


def gamma_p_inv(a, y) -> np.ndarray:
    a, y = _arrays(a, y)
    return _within(y, invert(lambda x, a: gamma_p(a, x), 0.0, _top(a, lambda x, at: gamma_p(a.flat[at], x) < np.minimum(y.flat[at], 1 - EPS)), y, a))


def gamma_q_inv(a, y) -> np.ndarray:
    a, y = _arrays(a, y)
    return _within(y, invert(lambda x, a: -gamma_q(a, x), 0.0, _top(a, lambda x, at: gamma_q(a.flat[at], x) > np.maximum(y.flat[at], TINY)), -y, a))


def gamma_p_inva(x, y) -> np.ndarray:
    x, y = _arrays(x, y)
    return _within(y, invert(lambda a, x: -gamma_p(a, x), 1e-9, 10 * x + 100, -y, x))


def gamma_q_inva(x, y) -> np.ndarray:
    x, y = _arrays(x, y)
    return _within(y, invert(lambda a, x: gamma_q(a, x), 1e-9, 10 * x + 100, y, x))


def ibeta_inv(a, b, y) -> np.ndarray:
    return _within(y, invert(lambda x, a, b: ibeta(a, b, x), 0.0, 1.0, y, a, b))


def ibetac_inv(a, b, y) -> np.ndarray:
    return _within(y, invert(lambda x, a, b: -ibetac(a, b, x), 0.0, 1.0, np.negative(y), a, b))


def ibeta_inva(b, x, y) -> np.ndarray:
    return _within(y, invert(lambda a, b, x: -ibeta(a, b, x), 1e-9, 1e6, np.negative(y), b, x))


def ibetac_inva(b, x, y) -> np.ndarray:
    return _within(y, invert(lambda a, b, x: ibetac(a, b, x), 1e-9, 1e6, y, b, x))


def ibeta_invb(a, x, y) -> np.ndarray:
    return _within(y, invert(lambda b, a, x: ibeta(a, b, x), 1e-9, 1e6, y, a, x))


def ibetac_invb(a, x, y) -> np.ndarray:
    return _within(y, invert(lambda b, a, x: -ibetac(a, b, x), 1e-9, 1e6, np.negative(y), a, x))


def bessel_i(v, x) -> np.ndarray:
    v, x = _arrays(v, x)
    with np.errstate(divide="ignore", invalid="ignore", under="ignore"):
        term = np.where(x > 0, np.exp(v * np.log(np.where(x > 0, x, 1.0) / 2) - lgamma(v + 1)), (v == 0) * 1.0)
        total = term.copy()
        for k in range(1, 2000):
            term = term * (x * x / 4) / (k * (k + v))
            total = total + term
            if (term <= total * EPS).all():
                break
    return np.where(x >= 0, total, np.nan)


def bessel_k(v, x) -> np.ndarray:
    """Integral of exp(-x cosh t) cosh(v t), by the trapezoid rule, which converges geometrically: each element has steps as wide as its digits allow."""
    v, x = _arrays(v, x)
    ok = (x > 0) & np.isfinite(x) & np.isfinite(v)
    z, w = np.where(ok, x, 1.0).ravel(), np.abs(np.where(ok, v, 0.0)).ravel()
    far, most = np.hypot(z, w), np.arcsinh(w / z)  # z cosh(t) - w t is least at most, there z + rise, and 50 more at top and bottom
    rise = w * w / (far + z) - w * most
    wide = np.arccosh(1 + 50 / far)
    top, bottom = most + wide, np.where(wide < 0.5, np.maximum(most - 2 * wide, 0.0), 0.0)
    steps = np.ceil((top - bottom) / np.minimum(0.2, 0.6 / np.sqrt(far))).astype(int)
    out = np.empty(x.size)
    order = np.argsort(steps, kind="stable")
    lo = 0
    while lo < x.size:
        hi = min(x.size, lo + 1024)
        hi = lo + max(1, min(hi - lo, (1 << 20) // int(steps[order[hi - 1]])))
        at = order[lo:hi]
        h = (top - bottom)[at] / steps[at[-1]]
        t = bottom[at, None] + h[:, None] * np.arange(steps[at[-1]] + 1)
        fall = rise[at, None] - 2 * z[at, None] * np.sinh(t / 2) ** 2
        y = (np.exp(fall + w[at, None] * t) + np.exp(fall - w[at, None] * t)) / 2
        out[at] = (y.sum(axis=1) - (y[:, 0] + y[:, -1]) / 2) * h
        lo = hi
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        out = out * np.where((z < 700) & (rise > -700), np.exp(-z) * np.exp(-rise), np.exp(-z - rise))
    return np.where(ok, out.reshape(x.shape), np.where(np.isposinf(x) & np.isfinite(v), 0.0, np.nan))


def hyp2f1(a, b, c, x) -> np.ndarray:
    """The series, for |x| < 1."""
    a, b, c, x = _arrays(a, b, c, x)
    ok = np.abs(x) < 1
    z, term = np.where(ok, x, 0.0), np.ones_like(x)
    total = term.copy()
    for n in range(100_000):
        term = term * (a + n) * (b + n) / ((c + n) * (n + 1)) * z
        total = total + term
        if (np.abs(term) <= np.abs(total) * EPS).all():
            break
    return np.where(ok, total, np.nan)


def gamma_p_derivative(a, x) -> np.ndarray:
    a, x = _arrays(a, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((a > 0) & (x > 0), np.exp(-x + (a - 1) * np.log(x) - lgamma(a)), np.nan)


def ibeta_derivative(a, b, x) -> np.ndarray:
    a, b, x = _arrays(a, b, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((a > 0) & (b > 0) & (x > 0) & (x < 1), np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - lbeta(a, b)), np.nan)


FUNCTIONS: dict[str, Callable[..., np.ndarray]] = {
    "erf": erf, "erfc": erfc, "erfinv": erfinv, "erfcinv": erfcinv, "tgamma": tgamma, "lgamma": lgamma, "digamma": digamma, "tgamma_ratio": lambda a, b: tgamma(1) * np.exp(lgamma(a) - lgamma(b)),
    "gamma_p": gamma_p, "gamma_q": gamma_q, "gamma_p_inv": gamma_p_inv, "gamma_q_inv": gamma_q_inv, "gamma_p_inva": gamma_p_inva, "gamma_q_inva": gamma_q_inva, "gamma_p_derivative": gamma_p_derivative,
    "tgamma_lower": lambda a, x: gamma_p(a, x) * tgamma(a), "beta": lambda a, b: np.exp(lbeta(a, b)), "beta_ln": lbeta, "betac": lambda a, b, x: ibetac(a, b, x) * np.exp(lbeta(a, b)), "ibeta": ibeta, "ibetac": ibetac,
    "ibeta_inv": ibeta_inv, "ibetac_inv": ibetac_inv, "ibeta_inva": ibeta_inva, "ibetac_inva": ibetac_inva, "ibeta_invb": ibeta_invb, "ibetac_invb": ibetac_invb, "ibeta_derivative": ibeta_derivative,
    "bessel_i": bessel_i, "bessel_k": bessel_k, "hyp2f1": hyp2f1, "fmod": np.fmod,
}
