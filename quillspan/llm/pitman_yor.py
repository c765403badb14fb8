"""Numbers of tables in Pitman-Yor restaurants.

A dish that c customers ordered sits at t of a restaurant's tables. With discount d, the seatings of c customers at t
tables sum up to the generalized Stirling number S(c, t): S(1, 1) = 1, S(c + 1, t) = S(c, t - 1) + (c - t d) S(c, t). All
that predictions need of a seating is (c, t), so a draw of t from x**t * S(c, t) is a draw of all c seats at once.

A restaurant's dishes depend on each other only through its total T, in the factor Gamma(theta / d + T). With a gamma
variate y of that shape given, they are independent, and each has x = d * y * (probability of the dish in the parent).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Exact up to so many customers; a saddle point of S's generating function beyond.
EXACT = 512
#: Discounts and concentrations that hyperparameters are drawn from.
DISCOUNTS = np.round(np.arange(1, 20) * 0.05, 2)
CONCENTRATIONS = np.array([0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0, 3000.0])
_WINDOW, _TERMS = 24, 32


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function of positive numbers, by Stirling's series after eight steps up."""
    x = np.asarray(x, np.float64)
    low = np.ones_like(x)
    for k in range(8):
        low *= np.where(x < 16, x + k, 1.0)
    z = np.where(x < 16, x + 8, x)
    inv = 1 / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + inv / 12 * (1 - inv * inv / 30 * (1 - inv * inv * 2 / 7)) - np.log(low)


@lru_cache(len(DISCOUNTS) + 1)
def stirling(d: float, top: int = EXACT) -> np.ndarray:
    """ln S(c, t) at [c, t]; -inf where t is 0 or more than c."""
    out = np.full((top + 1, top + 1), -np.inf, np.float32)
    row = np.full(top + 2, -np.inf)
    row[1] = 0.0
    t = np.arange(top + 2)
    out[1, : top + 1] = row[: top + 1]
    for c in range(1, top):
        stay = np.full(top + 2, -np.inf)
        stay[1 : c + 1] = np.log(c - t[1 : c + 1] * d) + row[1 : c + 1]
        row = np.logaddexp(np.r_[-np.inf, row[:-1]], stay)
        out[c + 1] = row[: top + 1]
    return out


def _at(s: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For z = 1 - exp(-s): ln z, ln f and ln f' of f(z) = (1 - (1 - z)**d) / d."""
    return np.log(-np.expm1(-s)), np.log(-np.expm1(-s * d) / d), s * (1 - d)


def _solve(goes_up, n: int) -> np.ndarray:
    low, high = np.full(n, np.log(1e-12)), np.full(n, np.log(600.0))
    for _ in range(40):
        mid = (low + high) / 2
        up = goes_up(np.exp(mid))
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return np.exp((low + high) / 2)


def large_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """ln S(c, t) for c above EXACT, all of t in one row with one c.

    For t small against c**d by the first terms of the explicit sum over j of (-1)**j binom(t, j) (-j d)(1 - j d)...
    (c - 1 - j d) / (d**t t!), which shrink fast there; otherwise c! / t! times the coefficient of z**c in f(z)**t, by
    its saddle point."""
    c, t = np.asarray(c, np.float64), np.asarray(t, np.float64)
    share = t * c[:, None] ** -d
    near = share <= (3.0 if d <= 0.5 else 0.6)
    out = np.zeros(t.shape)
    if near.any():
        j = np.arange(1, _TERMS + 1)
        fixed = log_gamma(c[:, None] - j * d) + log_gamma(1 + j * d) - log_gamma(j + 1.0) - log_gamma(c[:, None])
        sign = np.sin(np.pi * j * d) * np.where(j % 2, 1.0, -1.0)
        row, col = np.nonzero(near)
        n = t[row, col]
        falling = np.cumsum(np.log(np.maximum(n[:, None] - j + 1, 1e-300)), axis=1)  # t! / (t - j)!
        total = (sign * np.exp(np.minimum(fixed[row] + falling, 600))).sum(1) / np.pi
        out[row, col] = np.log(np.maximum(total, 1e-300)) + log_gamma(c)[row] - n * np.log(d) - log_gamma(n + 1)
    if not near.all():
        row, col = np.nonzero(~near)
        n, m = c[row], t[row, col]
        inner = np.minimum(m, n - 0.5)

        def low(s: np.ndarray) -> np.ndarray:  # t z f' / f, which must be c
            z, f, g = _at(s, d)
            return np.log(inner) + z + g - f < np.log(n)

        s = _solve(low, len(n))
        z, f, g = _at(s, d)
        slope = 1 + np.exp(z + s) * (1 - d) - np.exp(z + g - f)  # z d/dz of ln(z f' / f)
        spread = np.maximum(n * slope, 0.25)
        out[row, col] = log_gamma(n + 1) - log_gamma(m + 1) + m * f - n * z - 0.5 * np.log(2 * np.pi * spread)
    return out


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    out = np.zeros(len(c))
    small = c <= EXACT
    out[small] = stirling(d)[c[small], t[small]]
    if not small.all():
        out[~small] = large_stirling(c[~small], t[~small, None], d)[:, 0]
    return out


def draw_tables(c: np.ndarray, x: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Of dishes with c customers: t with probability in proportion to x**t * S(c, t)."""
    t = np.ones(len(c), np.int64)
    log_x, u = np.log(np.maximum(x, 1e-300)), rng.random(len(c))
    two = np.flatnonzero(c == 2)
    t[two] += u[two] * (x[two] + 1 - d) < x[two]
    rest = np.flatnonzero((c > 2) & (c <= EXACT))
    rest = rest[np.argsort(c[rest], kind="stable")]
    bounds = np.searchsorted(c[rest], np.arange(EXACT + 2))
    table = stirling(d)
    for k in np.unique(c[rest]).tolist():
        for a in range(bounds[k], bounds[k + 1], max(1, 1_000_000 // k)):
            e = rest[a : min(bounds[k + 1], a + max(1, 1_000_000 // k))]
            p = log_x[e, None] * np.arange(1, k + 1) + table[k, 1 : k + 1]
            p -= p.max(1, keepdims=True)
            p = np.cumsum(np.exp(p), axis=1)
            t[e] = 1 + (p < (u[e] * p[:, -1])[:, None]).sum(1)
    big = np.flatnonzero(c > EXACT)
    for a in range(0, len(big), 2048):
        e = big[a : a + 2048]
        n, lx, v = c[e].astype(np.float64), log_x[e], u[e]

        def rising(s: np.ndarray) -> np.ndarray:  # x f(z) < t + 1/2, where t = c f / (z f')
            z, f, g = _at(s, d)
            return np.exp(lx + f) < n * np.exp(f - z - g) + 0.5  # noqa: B023

        s = _solve(rising, len(e))
        z, f, g = _at(s, d)
        mode = np.clip(n * np.exp(f - z - g), 1, n)
        turn = np.exp(-s * d - f) - (1 - d) - np.exp(-s - z)  # d ln t / ds
        width = 1 / np.sqrt(np.maximum(1 / (mode + 0.5) - np.exp(-s * d - f) / np.minimum(mode * turn, -1e-12), 1e-12))
        step = np.maximum(1.0, 12 * width / _WINDOW)
        first = np.maximum(1.0, np.floor(mode - step * _WINDOW / 2))
        at = np.minimum(first[:, None] + np.floor(np.arange(_WINDOW) * step[:, None]), n[:, None])
        p = lx[:, None] * at + large_stirling(n, at, d)
        p[:, 1:][at[:, 1:] == at[:, :-1]] = -np.inf
        p = np.cumsum(np.exp(p - p.max(1, keepdims=True)), axis=1)
        k = np.minimum((p < (v * p[:, -1])[:, None]).sum(1), _WINDOW - 1)
        spot = at[np.arange(len(e)), k] + (rng.random(len(e)) - 0.5) * step + 0.5  # within a step of the grid
        t[e] = np.clip(np.floor(spot), 1, n).astype(np.int64)
    return t


def table_terms(c: np.ndarray, t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """By discount: the sum of n * ln S(c, t)."""
    return np.array([float(n @ log_stirling(c, t, float(d))) for d in DISCOUNTS])


def restaurant_terms(c: np.ndarray, t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """By discount and concentration: the sum over restaurants with c customers at t tables, each n times."""
    a, d = CONCENTRATIONS[None, :, None], DISCOUNTS[:, None, None]
    out = np.zeros((len(DISCOUNTS), len(CONCENTRATIONS)))
    for k in range(0, len(c), 20_000):
        cc, tt, nn = (x[None, None, k : k + 20_000].astype(np.float64) for x in (c, t, n))
        up = log_gamma(a / d + tt) - log_gamma(a / d + 1) + (tt - 1) * np.log(d)
        out += ((up - log_gamma(a + cc) + log_gamma(a + 1)) * nn).sum(2)
    return out


def draw_hyperparameters(log_p: np.ndarray, rng: np.random.Generator) -> tuple[float, float]:
    """A discount and a concentration from the grid, by their likelihood; the prior is flat on the grid."""
    p = np.exp(log_p - log_p.max()).ravel()
    k = int(np.searchsorted(np.cumsum(p), rng.random() * p.sum()))
    return float(DISCOUNTS[k // log_p.shape[1]]), float(CONCENTRATIONS[k % log_p.shape[1]])
