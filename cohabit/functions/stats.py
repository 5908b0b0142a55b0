"""Exact tests on 2x2 counts: hypergeometric upper tail and Fisher's two-sided p, as Arrow UDFs over whole batches.

Probabilities follow Loader (2000), "Fast and accurate computation of binomial
probabilities": deviance and Stirling error instead of differences of large log-gammas.  All functions
take and give arrays; rows whose sums have converged leave the loops.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)
_SMALL = np.array([math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - _HALF_LOG_2PI if n else 0.0 for n in range(16)])


def _stirling_error(n: np.ndarray) -> np.ndarray:
    """ln n! minus Stirling's formula."""
    m = np.maximum(n, 16.0)
    q = m * m
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / q) / q) / q) / q) / m
    return np.where(n <= 15, _SMALL[np.minimum(n, 15).astype(np.int64)], series)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x ln(x / mean) + mean - x without cancellation, for positive x and mean."""
    near = np.abs(x - mean) < 0.1 * (x + mean)
    v = np.where(near, (x - mean) / (x + mean), 0.0)
    total, term = (x - mean) * v, 2 * x * v
    for k in range(1, 11):  # v * v is below 0.01, so ten terms are beyond double precision
        term = term * v * v
        total = total + term / (2 * k + 1)
    return np.where(near, total, x * np.log(x / mean) + mean - x)


def _log_binomial(x: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """ln of the binomial probability of x of n; p and q lie between 0 and 1."""
    inside = (x > 0) & (x < n)
    a, m = np.where(inside, x, 1.0), np.where(inside, n, 2.0)
    part = _stirling_error(m) - _stirling_error(a) - _stirling_error(m - a) - _deviance(a, m * p) - _deviance(m - a, m * q)
    part = part + 0.5 * (np.log(m) - np.log(a) - np.log(m - a)) - _HALF_LOG_2PI
    none = n * np.where(p < 0.5, np.log1p(-p), np.log(q))
    return np.where(inside, part, np.where(x == 0, none, n * np.log(p)))


def log_pmf(x, white, black, draws) -> np.ndarray:
    """ln of the hypergeometric probability of x white ones."""
    x, white, black, draws = (np.asarray(v, dtype=np.float64) for v in np.broadcast_arrays(x, white, black, draws))
    total = white + black
    possible = (x >= np.maximum(0, draws - black)) & (x <= np.minimum(draws, white))
    free = possible & (draws > 0) & (draws < total)
    safe = np.where(free, total, 2.0)
    d = np.where(free, draws, 1.0)
    p, q = d / safe, (safe - d) / safe
    k, w, b = np.where(free, x, 1.0), np.where(free, white, 1.0), np.where(free, black, 1.0)
    value = _log_binomial(k, w, p, q) + _log_binomial(d - k, b, p, q) - _log_binomial(d, safe, p, q)
    return np.where(free, value, np.where(possible, 0.0, -np.inf))


def _log_tail(x: np.ndarray, white: np.ndarray, black: np.ndarray, draws: np.ndarray, up: bool, limit: np.ndarray | None = None, count: list[int] | None = None) -> np.ndarray:
    """ln of the sum of the probabilities from x outwards, of ``limit`` of them at most; ``count`` gets the number of terms."""
    total = np.ones(len(x))
    at = np.arange(len(x))
    i, w, b, d, term = x.copy(), white, black, draws, np.ones(len(x))
    left = np.full(len(x), np.inf) if limit is None else limit - 1.0
    terms_seen = len(x)
    while len(at):
        steps = np.arange(min(4096, max(1, 8192 // len(at))))  # the fewer rows are left, the more terms of each at once
        j, w2, b2, d2 = (i[:, None] + steps if up else i[:, None] - steps), w[:, None], b[:, None], d[:, None]
        if up:
            ratio = np.where(j < np.minimum(w2, d2), (w2 - j) * (d2 - j) / ((j + 1) * np.maximum(b2 - d2 + j + 1, 1)), 0.0)
        else:
            ratio = np.where(j > np.maximum(0, d2 - b2), j * (b2 - d2 + j) / np.maximum((w2 - j + 1) * (d2 - j + 1), 1), 0.0)
        terms = term[:, None] * np.multiply.accumulate(np.where(steps < left[:, None], ratio, 0.0), axis=1)
        total[at] += terms.sum(1)
        terms_seen += int((terms > 1e-17 * total[at][:, None]).sum())
        more = terms[:, -1] >= 1e-17 * total[at]
        i, term, left = i + len(steps) if up else i - len(steps), terms[:, -1], left - len(steps)
        at, i, w, b, d, term, left = (v[more] for v in (at, i, w, b, d, term, left))
    if count is not None:
        count.append(terms_seen)
    return np.minimum(0.0, log_pmf(x, white, black, draws) + np.log(total))


def log_upper_tail(x, white, black, draws) -> np.ndarray:
    """ln P(X >= x), also where the probability itself would underflow."""
    x, white, black, draws = (np.atleast_1d(np.asarray(v, dtype=np.float64)) for v in np.broadcast_arrays(x, white, black, draws))
    out = np.where(x <= np.maximum(0, draws - black), 0.0, -np.inf)
    open_ = (out < 0) & (x <= np.minimum(draws, white))
    low = open_ & (x * (white + black) <= draws * white)
    for chosen, up in ((low, False), (open_ & ~low, True)):
        args = [v[chosen] for v in (white, black, draws)]
        out[chosen] = _log_tail(x[chosen], *args, True) if up else np.log1p(-np.exp(_log_tail(x[chosen] - 1, *args, False)))
    return out


class MarginTails:
    """ln P(X >= x) for rows sorted by margins (white, draws), side and, outwards last to first, x.

    Rows of one margin share their sums: each adds only the terms between its x and the one before it, which lies further out, to what
    that one found.  Rows below the mean do so downwards.  What the last row found is carried to the next batch.
    """

    def __init__(self, total: float) -> None:
        self.total, self.count, self.held = float(total), [], None

    def __call__(self, x: np.ndarray, white: np.ndarray, draws: np.ndarray, side: np.ndarray) -> np.ndarray:
        """``side``: -1 below the mean, 1 above it; 0 where the tail is certain or impossible."""
        x, white, draws = (np.asarray(v, dtype=np.float64) for v in (x, white, draws))
        black = self.total - white
        out = np.where(x <= np.maximum(0, draws - black), 0.0, -np.inf)
        for sign in (-1, 1):
            k = np.flatnonzero(side == sign)
            if not len(k):
                continue
            w, d, y, b = white[k], draws[k], x[k], black[k]
            same = np.concatenate(([False], (w[1:] == w[:-1]) & (d[1:] == d[:-1])))
            last = np.concatenate(([np.nan], y[:-1]))
            carried = self.held if self.held and self.held[:3] == (sign, w[0], d[0]) else None
            if carried:
                same[0], last[0] = True, carried[3]
            limit = np.where(same, np.abs(y - last), np.inf)
            part = _log_tail(y - (sign < 0), w, b, d, sign > 0, limit, self.count)
            if carried:
                part[0] = np.logaddexp(part[0], carried[4])
            at = [*np.flatnonzero(~same).tolist(), len(k)] if not same[0] else [0, *np.flatnonzero(~same).tolist(), len(k)]
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if hi - lo > 1:
                    part[lo:hi] = np.logaddexp.accumulate(part[lo:hi])
            part = np.minimum(part, 0.0)
            held = (sign, w[-1], d[-1], y[-1], part[-1])
            out[k] = part if sign > 0 else np.log1p(-np.exp(part))
            if k[-1] == len(x) - 1:
                self.held = held
        return out


def upper_tail(x, white, black, draws) -> np.ndarray:
    """P(X >= x)"""
    return np.exp(log_upper_tail(x, white, black, draws))


def fisher(a, b, c, d) -> np.ndarray:
    """Two-sided p of [[a, c], [b, d]]: all tables at most 1 + 1e-7 times as likely; NaN for negative counts."""
    a, b, c, d = (np.atleast_1d(np.asarray(v, dtype=np.float64)) for v in np.broadcast_arrays(a, b, c, d))
    valid = np.minimum(np.minimum(a, b), np.minimum(c, d)) >= 0
    out = np.where(valid, 1.0, np.nan)
    white, black, draws = a + b, c + d, a + c
    lo, hi = np.maximum(0, draws - black), np.minimum(draws, white)
    at = np.flatnonzero(valid & (lo < hi))
    a, white, black, draws, lo, hi = (v[at] for v in (a, white, black, draws, lo, hi))
    limit = log_pmf(a, white, black, draws) + math.log1p(1e-7)
    mode = np.minimum(hi, np.maximum(lo, np.floor((draws + 1) * (white + 1) / (white + black + 2))))
    some = log_pmf(mode, white, black, draws) > limit
    at, white, black, draws, lo, hi, limit, mode = (v[some] for v in (at, white, black, draws, lo, hi, limit, mode))
    p = np.zeros(len(at))
    for edge, up in ((lo, False), (hi, True)):
        k = np.flatnonzero(log_pmf(edge, white, black, draws) <= limit)
        w, b, d, most, outside, inside = white[k], black[k], draws[k], limit[k], edge[k], mode[k]
        while (np.abs(inside - outside) > 1).any():
            mid = np.floor((inside + outside) / 2)
            likely = log_pmf(mid, w, b, d) > most
            apart = np.abs(inside - outside) > 1
            inside, outside = np.where(apart & likely, mid, inside), np.where(apart & ~likely, mid, outside)
        p[k] += np.exp(_log_tail(outside, w, b, d, up))
    out[at] = np.minimum(1.0, p)
    return out


@pandas_udf(DoubleType())
def fisher_two_sided(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(fisher(a, b, c, d))
