"""Numerical routines that Spark SQL lacks, over arrays; UDFs are Arrow-batched."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Dispersions on which profile likelihoods are taken.
GRID = np.geomspace(1e-4, 4.0, 120)



def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series at x + 8, and the product of the eight numbers before it."""
    x = np.asarray(x, dtype=float)
    below = x.copy()
    for k in range(1, 8):
        below = below * (x + k)
    z = x + 8
    i = 1 / z
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + i * (1 / 12 - i * i * (1 / 360 - i * i * (1 / 1260 - i * i * (1 / 1680 - i * i * (1 / 1188 - i * i * 691 / 360360))))) - np.log(below)


def nb_loglik(y: np.ndarray, mu: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Negative-binomial log likelihood, summed over the last axis."""
    r = 1 / phi
    return (log_gamma(y + r) - log_gamma(r) - log_gamma(y + 1) + r * np.log(r / (r + mu)) + y * np.log(np.maximum(mu, 1e-300) / (r + mu))).sum(-1)


def adjusted_profile(y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Cox-Reid adjusted profile likelihood of two arms at each dispersion of the grid."""
    return adjusted_profiles([y0], [y1])[0]


def adjusted_profiles(y0: list, y1: list) -> np.ndarray:
    """``adjusted_profile`` of many genes, one row each; genes with as many values go together."""
    out = np.zeros((len(y0), len(GRID)))
    for arm in (y0, y1):
        sizes = np.array([len(y) for y in arm])
        for n in np.unique(sizes[sizes > 0]):
            genes = np.flatnonzero(sizes == n)
            for part in np.array_split(genes, len(genes) * n // 4000 + 1):  # so many numbers stay in a core's cache
                y = np.array([arm[g] for g in part], dtype=float)[:, None, :]
                mu = np.maximum(y.mean(2, keepdims=True), 1e-8)
                info = n * mu[:, :, 0] / (1 + GRID * mu[:, :, 0])
                out[part] += nb_loglik(y, mu, GRID[:, None]) - 0.5 * np.log(np.maximum(info, 1e-300))
    return out


def gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    scale = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * math.exp(scale))
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        step = -i * (i - a)
        b += 2
        d = step * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + step / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(scale)


def chi2_tail(x: float, df: int) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2)) if df == 1 else gamma_tail(df / 2, max(x, 0.0) / 2)


_erfc = np.frompyfunc(math.erfc, 1, 1)


def erfc(x: np.ndarray) -> np.ndarray:
    return _erfc(np.asarray(x, dtype=float)).astype(float)


def chi2_tail_udf(x, df):
    @F.pandas_udf(DoubleType())
    def run(x: pd.Series, df: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        known = x.notna().to_numpy()
        one = known & (df == 1).to_numpy()
        out[one] = erfc(np.sqrt(np.maximum(x[one], 0) / 2))
        for k in np.flatnonzero(known & ~one):
            out[k] = chi2_tail(x.iloc[k], int(df.iloc[k]))
        return pd.Series(out).where(known)

    return run(F.col(x) if isinstance(x, str) else x, df)


def hypergeometric_tails(hits: np.ndarray, population: np.ndarray, marked: np.ndarray, drawn: np.ndarray, at_once: int = 1_000_000) -> np.ndarray:
    """P(X >= hits) of each row; the terms of many rows are summed together."""
    hits, population, marked, drawn = (np.asarray(v, dtype=np.int64) for v in (hits, population, marked, drawn))
    first = np.maximum(hits, drawn - population + marked)
    terms = np.where(hits > 0, np.maximum(np.minimum(marked, drawn) - first + 1, 0), 0)
    choose = lambda n, k: log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)
    out = np.where(hits > 0, 0.0, 1.0)
    rows = np.flatnonzero(terms)
    upto = np.cumsum(terms[rows])
    begin = 0
    while begin < len(rows):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + at_once)))
        part = rows[begin:end]
        row = np.repeat(part, terms[part])
        starts = np.cumsum(terms[part]) - terms[part]
        i = first[row] + np.arange(len(row)) - np.repeat(starts, terms[part])
        logs = choose(marked[row], i) + choose(population[row] - marked[row], drawn[row] - i) - choose(population[row], drawn[row])
        top = np.maximum.reduceat(logs, starts)
        out[part] = np.minimum(1.0, np.exp(top) * np.add.reduceat(np.exp(logs - np.repeat(top, terms[part])), starts))
        begin = end
    return out


def hypergeometric_tail(hits: int, population: int, marked: int, drawn: int) -> float:
    """P(X >= hits)."""
    return float(hypergeometric_tails([hits], [population], [marked], [drawn])[0])


def rank_sum_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p of the rank-sum statistic without ties, whatever the sizes.

    Subsets of ranks by their statistic are the coefficients of a Gaussian binomial, the product over i
    of (1 - q^(n + i)) / (1 - q^i); only those up to the shorter tail are made, as whole numbers.
    """
    n1, n2 = min(n1, n2), max(n1, n2)
    most = n1 * n2 - math.ceil(max(u, n1 * n2 - u))
    if most < 0:
        return 0.0
    ways = np.zeros(most + 1, dtype=object)
    ways[0] = 1
    for i in range(1, n1 + 1):
        if n2 + i <= most:
            ways[n2 + i :] = ways[n2 + i :] - ways[: most + 1 - n2 - i]
        for r in range(min(i, most + 1)):
            ways[r::i] = np.cumsum(ways[r::i])
    total = math.comb(n1 + n2, n1)
    twice = 2 * int(ways.sum())
    return 1.0 if twice >= total else twice / total


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
