"""Vectorised kernels against their definitions."""

import itertools
import math
import time

import numpy as np
import pytest

from screenfold.functions import kernels
from screenfold.operators import models


def test_log_gamma_over_its_range():
    x = np.concatenate([np.geomspace(1e-6, 1e9, 400), np.arange(1, 30)])
    want = np.array([math.lgamma(v) for v in x])
    assert np.allclose(kernels.log_gamma(x), want, rtol=1e-12, atol=1e-12)


def test_profiles_of_many_genes_equal_one_by_one():
    rng = np.random.default_rng(1)
    y0 = [rng.poisson(9, int(n)).tolist() for n in rng.integers(0, 4, 60)]
    y1 = [rng.poisson(4, int(n)).tolist() for n in rng.integers(0, 4, 60)]

    def plain(a, b):
        out = []
        for phi in kernels.GRID:
            r, total = 1 / phi, 0.0
            for y in (a, b):
                if y:
                    mu = max(sum(y) / len(y), 1e-8)
                    total += sum(math.lgamma(v + r) - math.lgamma(r) - math.lgamma(v + 1) + r * math.log(r / (r + mu)) + v * math.log(mu / (r + mu)) for v in y) - 0.5 * math.log(len(y) * mu / (1 + phi * mu))
            out.append(total)
        return out

    got = kernels.adjusted_profiles(y0, y1)
    for k in range(60):
        assert np.allclose(got[k], plain(y0[k], y1[k]), rtol=1e-9, atol=1e-9)


def test_hypergeometric_tails_equal_counting():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(300):
        n = int(rng.integers(1, 60))
        k, d = (int(rng.integers(0, n + 1)) for _ in range(2))
        rows.append((int(rng.integers(0, min(k, d) + 2)), n, k, d))
    got = kernels.hypergeometric_tails(*zip(*rows), at_once=50)
    for (h, n, k, d), p in zip(rows, got):
        want = sum(math.comb(k, i) * math.comb(n - k, d - i) for i in range(h, min(k, d) + 1)) / math.comb(n, d) if h > 0 else 1.0
        assert p == pytest.approx(want, abs=1e-10)


@pytest.mark.parametrize("n1,n2", [(1, 1), (2, 3), (3, 6), (5, 4), (8, 3)])
def test_exact_rank_sums_equal_all_subsets(n1, n2):
    all_u = [sum(s) - n1 * (n1 - 1) // 2 for s in itertools.combinations(range(n1 + n2), n1)]
    for u in range(n1 * n2 + 1):
        far = max(u, n1 * n2 - u)
        assert kernels.rank_sum_exact(u, n1, n2) == pytest.approx(min(1.0, 2 * sum(v >= far for v in all_u) / len(all_u)), rel=1e-12)


def test_exact_rank_sums_of_large_sides():
    began = time.time()
    p = kernels.rank_sum_exact(8 * 6000 * 0.2, 8, 6000)
    sd = math.sqrt(8 * 6000 * 6009 / 12)
    z = (0.3 * 8 * 6000 - 0.5) / sd
    assert 0.3 < p / kernels.normal_two_sided(z) < 3 and time.time() - began < 20
    assert kernels.rank_sum_exact(0, 8, 251) == pytest.approx(2 / math.comb(259, 8), rel=1e-12)


def test_genes_fitted_together_equal_one_by_one():
    rng = np.random.default_rng(3)
    x = np.array([[1, a, b, a * b] for a in (0, 1) for b in (0, 1) for _ in range(3)], float)
    off = rng.normal(0, 0.1, (40, 12))
    y = rng.negative_binomial(5, 5 / (5 + np.exp(2 + 0.5 * x[:, 1] + off)))
    y[7], y[8, 3:] = 0, 0
    phi = np.where(np.arange(40) % 2, 0.1, 0.7)
    beta, dev = models.fit_many(x, y.astype(float), off, phi)
    for g in range(40):
        one, d = models.fit_counts(x, y[g].astype(float), off[g], phi[g])
        assert dev[g] == pytest.approx(d, abs=1e-8 * (1 + abs(d)))
        if y[g].min() > 0 or g not in (7, 8):
            assert np.allclose(x @ beta[g], x @ one, atol=1e-3) or y[g].min() == 0
