"""Numerical routines against direct loops and closed forms."""

import math

import numpy as np
import pytest

from screenfold.functions import kernels as K


def test_log_gamma():
    x = np.array([0.25, 0.5, 1, 2.5, 7.9, 8, 100, 1e4])
    assert np.allclose(K.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_deviance_identity():
    """Twice the gain of the saturated model is the deviance."""
    rng = np.random.default_rng(1)
    for phi in (0.02, 0.07, 0.3, 1.1):
        y = rng.negative_binomial(1 / phi, 1 / (1 + 300 * phi), (8, 6)).astype(float)
        mu = y.mean(1, keepdims=True)
        r = 1 / phi
        dev = 2 * (np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / mu), 0) - (y + r) * np.log((y + r) / (mu + r))).sum(1)
        gain = 2 * (K.nb_loglik(y, np.maximum(y, 1e-12), np.full((8, 1), phi)) - K.nb_loglik(y, np.broadcast_to(mu, y.shape), np.full((8, 1), phi)))
        assert np.allclose(dev, gain, rtol=1e-6, atol=1e-6)


def test_chi2_tail():
    assert K.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert K.chi2_tail(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-12)
    assert K.chi2_tail(24.995790139728616, 15) == pytest.approx(0.05, abs=1e-12)
    assert K.chi2_tail(0, 3) == 1


def test_hypergeometric_tail():
    direct = lambda k, n, m, d: sum(math.comb(m, i) * math.comb(n - m, d - i) for i in range(k, min(m, d) + 1)) / math.comb(n, d)
    for case in ((2, 20, 5, 6), (1, 50, 10, 3), (5, 30, 10, 12)):
        assert K.hypergeometric_tail(*case) == pytest.approx(direct(*case), rel=1e-10)
    assert K.hypergeometric_tail(0, 10, 3, 3) == 1
    assert K.hypergeometric_tail(200, 4000, 300, 400) < 5e-4


def test_rank_sum_exact_against_subsets():
    from itertools import combinations

    for n1, n2 in ((3, 4), (2, 5), (4, 4)):
        us = [sum(c) - n1 * (n1 + 1) / 2 for c in combinations(range(1, n1 + n2 + 1), n1)]
        for u in sorted(set(us)):
            far = max(u, n1 * n2 - u)
            want = min(1.0, 2 * sum(x >= far for x in us) / len(us))
            assert K.rank_sum_exact(u, n1, n2) == pytest.approx(want)


def test_step_up_fdr(spark):
    from screenfold.operators.windows import with_fdr

    rng = np.random.default_rng(3)
    p = np.concatenate([rng.uniform(0, 1e-6, 20), rng.uniform(0, 1, 200)])
    got = with_fdr(spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i int, pvalue double")).toPandas().sort_values("pvalue")
    q = np.sort(p)
    want = np.array([min(1, min(q[j] * len(q) / (j + 1) for j in range(i, len(q)))) for i in range(len(q))])
    assert np.allclose(got["fdr"], want, atol=1e-12)
    assert (np.diff(got["fdr"]) >= 0).all() and (got["fdr"] >= got["pvalue"]).all()


def test_sum_to_zero_model(spark):
    from screenfold.operators.models import count_models

    effects = {"a": 0.4, "b": -0.1, "c": -0.5, "d": 0.2}
    rows = [("g", s, r, int(round(1e5 * math.exp(e)))) for s, e in effects.items() for r in range(3)]
    rows += [("h", s, r, 10_000_000 - int(round(1e5 * math.exp(e)))) for s, e in effects.items() for r in range(3)]
    got = count_models(spark.createDataFrame(rows, "gene string, strain string, rep int, n long"), "gene", ["rep", "strain"], "n").where("gene = 'g'").toPandas().set_index("term")["log2fc"] * math.log(2)
    assert got.sum() == pytest.approx(0, abs=1e-8)
    for s, e in effects.items():
        assert got[s] == pytest.approx(e, abs=1e-3)


def test_count_model_is_at_its_optimum():
    """Coefficients of several levels: no small move lowers the deviance, and one level is the mean."""
    from screenfold.operators.models import fit_counts

    rng = np.random.default_rng(8)
    for phi in (0.04, 0.15, 0.6):
        x = np.column_stack([np.ones(12), *[np.repeat(np.eye(4)[i], 3) for i in range(1, 4)], np.tile([0, 1, 0], 4)])
        y, off = rng.negative_binomial(1 / phi, 1 / (1 + 200 * phi), 12).astype(float), rng.normal(0, 0.2, 12)
        beta, dev = fit_counts(x, y, off, phi)

        def deviance(b):
            mu, r = np.exp(x @ b + off), 1 / phi
            return 2 * (np.where(y > 0, y * np.log(np.maximum(y, 1) / mu), 0) - (y + r) * np.log((y + r) / (mu + r))).sum()

        assert dev == pytest.approx(deviance(beta), rel=1e-9)
        for _ in range(200):
            assert deviance(beta + rng.normal(0, 1e-3, 5)) >= dev - 1e-9
        _, one = fit_counts(np.ones((12, 1)), y, np.zeros(12), phi)
        assert fit_counts(np.ones((12, 1)), y, np.zeros(12), phi)[0][0] == pytest.approx(math.log(y.mean()), abs=1e-6)
    assert fit_counts(np.ones((3, 1)), np.zeros(3), np.zeros(3), 0.1)[1] == pytest.approx(0, abs=1e-3)


def test_moments_find_the_dispersion(spark):
    from screenfold.operators.models import MOMENT_GRID, moment_dispersion

    rng = np.random.default_rng(9)
    rows = [(g, s, r, int(rng.negative_binomial(1 / 0.2, 1 / (1 + 500 * 0.2)))) for g in range(150) for s in "abcd" for r in range(3)]
    phi = moment_dispersion(spark.createDataFrame(rows, "gene int, strain string, rep int, n long"), "gene", ["rep", "strain"], "n").first()["phi"]
    assert any(phi == p for p in MOMENT_GRID) and 0.12 < phi < 0.33


def test_dispersions_by_their_definition(spark):
    from screenfold.operators.fitness import estimate_dispersions

    rng = np.random.default_rng(10)
    rows = [(s, g, arm, float(rng.negative_binomial(4, 4 / (4 + 20 + 3 * g)))) for s in "ab" for g in range(25) for arm in (0, 10) for _ in range(2 if g % 5 == 0 else 3)]
    got = {(r["strain"], r["gene"]): r for r in estimate_dispersions(spark.createDataFrame(rows, "strain string, gene int, gen int, y double"), "gene", "strain", "gen", "y").collect()}
    for s in "ab":
        cells = {g: [[r[3] for r in rows if r[:3] == (s, g, arm)] for arm in (0, 10)] for g in range(25)}
        order = sorted(range(25), key=lambda g: (np.mean(cells[g][0] + cells[g][1]), g))
        apl = np.array([K.adjusted_profile(*cells[g]) for g in order])
        half = round(0.3 * 25) // 2
        for i, g in enumerate(order):
            trend = np.mean(apl[max(0, i - half) : i + half + 1], 0)
            tag = apl[i] + 10 / (sum(map(len, cells[g])) - 2) * trend
            assert (got[s, g]["common"], got[s, g]["trended"], got[s, g]["tagwise"]) == (K.GRID[apl.sum(0).argmax()], K.GRID[trend.argmax()], K.GRID[tag.argmax()])


def test_reads_to_fitness_recover_the_truth(spark):
    """Simulated lanes with ground truth, through matching, counting, rates and ratios."""
    from pyspark.sql import functions as F

    from screenfold.operators import counts, fitness, reads

    rng = np.random.default_rng(11)
    dna = lambda n: "".join(rng.choice(list("ACGT"), n))
    tags = {f"g{i:02d}": dna(12 + i % 8) for i in range(40)}
    truth = {s: {g: float(rng.choice([0, 0, 0, -2, 1.5]) + rng.normal(0, 0.05)) for g in tags} for s in ("S1", "S2")}
    base = {g: float(np.exp(rng.normal(0, 0.6))) for g in tags}
    sheet, rows, no = [], [], 0
    for s in truth:
        for gen in (0, 10):
            for rep in "AB":
                index = dna(10)
                sheet.append((f"{s}_{gen}_{rep}", "lane", index))
                weight = np.array([base[g] * (2 ** truth[s][g] if gen else 1) * np.exp(rng.normal(0, 0.05)) for g in tags])
                for g in rng.choice(list(tags), 1500, p=weight / weight.sum()):
                    seq = index + "ACGTACGTACGTACGTAC" + tags[g] + dna(20)
                    if rng.random() < 0.06:
                        at = 28 + int(rng.integers(0, len(tags[g])))
                        seq = seq[:at] + "ACGT"[("ACGT".index(seq[at]) + 1) % 4] + seq[at + 1 :]
                    rows.append(("lane", no, seq if rng.random() > 0.04 else index + dna(60)))
                    no += 1
    decode = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(tags.items())], "ord int, gene string, tag string")
    found = reads.match_reads(spark.createDataFrame(rows, "lane string, read_no long, seq string"), spark.createDataFrame(sheet, "sample_id string, lane string, index_seq string"), [10], decode, 28)
    n = reads.count_genes(found).groupBy("sample_id", "gene").agg(F.sum("n").alias("n"))
    part = F.split("sample_id", "_")
    cells = counts.densify(n.select("gene", part[0].alias("strain"), part[1].cast("int").alias("gen"), part[2].alias("rep"), "n"), ["gene"], ["strain", "gen", "rep"])
    fc = fitness.replicate_fitness(counts.cpm(cells, ["strain", "gen", "rep"]), ["gene", "strain"], "rep", "gen", "cpm").groupBy("gene", "strain").agg(F.avg("fitness").alias("fc")).toPandas()
    for s in truth:
        mine = fc[fc["strain"] == s].dropna()
        assert np.corrcoef(mine["fc"], [truth[s][g] for g in mine["gene"]])[0, 1] > 0.9
