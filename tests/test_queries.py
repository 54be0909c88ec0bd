"""Registered queries without SQL against plain versions over the whole of their tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenfold.functions import kernels
from screenfold.operators import models
from screenfold.plans import catalogue, model_queries
from screenfold.plans.bindings import counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lanes(spark):
    return counts(spark, SF, "l_suppkey").where("gen = 0").select("gene", "strain", "rep", "n").toPandas()


def test_count_models_of_the_query_equal_one_gene_at_a_time(spark, lanes):
    df = spark.createDataFrame(lanes)
    phi = models.moment_dispersion(df, "gene", ["rep", "strain"], "n").first()["phi"]
    lib = lanes.groupby(["rep", "strain"])["n"].sum().astype(float)
    off = np.log(lib) - np.log(lib).mean()
    strains, reps = sorted(lanes["strain"].unique()), sorted(lanes["rep"].unique())
    got = {(r["gene"], r["term"]): r for r in catalogue.queries()["t27_rnaseq"](spark, SF).collect()}
    short = {(r["gene"], r["term"]): r["log2fc"] for r in catalogue.queries()["t25_irls"](spark, SF).collect()}
    assert set(got) == set(short) and len(got) == lanes["gene"].nunique() * len(strains)
    for gene, own in lanes.groupby("gene"):
        own = own.sort_values(["rep", "strain"])
        x = [np.ones(len(own))] + [(own["rep"] == r).to_numpy(float) for r in reps[1:]]
        x += [(own["strain"] == s).to_numpy(float) - (own["strain"] == strains[-1]).to_numpy(float) for s in strains[:-1]]
        x, y = np.stack(x, 1), own["n"].to_numpy(float)
        o = np.array([off[r, s] for r, s in zip(own["rep"], own["strain"])])
        beta, full = models.fit_counts(x, y, o, phi)
        effects = np.append(beta[len(reps) :], -beta[len(reps) :].sum()) / np.log(2)
        for k, s in enumerate(strains):
            drop = [len(reps) + k] if k < len(strains) - 1 else list(range(len(reps), x.shape[1]))
            lr = max(0.0, models.fit_counts(np.delete(x, drop, 1), y, o, phi)[1] - full)
            r = got[gene, s]
            assert r["log2fc"] == pytest.approx(effects[k], abs=1e-6) and r["lr"] == pytest.approx(lr, abs=1e-6)
            assert r["pvalue"] == pytest.approx(kernels.chi2_tail(lr, len(drop)), abs=1e-6)
            assert short[gene, s] == pytest.approx(r["log2fc"], abs=1e-9)


def test_every_annotation_feature_equals_a_dense_solve(spark):
    rows = model_queries.scores(spark, SF).where("Split = 'train'").toPandas()
    f = model_queries.all_annotations(spark, SF).toPandas()
    names = sorted(f["feature"].unique())
    dense = f.pivot_table(index="gene", columns="feature", values="v", aggfunc="sum", fill_value=0).reindex(columns=names, fill_value=0)
    got = catalogue.queries()["m10_annotations"](spark, SF).toPandas()
    assert len(got) == rows["strain"].nunique() * len(models.ALPHAS) * (len(names) + 1) and len(names) > 60
    for strain in rows["strain"].unique():
        own = rows[rows["strain"] == strain]
        x, y = dense.reindex(own["gene"], fill_value=0).to_numpy(float), own["y"].to_numpy()
        for alpha in (10.0, 1000.0):
            w = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + alpha * np.eye(len(names)), (x - x.mean(0)).T @ (y - y.mean()))
            mine = got[(got["strain"] == strain) & (got["alpha"] == alpha)]
            held = dict(zip(mine["feature"].fillna("(cut)"), mine["weight"]))
            assert held["(cut)"] == pytest.approx(y.mean() - x.mean(0) @ w, abs=1e-8)
            assert np.allclose([held[n] for n in names], w, atol=1e-8)


def test_dependent_columns_are_the_copies(spark):
    got = sorted(r["feature"] for r in catalogue.queries()["m03_dependent"](spark, SF).collect())
    f = model_queries.annotations(spark, SF).where("v = 1").select("gene", "feature").distinct().toPandas()
    names = sorted(f["feature"].unique())
    x = f.assign(v=1).pivot_table(index="gene", columns="feature", values="v", fill_value=0).reindex(columns=names, fill_value=0).to_numpy(float)
    ranks = [0] + [np.linalg.matrix_rank(x[:, : k + 1]) for k in range(len(names))]
    want = [n for k, n in enumerate(names) if ranks[k + 1] == ranks[k]]
    assert got == want and len(got) > 0


def test_additive_effects_of_the_query_are_least_squares(spark):
    rows = model_queries.scores(spark, SF).where("Split = 'train'").toPandas()
    genes, strains = sorted(rows["gene"].unique()), sorted(rows["strain"].unique())
    x = np.zeros((len(rows), len(genes) + len(strains) - 1))
    x[np.arange(len(rows)), [genes.index(g) for g in rows["gene"]]] = 1
    for k, s in enumerate(rows["strain"]):
        if s != strains[0]:
            x[k, len(genes) + strains.index(s) - 1] = 1
    w = np.linalg.lstsq(x, rows["y"].to_numpy(), rcond=None)[0]
    got = {(r["kind"], r["name"]): r["effect"] for r in catalogue.queries()["m04_additive"](spark, SF).collect()}
    assert all(got["gene", str(g)] == pytest.approx(w[k], abs=1e-8) for k, g in enumerate(genes))
    assert all(got["strain", s] == pytest.approx(w[len(genes) + k - 1] if k else 0.0, abs=1e-8) for k, s in enumerate(strains))


def test_sequence_edges_of_the_query_hold_their_identity(spark):
    from tests.test_align import whole

    edges = catalogue.queries()["g01_sequence_edges"](spark, SF)
    text = {r["id"]: r["sequence"].upper() for r in model_queries_turns(spark)}
    for r in edges.limit(5).collect():
        a, b = text[r["g1"]], text[r["g2"]]
        assert r["identity"] >= 0.4 and len(a) and len(b)
        if len(a) * len(b) < 200_000:
            assert r["identity"] <= whole(a, b)[1] / min(len(a), len(b)) + 0.1
    assert catalogue.queries()["g01_frequent_seeds"](spark, SF).where(F.col("n") <= 50).count() == 0


def model_queries_turns(spark):
    from screenfold.plans import graph_queries

    return graph_queries.turns(spark, SF).collect()
