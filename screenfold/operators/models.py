"""Baselines, ridge models, count models and clustering on long tables.

Sums over rows are Spark aggregates; only systems as small as the number of features, strains or grid
points are solved in numpy, inside tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenfold.functions import kernels
from screenfold.operators.linkage import average_linkage, leaf_order  # noqa: F401  clustering is used from here as well
from screenfold.operators.scan import mean_ranks_of, numbered
from screenfold.operators.windows import with_fdr
from screenfold.plans.session import stash

ALPHAS = [10.0, 31.6, 100.0, 316.0, 1000.0, 3160.0, 10000.0, 31600.0, 100000.0]


def one_hot(rows: DataFrame, key: str, level: str, fit_on: DataFrame | None = None) -> DataFrame:
    """(key, feature, slot): levels in order, the first dropped; unseen levels have no row."""
    levels = (fit_on if fit_on is not None else rows).select(level).where(F.col(level).isNotNull()).distinct()
    slots = numbered(levels, [F.col(level)], "slot", start=0).where("slot > 0")
    return rows.select(key, level).join(slots, level).select(key, F.col(level).alias("feature"), "slot")


def mean_predictions(scores: DataFrame, train: str = "Split = 'train'") -> DataFrame:
    """Rows of ``scores`` with the training means of all, of their strain and of their gene, and their
    sum less the overall mean; a gene without training rows takes the overall mean."""
    fit = scores.where(train)
    strain = fit.groupBy("strain").agg(F.avg("y").alias("p_strain"))
    gene = fit.groupBy("gene").agg(F.avg("y").alias("g"))
    rows = scores.join(strain, "strain", "left").join(gene, "gene", "left").crossJoin(fit.agg(F.avg("y").alias("p_total")))
    return rows.withColumn("p_gene", F.coalesce("g", "p_total")).withColumn("unseen", F.col("g").isNull()).drop("g")


def metrics(rows: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """R2, MAE and RMSE of predictions, grouped."""
    err = F.col(y) - F.col(p)
    got = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(err * err).alias("sse"), F.var_pop(y).alias("v"), F.avg(F.abs(err)).alias("mae"))
    return got.select(*by, "n", (1 - F.try_divide(F.col("sse"), F.col("v") * F.col("n"))).alias("r2"), "mae", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


def additive_effects(train: DataFrame) -> DataFrame:
    """(kind, name, effect) of y = gene + strain by least squares.

    Means within genes are taken out of y and of the strain indicators; what is left is a system as
    wide as the strains, made of sums. Gene effects follow. The first strain is the reference.
    """
    w = Window.partitionBy("gene")
    rows = train.select("gene", "strain", "y").withColumn("k", F.count("*").over(w)).withColumn("r", F.col("y") - F.avg("y").over(w))
    right = rows.groupBy("strain").agg(F.sum("r").alias("b"), F.count("*").cast("double").alias("n"))
    pair = rows.select("gene", F.col("strain").alias("s1"), "k").join(rows.select("gene", F.col("strain").alias("s2")), "gene").groupBy("s1", "s2").agg(F.sum(-1.0 / F.col("k")).alias("v"))
    system = pair.join(right.withColumnRenamed("strain", "s1"), "s1")

    def solve(key_, got):
        names = sorted(set(got.column("s1").to_pylist()) | set(got.column("s2").to_pylist()))
        at = {s: i for i, s in enumerate(names)}
        m, b = np.zeros((len(names),) * 2), np.zeros(len(names))
        for s1, s2, v, rb, n in zip(*(got.column(c).to_pylist() for c in ("s1", "s2", "v", "b", "n"))):
            m[at[s1], at[s2]] += v
            b[at[s1]] = rb
            if s1 == s2:
                m[at[s1], at[s1]] += n
        effects = np.zeros(len(names))
        effects[1:] = np.linalg.lstsq(m[1:, 1:], b[1:], rcond=None)[0]
        return pa.table({"strain": pa.array([str(s) for s in names]), "effect": pa.array(effects)})

    strain = system.groupBy(F.lit("all")).applyInArrow(lambda k, t: solve(k, t), "strain string, effect double")
    named = train.withColumn("strain", F.col("strain").cast("string")).join(strain, "strain")
    gene = named.groupBy(F.col("gene").cast("string").alias("name")).agg(F.avg(F.col("y") - F.col("effect")).alias("effect"))
    return strain.select(F.lit("strain").alias("kind"), F.col("strain").alias("name"), "effect").unionByName(gene.select(F.lit("gene").alias("kind"), "name", "effect"))


def ridge(train: DataFrame, by: str, features: list[str], y: str, alphas: list[float] = ALPHAS) -> DataFrame:
    """(by, alpha, intercept, weights) for each penalty; one pass sums the Gram matrix, centred means
    are taken out afterwards and the intercept is not penalised."""
    sums = [F.count("*").cast("double").alias("n"), F.sum(y).alias("sy")] + [F.sum(f).alias(f"s{i}") for i, f in enumerate(features)] + [F.sum(F.col(f) * F.col(y)).alias(f"y{i}") for i, f in enumerate(features)]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if j >= i]
    grams = train.groupBy(by).agg(*sums)
    kind = dict(grams.dtypes)[by]

    def solve(batches):
        for b in batches:
            out = {"by": [], "alpha": [], "intercept": [], "weights": []}
            for r in b.to_pylist():
                k, n = len(features), r["n"]
                s, sy = np.array([r[f"s{i}"] for i in range(k)]), r["sy"]
                g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) - np.outer(s, s) / n
                c = np.array([r[f"y{i}"] for i in range(k)]) - s * sy / n
                for a in alphas:
                    w = np.linalg.solve(g + a * np.eye(k), c)
                    for name, v in zip(out, (r[by], a, float(sy / n - w @ s / n), w.tolist())):
                        out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["by"], type=b.schema.field(by).type), pa.array(out["alpha"], pa.float64()), pa.array(out["intercept"], pa.float64()), pa.array(out["weights"], pa.list_(pa.float64()))], [by, "alpha", "intercept", "weights"])

    return grams.mapInArrow(solve, f"{by} {kind}, alpha double, intercept double, weights array<double>")


def ridge_scores(rows: DataFrame, models: DataFrame, by: str, features: list[str], y: str, split: str) -> DataFrame:
    """(by, alpha, split, n, r2, rmse, pearson); the correlation of a constant prediction is null."""
    p = F.aggregate(F.zip_with("weights", F.array(*features), lambda w, x: w * x), F.lit(0.0), lambda a, x: a + x) + F.col("intercept")
    got = rows.join(models, by).withColumn("p", p)
    base = metrics(got, [by, "alpha", split], y, "p")
    corr = got.groupBy(by, "alpha", split).agg(F.when((F.var_pop("p") > 0) & (F.var_pop(y) > 0), F.try_divide(F.covar_pop("p", y), F.stddev_pop("p") * F.stddev_pop(y))).alias("pearson"))
    return base.drop("mae").join(corr, [by, "alpha", split])


def best_alpha(scores: DataFrame, by: str, split: str, on: str = "val") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("r2"), "alpha")
    return scores.where(F.col(split) == on).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def fit_counts(x: np.ndarray, y: np.ndarray, off: np.ndarray, phi: float, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Coefficients and deviance of one negative-binomial model with a log link.

    Reweighted least squares; a step that does not lower the deviance is halved, and the fit ends when
    steps change the deviance by less than a billionth.
    """
    r = 1 / phi

    def deviance(beta):
        mu = np.exp(np.clip(x @ beta + off, -40, 40))
        gain = np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0.0)
        return mu, 2 * float((gain - (y + r) * np.log((y + r) / (mu + r))).sum())

    beta = np.linalg.lstsq(x, np.log(y + 0.25) - off, rcond=None)[0]
    mu, dev = deviance(beta)
    for _ in range(rounds):
        root = np.sqrt(mu * r / (r + mu))
        step = np.linalg.lstsq(x * root[:, None], root * (y - mu) / mu, rcond=None)[0]
        for _ in range(12):
            new_mu, new = deviance(beta + step)
            if new <= dev + 1e-12 * (1 + abs(dev)):
                break
            step = step / 2
        else:
            break
        beta, mu, change, dev = beta + step, new_mu, dev - new, new
        if change < 1e-9 * (abs(dev) + 1e-3) and np.abs(step).max() < 1e-6:
            break
    return beta, dev


def fit_many(x: np.ndarray, y: np.ndarray, off: np.ndarray, phi: float | np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """``fit_counts`` of many genes of one design: (coefficients, deviances), a row of ``y`` and ``off`` each.

    All genes take a step together; those that have settled take no more part.
    """
    r = np.broadcast_to(1 / np.asarray(phi, float), len(y))[:, None]

    def deviance(g, beta):
        mu = np.exp(np.clip(beta @ x.T + off[g], -40, 40))
        own = y[g]
        gain = np.where(own > 0, own * np.log(np.where(own > 0, own, 1) / mu), 0.0)
        return mu, 2 * (gain - (own + r[g]) * np.log((own + r[g]) / (mu + r[g]))).sum(1)

    beta = np.linalg.lstsq(x, (np.log(y + 0.25) - off).T, rcond=None)[0].T
    live = np.arange(len(y))
    mu, dev = deviance(live, beta)
    for _ in range(rounds):
        if not len(live):
            break
        m = mu[live]
        w = m * r[live] / (r[live] + m)
        root = np.sqrt(w)
        left = np.einsum("gn,ni,nj->gij", w, x, x, optimize=True)
        right = (w * (y[live] - m) / m) @ x
        try:
            step = np.linalg.solve(left, right[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:  # a design that some genes do not determine
            step = np.stack([np.linalg.lstsq(x * q[:, None], q * (a - b) / b, rcond=None)[0] for q, a, b in zip(root, y[live], m)])
        trying = np.arange(len(live))
        done = np.zeros(len(live), bool)
        new_mu, new = m.copy(), dev[live].copy()
        for _ in range(12):
            got_mu, got = deviance(live[trying], beta[live[trying]] + step[trying])
            fine = got <= dev[live[trying]] + 1e-12 * (1 + np.abs(dev[live[trying]]))
            new_mu[trying[fine]], new[trying[fine]], done[trying[fine]] = got_mu[fine], got[fine], True
            trying = trying[~fine]
            if not len(trying):
                break
            step[trying] /= 2
        go = live[done]
        change = dev[go] - new[done]
        beta[go] += step[done]
        mu[go], dev[go] = new_mu[done], new[done]
        live = go[(change >= 1e-9 * (np.abs(dev[go]) + 1e-3)) | (np.abs(step[done]).max(1) >= 1e-6)]
    return beta, dev


def _by_design(genes: list[list[dict]], columns: list[str]):
    """(places of the genes, one's observations, counts, offsets) of genes that have the same observations."""
    held: dict[tuple, list[int]] = {}
    for k, obs in enumerate(genes):
        held.setdefault(tuple(tuple(o[c] for c in columns) for o in obs), []).append(k)
    for at in held.values():
        yield at, genes[at[0]], np.array([[o["y"] for o in genes[k]] for k in at]), np.array([[o["off"] for o in genes[k]] for k in at])


def _design(obs: list[dict], columns: list[str], family: str) -> tuple[np.ndarray, list]:
    """Treatment columns of each factor, sum-to-zero ones of ``family``, and what each column stands for."""
    design, names = [np.ones(len(obs))], [None]
    for c in columns:
        levels = sorted({o[c] for o in obs})
        for v in levels[:-1] if c == family else levels[1:]:
            col = np.array([float(o[c] == v) for o in obs])
            if c == family:  # effects of a family sum to zero
                col -= np.array([float(o[c] == levels[-1]) for o in obs])
            design.append(col)
            names.append((c, v))
    return np.stack(design, 1), names


def _packed_counts(counts: DataFrame, gene: str, columns: list[str], value: str) -> DataFrame:
    """(gene, obs) with each observation's levels, count and offset: log libraries against their mean."""
    lib = counts.groupBy(*columns).agg(F.sum(value).cast("double").alias("lib"))
    lib = lib.withColumn("off", F.ln("lib") - F.avg(F.ln("lib")).over(Window.partitionBy()))
    held = counts.join(lib, columns).groupBy(gene).agg(F.array_sort(F.collect_list(F.struct(*columns, F.col(value).cast("double").alias("y"), "off"))).alias("obs"), F.sum(value).alias("total"))
    return held.where("total >= 10").select(F.col(gene).alias("gene"), "obs")


#: Dispersions among which moments choose.
MOMENT_GRID = np.geomspace(1e-3, 2.0, 25)


def moment_dispersion(counts: DataFrame, gene: str, columns: list[str], value: str, family: str = "strain") -> DataFrame:
    """(phi): the common dispersion at which the mean residual deviance of all genes comes closest to
    their mean residual degrees of freedom; of equally close ones the lowest.

    Genes of one design are fitted together at each of the grid's dispersions, batch by batch; only sums
    of a fixed width are gathered. Without genes that have more observations than coefficients there is no row.
    """

    def run(batches):
        for b in batches:
            out = {"k": [], "dev": [], "df": []}
            for _, obs, y, off in _by_design(b.column(1).to_pylist(), columns):
                x, _ = _design(obs, columns, family)
                if len(obs) > x.shape[1]:
                    for k, phi in enumerate(MOMENT_GRID):
                        out["k"] += [k] * len(y)
                        out["dev"] += fit_many(x, y, off, phi)[1].tolist()
                        out["df"] += [float(len(obs) - x.shape[1])] * len(y)
            yield pa.RecordBatch.from_arrays([pa.array(out["k"], pa.int32()), pa.array(out["dev"], pa.float64()), pa.array(out["df"], pa.float64())], ["k", "dev", "df"])

    fits = _packed_counts(counts, gene, columns, value).mapInArrow(run, "k int, dev double, df double")
    miss = fits.groupBy("k").agg(F.abs(F.avg("dev") - F.avg("df")).alias("miss"))
    found = miss.agg(F.min(F.struct("miss", "k"))["k"].alias("k")).where("k is not null")
    return found.select(F.element_at(F.array(*[F.lit(float(p)) for p in MOMENT_GRID]), F.col("k") + 1).alias("phi"))


def count_models(counts: DataFrame, gene: str, columns: list[str], value: str, phi: float | None = None, family: str = "strain") -> DataFrame:
    """(gene, term, log2fc, lr, pvalue, fdr): each gene's negative-binomial model of the factors in
    ``columns``, and likelihood ratios of the models without each level of ``family``.

    Genes of one design are fitted together, batch by batch. Without ``phi`` all genes share the dispersion that moments give.
    """
    packed = _packed_counts(counts, gene, columns, value)
    kind = dict(counts.dtypes)[gene]
    shared = moment_dispersion(counts, gene, columns, value, family) if phi is None else counts.sparkSession.createDataFrame([(phi,)], "phi double")

    def run(batches):
        for b in batches:
            out = {"gene": [], "term": [], "log2fc": [], "lr": [], "pvalue": []}
            names_of, disp = b.column(0).to_pylist(), np.array(b.column(2).to_pylist(), float)
            for at, obs, y, off in _by_design(b.column(1).to_pylist(), columns):
                x, names = _design(obs, columns, family)
                beta, full = fit_many(x, y, off, disp[at])
                mine = [i for i, n in enumerate(names) if n and n[0] == family]
                last = sorted({o[family] for o in obs})[-1]
                for i in [*mine, None]:
                    drop = [i] if i is not None else mine
                    lr = np.maximum(0.0, fit_many(np.delete(x, drop, 1), y, off, disp[at])[1] - full)
                    effect = (beta[:, i] if i is not None else -beta[:, mine].sum(1)) / np.log(2)
                    out["gene"] += [names_of[k] for k in at]
                    out["term"] += [str(names[i][1] if i is not None else last)] * len(at)
                    out["log2fc"] += effect.tolist()
                    out["lr"] += lr.tolist()
                    out["pvalue"] += [kernels.chi2_tail(v, len(drop)) for v in lr.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(out["gene"], type=b.schema.field(0).type), *[pa.array(out[k], pa.string() if k == "term" else pa.float64()) for k in ("term", "log2fc", "lr", "pvalue")]], ["gene", "term", "log2fc", "lr", "pvalue"])

    tested = packed.crossJoin(F.broadcast(shared)).mapInArrow(run, f"gene {kind}, term string, log2fc double, lr double, pvalue double")
    return with_fdr(tested, "pvalue", ["term"])


def design(rows: DataFrame, key: str, block: str, fit_on: DataFrame | None = None) -> DataFrame:
    """(key, block, feature, slot) of a baseline's design: ``ones``, ``strain``, ``gene`` or ``both``.

    ``both`` has the gene block before the strain block. Levels come from ``fit_on``; the first of each
    is the reference, and unseen ones have no entry.
    """
    if block == "ones":
        return rows.select(key, F.lit("ones").alias("block"), F.lit("1").alias("feature"), F.lit(1).alias("slot"))
    if block not in ("strain", "gene", "both"):
        raise ValueError(f"no design {block!r}")
    fit = fit_on if fit_on is not None else rows
    part = lambda c: one_hot(rows, key, c, fit).select(key, F.lit(c).alias("block"), F.col("feature").cast("string").alias("feature"), "slot")
    if block != "both":
        return part(block)
    width = fit.where("gene is not null").agg((F.countDistinct("gene") - 1).cast("int").alias("width"))
    return part("gene").unionByName(part("strain").crossJoin(F.broadcast(width)).withColumn("slot", F.col("slot") + F.col("width")).drop("width"))


def clone_correlations(values: DataFrame) -> DataFrame:
    """(base, id_1, id_2, n, pearson, spearman) of the members of each base over strains in which both have a value.

    ``values`` is (base, id, strain, value). Correlations of constants, and of fewer than two strains, are null.
    """
    v = values.where("value is not null and not isnan(value)")
    a = v.select("base", "strain", F.col("id").alias("id_1"), F.col("value").alias("x"))
    b = v.select("base", "strain", F.col("id").alias("id_2"), F.col("value").alias("y"))
    pairs = a.join(b, ["base", "strain"]).where("id_1 < id_2")
    of = ["base", "id_1", "id_2"]
    pairs = stash(pairs, "clones")
    ranked = mean_ranks_of(pairs, of, {"rx": "x", "ry": "y"})
    corr = lambda p, q, n: F.try_divide(F.covar_pop(p, q), F.stddev_pop(p) * F.stddev_pop(q)).alias(n)
    return ranked.groupBy(*of).agg(F.count("*").alias("n"), corr("x", "y", "pearson"), corr("rx", "ry", "spearman"))
