"""Queries over counts: normalisation, imputation, effects and tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from screenfold.operators import counts as C
from screenfold.operators import fitness as X
from screenfold.operators import windows as W
from screenfold.operators.scan import exact_quantiles, mean_ranks, numbered, running
from screenfold.plans.bindings import B1, B1D, SAMPLE, counts
from screenfold.plans.registry import query
from screenfold.plans.session import stash

S = list(SAMPLE)
KEYS = ["gene", *S]


def b1(spark, sf):
    return counts(spark, sf)


def b1d(spark, sf):
    return counts(spark, sf, "l_suppkey")


def b1_cpm(spark, sf):
    return C.cpm(b1(spark, sf), S)


def b1d_cpm(spark, sf):
    return C.cpm(b1d(spark, sf), S)


r6 = lambda c, n=None: F.round(c, 6).alias(n or c)


@query("c14_densify", f"WITH {B1} SELECT gene, strain, gen, rep, n FROM b1")
def c14(spark, sf):
    return b1(spark, sf)


@query("c21_lane_sum", f"""WITH {B1}, l AS (SELECT gene, strain, gen, rep, n FROM b1 WHERE rep = 0 UNION ALL SELECT gene, strain, gen, 0, n FROM b1 WHERE rep = 1
UNION ALL SELECT gene, strain, gen, 0, n FROM b1 WHERE rep = 2 AND gene % 10 <> 0)
SELECT gene, strain, gen, CAST(CASE WHEN count(*) = 3 THEN sum(n) END AS BIGINT) AS n FROM l GROUP BY gene, strain, gen""")
def c21(spark, sf):
    lanes = [b1(spark, sf).where(F.col("rep") == k).where((F.col("gene") % 10 != 0) if k == 2 else F.lit(True)).drop("rep") for k in range(3)]
    return C.lane_sum(lanes, ["gene", "strain", "gen"])


@query("a01_library_size", f"WITH {B1} SELECT strain, gen, rep, CAST(sum(n) AS BIGINT) AS library FROM b1 GROUP BY ALL")
def a01(spark, sf):
    return b1(spark, sf).withColumn("library", C.library_size(S)).select(*S, "library").distinct()


@query("c16_zero_genes", f"WITH {B1} SELECT gene, CAST(count(*) FILTER (n = 0) AS BIGINT) AS zero_cells FROM b1 GROUP BY gene HAVING count(*) FILTER (n = 0) > 0")
def c16(spark, sf):
    return b1(spark, sf).groupBy("gene").agg(F.count_if(F.col("n") == 0).alias("zero_cells")).where("zero_cells > 0")


@query("x01_cpm", f"WITH {B1} SELECT gene, strain, gen, rep, round(cpm, 6) AS cpm FROM c")
def x01(spark, sf):
    return b1_cpm(spark, sf).select(*KEYS, r6("cpm"))


@query("x02_cpm_unguarded", f"WITH {B1}, z AS (SELECT *, CASE WHEN strain = 'A' AND rep = 0 THEN 0 ELSE n END AS m FROM b1) SELECT gene, strain, gen, rep, round(m * 1e6 / nullif(sum(m) OVER (PARTITION BY strain, gen, rep), 0), 6) AS cpm FROM z")
def x02(spark, sf):
    z = b1(spark, sf).withColumn("n", F.when((F.col("strain") == "A") & (F.col("rep") == 0), 0).otherwise(F.col("n")))
    return C.cpm(z, S, guard=False).select(*KEYS, r6("cpm"))


@query("x06_half_even", f"WITH {B1} SELECT gene, strain, gen, rep, CAST(round_even(n / 4.0::DOUBLE, 0) AS BIGINT) AS quarter FROM b1")
def x06(spark, sf):
    return b1(spark, sf).select(*KEYS, F.bround(F.col("n") / 4, 0).cast("long").alias("quarter"))


@query("x07_logs", f"WITH {B1} SELECT gene, strain, gen, rep, round(log2(cpm + 1), 6) AS log2p, round(ln(cpm + 1), 6) AS log1p FROM c")
def x07(spark, sf):
    return b1_cpm(spark, sf).select(*KEYS, r6(F.log2(F.col("cpm") + 1), "log2p"), r6(F.log1p("cpm"), "log1p"))


TMM = f"""{B1D}, s AS (SELECT gene, strain || '_' || gen || '_' || rep AS s, CAST(n AS DOUBLE) AS n FROM b1),
g AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY gene) AS gt FROM s) WHERE gt > 0),
q AS (SELECT s, sum(n) AS lib, quantile_cont(n, 0.75) / sum(n) AS uq FROM g GROUP BY s),
qr AS (SELECT *, first_value(s) OVER (ORDER BY abs(uq - m), s) AS ref FROM (SELECT *, avg(uq) OVER () AS m FROM q)),
w AS (SELECT g.gene, g.s, g.n, q.lib, q.ref FROM g JOIN qr q ON g.s = q.s),
p AS (SELECT a.s, a.gene, log2((a.n / a.lib) / (b.n / b.lib)) AS m, log2((a.n / a.lib) * (b.n / b.lib)) / 2 AS a,
  (a.lib - a.n) / (a.lib * a.n) + (b.lib - b.n) / (b.lib * b.n) AS v
  FROM w a JOIN w b ON a.gene = b.gene AND b.s = b.ref WHERE a.s <> a.ref AND a.n > 0 AND b.n > 0),
k AS (SELECT *, count(*) OVER (PARTITION BY s) AS k, rank() OVER (PARTITION BY s ORDER BY m) + (count(*) OVER (PARTITION BY s, m) - 1) / 2.0 AS rm,
  rank() OVER (PARTITION BY s ORDER BY a) + (count(*) OVER (PARTITION BY s, a) - 1) / 2.0 AS ra FROM p),
f AS (SELECT s, sum(m / v) / sum(1 / v) AS f FROM k WHERE rm BETWEEN floor(k * 0.3) + 1 AND k - floor(k * 0.3) AND ra BETWEEN floor(k * 0.05) + 1 AND k - floor(k * 0.05) GROUP BY s),
tf AS (SELECT s, exp(f * ln(2) - avg(f * ln(2)) OVER ()) AS factor FROM (SELECT q.s, coalesce(f.f, 0) AS f FROM q LEFT JOIN f ON q.s = f.s))"""


def _b1d_named(spark, sf):
    return b1d(spark, sf).withColumn("s", F.concat_ws("_", "strain", F.col("gen").cast("string"), F.col("rep").cast("string")))


@query("t10_tmm", f"WITH {TMM} SELECT s, round(factor, 6) AS factor FROM tf")
def t10(spark, sf):
    return C.trimmed_mean_factors(_b1d_named(spark, sf), "gene", "s").select("s", r6("factor"))


@query("t11_tmm_cpm", f"WITH {TMM} SELECT s.gene, s.s, round(s.n * 1e6 / (q.lib * tf.factor), 5) AS cpm FROM s JOIN q ON s.s = q.s JOIN tf ON s.s = tf.s")
def t11(spark, sf):
    rows = _b1d_named(spark, sf)
    rows = rows.withColumn("lib", C.library_size(["s"])).join(C.trimmed_mean_factors(rows, "gene", "s"), "s")
    return rows.select("gene", "s", F.round(F.col("n") * 1e6 / (F.col("lib") * F.col("factor")), 5).alias("cpm"))


def _mask(rule):
    pred = "bool_and(n = 0)" if rule == "all_zero" else "bool_or(n = 0)"
    return f"""{B1}, pr AS (SELECT gene, strain, bool_and(cpm >= 20) FILTER (gen = 0) AS present, {pred} FILTER (gen = 10) AS dropped FROM c GROUP BY gene, strain),
m AS (SELECT c.*, c.gen = 10 AND c.n = 0 AND coalesce(present, false) AND coalesce(dropped, false) AS imputed FROM c JOIN pr ON c.gene = pr.gene AND c.strain = pr.strain),
f AS (SELECT *, n + CASE WHEN imputed THEN 1 ELSE 0 END AS filled FROM m),
i AS (SELECT gene, strain, gen, rep, imputed, filled * 1e6 / sum(filled) OVER (PARTITION BY strain, gen, rep) AS cpm FROM f),
fc AS (SELECT gene, strain, avg(cpm) FILTER (gen = 0) AS mean0, avg(cpm) FILTER (gen = 10) AS mean10 FROM i GROUP BY gene, strain)"""


ALL, ANY = _mask("all_zero"), _mask("any_zero")


def imputed(spark, sf, rule="all_zero"):
    return C.impute_mask(b1_cpm(spark, sf), "gene", "strain", "gen", rule=rule)


def normalised(spark, sf, rule="all_zero"):
    return C.add_pseudocount(imputed(spark, sf, rule), S)


for _rule, _sql in (("all", ALL), ("any", ANY)):

    @query(f"t12_impute_{_rule}", f"WITH {_sql} SELECT gene, strain, gen, rep, imputed FROM m WHERE imputed")
    def t12(spark, sf, rule=f"{_rule}_zero"):
        return imputed(spark, sf, rule).where("imputed").select(*KEYS, "imputed")


@query("t13_renorm", f"WITH {ANY} SELECT gene, strain, gen, rep, round(cpm, 6) AS cpm FROM i")
def t13(spark, sf):
    return normalised(spark, sf, "any_zero").select(*KEYS, r6("cpm"))


@query("a36_imputed", f"WITH {ANY} SELECT strain, rep, CAST(count(*) FILTER (imputed) AS BIGINT) AS cells, CAST(count(DISTINCT gene) FILTER (imputed) AS BIGINT) AS genes FROM m WHERE gen = 10 GROUP BY ALL")
def a36(spark, sf):
    return imputed(spark, sf, "any_zero").where("gen = 10").groupBy("strain", "rep").agg(F.count_if(F.col("imputed")).alias("cells"), F.countDistinct(F.when(F.col("imputed"), F.col("gene"))).alias("genes"))


@query("x03_log2fc", f"WITH {ANY} SELECT gene, strain, round(log2(greatest(mean10, 1e-8) / greatest(mean0, 1e-8)), 6) AS log2fc FROM fc")
def x03(spark, sf):
    return X.arm_means(normalised(spark, sf, "any_zero"), ["gene", "strain"], "gen", "cpm").select("gene", "strain", r6(X.log2_ratio_floored("mean10", "mean0"), "log2fc"))


REP = f"{B1}, rf AS (SELECT gene, strain, rep, log2(nullif(max(cpm) FILTER (gen = 10), 0) / nullif(max(cpm) FILTER (gen = 0), 0)) AS fitness FROM c GROUP BY ALL)"


@query("x04_rep_fitness", f"WITH {REP} SELECT gene, strain, rep, round(fitness, 6) AS fitness FROM rf")
def x04(spark, sf):
    return X.replicate_fitness(b1_cpm(spark, sf), ["gene", "strain"], "rep", "gen", "cpm").select("gene", "strain", "rep", r6("fitness"))


@query("x05_avg_fitness", f"WITH {REP} SELECT gene, strain, round(avg(fitness), 6) AS fitness FROM rf GROUP BY ALL")
def x05(spark, sf):
    return X.replicate_fitness(b1_cpm(spark, sf), ["gene", "strain"], "rep", "gen", "cpm").groupBy("gene", "strain").agg(r6(F.avg("fitness"), "fitness"))


DEV = "2 * (CASE WHEN y > 0 THEN y * ln(y / {mu}) ELSE 0 END - (y + 10) * ln((y + 10) / ({mu} + 10)))"
LRT = f"""{B1D}, y AS (SELECT gene, strain, gen, cpm AS y, greatest(avg(cpm) OVER (PARTITION BY gene, strain), 1e-8) AS mu, greatest(avg(cpm) OVER (PARTITION BY gene, strain, gen), 1e-8) AS am FROM c),
lrt AS (SELECT gene, strain, max(am) FILTER (gen = 0) AS mean0, max(am) FILTER (gen = 10) AS mean10, greatest(0, sum({DEV.format(mu='mu')} - {DEV.format(mu='am')})) AS lr, sum({DEV.format(mu='mu')}) AS dev FROM y GROUP BY gene, strain)"""


@query("t02_deviance", f"WITH {LRT} SELECT gene, strain, round(dev, 5) AS deviance FROM lrt")
def t02(spark, sf):
    rows = b1d_cpm(spark, sf).withColumn("mu", F.greatest(F.avg("cpm").over(Window.partitionBy("gene", "strain")), F.lit(1e-8)))
    return rows.groupBy("gene", "strain").agg(F.round(F.sum(X.deviance_term(F.col("cpm"), F.col("mu"), 0.1)), 5).alias("deviance"))


@query("t06_lrt_stat", f"WITH {LRT} SELECT gene, strain, round(log2(mean10 / mean0), 6) AS log2fc, round(lr, 5) AS lr FROM lrt")
def t06(spark, sf):
    return X.likelihood_ratio(b1d_cpm(spark, sf), ["gene", "strain"], "gen", "cpm", 0.1).select("gene", "strain", r6("log2fc"), F.round("lr", 5).alias("lr"))


@query("t04_dispersion")
def t04(spark, sf):
    return X.estimate_dispersions(b1d_cpm(spark, sf), "gene", "strain", "gen", "cpm")


@query("t07_fitness_table")
def t07(spark, sf):
    return X.fitness_table(b1d_cpm(spark, sf), "gene", "strain", "gen", "cpm")


@query("w01_bh", f"""WITH {B1}, p AS (SELECT gene, strain, gen, rep, (n % 97 + 1) / 200.0::DOUBLE AS p FROM b1),
k AS (SELECT *, p * count(*) OVER (PARTITION BY strain) / row_number() OVER (PARTITION BY strain ORDER BY p) AS v FROM p)
SELECT gene, strain, gen, rep, round(least(1, min(v) OVER (PARTITION BY strain ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS fdr FROM k""")
def w01(spark, sf):
    p = b1(spark, sf).select(*KEYS, ((F.col("n") % 97 + 1) / F.lit(200.0)).alias("p"))
    return W.with_fdr(p, "p", ["strain"]).select(*KEYS, r6("fdr"))


@query("w02_smooth", f"""WITH {B1D}, m AS (SELECT gene, strain, avg(cpm) AS level FROM c GROUP BY ALL)
SELECT gene, strain, round(avg(level) OVER (PARTITION BY strain ORDER BY round(level, 6), gene ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 5) AS smooth FROM m""")
def w02(spark, sf):
    m = b1d_cpm(spark, sf).groupBy("gene", "strain").agg(F.avg("cpm").alias("level")).withColumn("o", F.round("level", 6))
    return W.moving_mean(m, ["strain"], ["o", "gene"], "level", 5, "smooth").select("gene", "strain", F.round("smooth", 5).alias("smooth"))


@query("w03_revcum", f"WITH {B1D}, h AS (SELECT n AS k, CAST(count(*) AS BIGINT) AS cells FROM b1 GROUP BY n) SELECT k, cells, CAST(sum(cells) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS at_least FROM h")
def w03(spark, sf):
    h = b1d(spark, sf).groupBy(F.col("n").alias("k")).agg(F.count("*").alias("cells"))
    return W.reverse_cumulative(h, [], "k", "cells", "at_least")


@query("w05_avg_rank", f"WITH {B1D} SELECT gene, strain, gen, rep, CAST(rank() OVER (PARTITION BY strain, gen, rep ORDER BY n) + (count(*) OVER (PARTITION BY strain, gen, rep, n) - 1) / 2.0 AS DOUBLE) AS r FROM b1")
def w05(spark, sf):
    return mean_ranks(b1d(spark, sf), S, "n", "r").select(*KEYS, "r")


@query("w06_group_bcast", f"WITH {B1D} SELECT gene, strain, gen, rep, round(avg(cpm) OVER (PARTITION BY gene, strain), 5) AS group_mean FROM c")
def w06(spark, sf):
    return b1d_cpm(spark, sf).select(*KEYS, F.round(F.avg("cpm").over(Window.partitionBy("gene", "strain")), 5).alias("group_mean"))


@query("a09_quantiles", f"WITH {REP} SELECT strain, round(quantile_cont(fitness, 0.25), 6) AS q1, round(median(fitness), 6) AS med, round(quantile_cont(fitness, 0.75), 6) AS q3, round(min(fitness), 6) AS low FROM rf GROUP BY strain")
def a09(spark, sf):
    f = X.replicate_fitness(b1_cpm(spark, sf), ["gene", "strain"], "rep", "gen", "cpm")
    q = exact_quantiles(f, ["strain"], "fitness", [0.25, 0.5, 0.75])
    return q.join(f.groupBy("strain").agg(F.min("fitness").alias("low")), "strain").select("strain", r6(F.col("q")[0], "q1"), r6(F.col("q")[1], "med"), r6(F.col("q")[2], "q3"), r6("low"))


@query("a10_pctl", f"WITH {B1} SELECT strain, gen, rep, round(quantile_cont(CAST(n AS DOUBLE), 0.1), 6) AS p10 FROM b1 WHERE n > 0 GROUP BY ALL")
def a10(spark, sf):
    return exact_quantiles(b1(spark, sf).where("n > 0"), S, "n", [0.1]).select(*S, r6(F.col("q")[0], "p10"))


@query("a12_rep_corr", f"""WITH {B1D}, l AS (SELECT *, log2(cpm + 1) AS v FROM c),
p AS (SELECT a.strain, a.gen, a.rep AS r1, b.rep AS r2, corr(a.v, b.v) AS r FROM l a JOIN l b ON a.gene = b.gene AND a.strain = b.strain AND a.gen = b.gen AND a.rep < b.rep GROUP BY ALL)
SELECT strain, gen, CAST(count(*) AS BIGINT) AS pairs, round(avg(r), 6) AS mean_r, round(min(r), 6) AS min_r FROM p GROUP BY ALL""")
def a12(spark, sf):
    v = b1d_cpm(spark, sf).select(*KEYS, F.log2(F.col("cpm") + 1).alias("v"))
    a, b = v.alias("a"), v.select("gene", "strain", "gen", F.col("rep").alias("rep2"), F.col("v").alias("v2"))
    both = v.join(b, ["gene", "strain", "gen"]).where("rep < rep2").groupBy("strain", "gen", "rep", "rep2").agg(F.when((F.var_pop("v") > 0) & (F.var_pop("v2") > 0), F.try_divide(F.covar_pop("v", "v2"), F.stddev_pop("v") * F.stddev_pop("v2"))).alias("r"))
    return both.groupBy("strain", "gen").agg(F.count("*").alias("pairs"), r6(F.avg("r"), "mean_r"), r6(F.min("r"), "min_r"))


PAIR = f"{B1D}, pr AS (SELECT gene, strain, max(cpm) FILTER (gen = 0 AND rep = 0) AS x, max(cpm) FILTER (gen = 0 AND rep = 1) AS y FROM c GROUP BY ALL)"


def _pairs(spark, sf):
    pick = lambda k: F.max(F.when((F.col("gen") == 0) & (F.col("rep") == k), F.col("cpm")))
    return b1d_cpm(spark, sf).groupBy("gene", "strain").agg(pick(0).alias("x"), pick(1).alias("y"))


@query("a13_pair_corr", f"WITH {PAIR} SELECT strain, round(corr(x, y), 6) AS r FROM pr GROUP BY strain")
def a13(spark, sf):
    return _pairs(spark, sf).groupBy("strain").agg(r6(F.corr("x", "y"), "r"))


@query("a14_spearman", f"""WITH {PAIR}, k AS (SELECT strain, rank() OVER (PARTITION BY strain ORDER BY x) + (count(*) OVER (PARTITION BY strain, x) - 1) / 2.0 AS a,
rank() OVER (PARTITION BY strain ORDER BY y) + (count(*) OVER (PARTITION BY strain, y) - 1) / 2.0 AS b FROM pr) SELECT strain, round(corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE)), 6) AS rho FROM k GROUP BY strain""")
def a14(spark, sf):
    k = mean_ranks(mean_ranks(_pairs(spark, sf), ["strain"], "x", "a"), ["strain"], "y", "b")
    return k.groupBy("strain").agg(r6(F.corr("a", "b"), "rho"))


@query("t38_compare", f"""WITH {PAIR} SELECT strain, CAST(count(*) AS BIGINT) AS n, round(corr(x, y), 6) AS pearson, round(median(abs(x - y)), 5) AS median_diff, round(max(abs(x - y)), 5) AS max_diff FROM pr WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY strain""")
def t38(spark, sf):
    d = F.abs(F.col("x") - F.col("y"))
    return _pairs(spark, sf).where("x is not null and y is not null").groupBy("strain").agg(F.count("*").alias("n"), r6(F.corr("x", "y"), "pearson"), F.round(F.median(d), 5).alias("median_diff"), F.round(F.max(d), 5).alias("max_diff"))


@query("t36_null_corr")
def t36(spark, sf):
    """Percentiles of correlations between seeded pairs of genes across samples."""
    v = b1d_cpm(spark, sf).groupBy("gene").agg(F.transform(F.array_sort(F.collect_list(F.struct(*S, "cpm"))), lambda s: s["cpm"]).alias("v"))
    k = numbered(v, [F.xxhash64("gene", F.lit(1)), F.col("gene")], "k")
    pairs = k.alias("a").join(k.alias("b"), F.expr("a.k + 1 = b.k")).select(F.col("a.gene").alias("g"), F.explode(F.arrays_zip(F.col("a.v").alias("x"), F.col("b.v").alias("y"))).alias("z"))
    r = pairs.groupBy("g").agg(F.when((F.var_pop("z.x") > 0) & (F.var_pop("z.y") > 0), F.try_divide(F.covar_pop("z.x", "z.y"), F.stddev_pop("z.x") * F.stddev_pop("z.y"))).alias("r"))
    return exact_quantiles(r, [], "r", [0.05, 0.25, 0.5, 0.75, 0.95]).select(F.posexplode("q").alias("at", "r"))


@query("f01_split_arms", f"WITH {B1} SELECT gene, strain, CAST(sum(n) FILTER (gen = 0) AS BIGINT) AS n0, CAST(sum(n) FILTER (gen = 10) AS BIGINT) AS n10 FROM b1 GROUP BY ALL")
def f01(spark, sf):
    return b1(spark, sf).groupBy("gene", "strain").agg(F.sum(F.when(F.col("gen") == 0, F.col("n"))).alias("n0"), F.sum(F.when(F.col("gen") == 10, F.col("n"))).alias("n10"))


@query("f05_nonzero", f"WITH {B1} SELECT gene, strain, CAST(count(*) AS BIGINT) AS cells FROM b1 GROUP BY ALL HAVING sum(n) > 0")
def f05(spark, sf):
    return b1(spark, sf).withColumn("t", F.sum("n").over(Window.partitionBy("gene", "strain"))).where("t > 0").groupBy("gene", "strain").agg(F.count("*").alias("cells"))


@query("f06_min_reps", f"""WITH {B1}, z AS (SELECT * FROM b1 WHERE n > 0), k AS (SELECT gene, strain FROM z GROUP BY ALL HAVING count(DISTINCT rep) FILTER (gen = 0) >= 2 AND count(DISTINCT rep) FILTER (gen = 10) >= 2)
SELECT z.gene, z.strain, z.gen, z.rep, z.n FROM z SEMI JOIN k ON z.gene = k.gene AND z.strain = k.strain""")
def f06(spark, sf):
    z = b1(spark, sf).where("n > 0")
    reps = lambda g: F.countDistinct(F.when(F.col("gen") == g, F.col("rep")))
    ok = z.groupBy("gene", "strain").agg(reps(0).alias("a"), reps(10).alias("b")).where("a >= 2 and b >= 2")
    return z.join(ok, ["gene", "strain"], "left_semi").select(*KEYS, "n")


@query("f07_min_total", f"WITH {B1} SELECT gene, CAST(sum(n) AS BIGINT) AS total FROM b1 GROUP BY gene HAVING sum(n) >= 700")
def f07(spark, sf):
    return b1(spark, sf).groupBy("gene").agg(F.sum("n").alias("total")).where("total >= 700")


@query("f08_exclude", f"WITH {B1} SELECT strain, gen, rep, CAST(sum(n) AS BIGINT) AS total FROM b1 WHERE strain || rep NOT IN ('A0', 'R2') GROUP BY ALL")
def f08(spark, sf):
    return b1(spark, sf).where(~F.concat("strain", F.col("rep").cast("string")).isin("A0", "R2")).groupBy(*S).agg(F.sum("n").alias("total"))


@query("f16_finite", f"WITH {REP} SELECT strain, CAST(count(*) FILTER (fitness IS NOT NULL) AS BIGINT) AS finite, CAST(count(*) AS BIGINT) AS n FROM rf GROUP BY strain")
def f16(spark, sf):
    f = X.replicate_fitness(b1_cpm(spark, sf), ["gene", "strain"], "rep", "gen", "cpm")
    ok = F.col("fitness").isNotNull() & ~F.isnan("fitness") & (F.abs("fitness") < float("inf"))
    return f.groupBy("strain").agg(F.count_if(ok).alias("finite"), F.count("*").alias("n"))


@query("f17_null_audit", f"WITH {REP} SELECT gene, strain, rep FROM rf WHERE fitness IS NULL")
def f17(spark, sf):
    return X.replicate_fitness(b1_cpm(spark, sf), ["gene", "strain"], "rep", "gen", "cpm").where("fitness is null").select("gene", "strain", "rep")


@query("a22_hist100", f"""WITH {REP}, v AS (SELECT fitness AS x, min(fitness) OVER () AS lo, max(fitness) OVER () AS hi FROM rf WHERE fitness IS NOT NULL)
SELECT CAST(least(floor((x - lo) / ((hi - lo) / 100)) + 1, 100) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY ALL""")
def a22(spark, sf):
    f = X.replicate_fitness(b1_cpm(spark, sf), ["gene", "strain"], "rep", "gen", "cpm").where("fitness is not null").select("fitness")
    ends = f.agg(F.min("fitness").alias("lo"), F.max("fitness").alias("hi"))
    at = F.floor((F.col("fitness") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 100)) + 1
    return f.crossJoin(ends).groupBy(F.least(at, F.lit(100)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("a33_abs_pctl", f"WITH {REP} SELECT round(quantile_cont(abs(fitness), 0.98), 6) AS p98 FROM rf")
def a33(spark, sf):
    f = X.replicate_fitness(b1_cpm(spark, sf), ["gene", "strain"], "rep", "gen", "cpm").withColumn("size", F.abs("fitness"))
    return exact_quantiles(f, [], "size", [0.98]).select(r6(F.col("q")[0], "p98"))


@query("o13_row_mean", f"WITH {REP}, m AS (SELECT gene, round(avg(fitness), 6) AS mean FROM rf GROUP BY gene) SELECT gene, mean, CAST(row_number() OVER (ORDER BY mean DESC NULLS LAST, gene) AS INTEGER) AS place FROM m")
def o13(spark, sf):
    m = X.replicate_fitness(b1_cpm(spark, sf), ["gene", "strain"], "rep", "gen", "cpm").groupBy("gene").agg(r6(F.avg("fitness"), "mean"))
    return numbered(m, [F.col("mean").desc_nulls_last(), F.col("gene")], "place")


@query("t29_offsets", f"WITH {B1D}, l AS (SELECT strain, gen, rep, CAST(sum(n) AS DOUBLE) AS lib FROM b1 GROUP BY ALL) SELECT strain, gen, rep, round(ln(lib) - avg(ln(lib)) OVER (), 6) AS off FROM l")
def t29(spark, sf):
    lib = b1d(spark, sf).groupBy(*S).agg(F.sum("n").cast("double").alias("lib"))
    return lib.select(*S, r6(F.ln("lib") - F.avg(F.ln("lib")).over(Window.partitionBy()), "off"))


@query("r01_melt", f"WITH {B1}, w AS (SELECT gene, strain, CAST(sum(n) FILTER (gen = 0) AS BIGINT) AS gen0, CAST(sum(n) FILTER (gen = 10) AS BIGINT) AS gen10 FROM b1 GROUP BY ALL) UNPIVOT w ON gen0, gen10 INTO NAME arm VALUE n")
def r01(spark, sf):
    w = b1(spark, sf).groupBy("gene", "strain").pivot("gen", [0, 10]).agg(F.sum("n")).withColumnsRenamed({"0": "gen0", "10": "gen10"})
    return w.unpivot(["gene", "strain"], ["gen0", "gen10"], "arm", "n")


@query("r02_pivot", f"WITH {REP} SELECT gene, round(avg(fitness) FILTER (strain = 'A'), 6) AS A, round(avg(fitness) FILTER (strain = 'N'), 6) AS N, round(avg(fitness) FILTER (strain = 'R'), 6) AS R FROM rf GROUP BY gene")
def r02(spark, sf):
    return X.replicate_fitness(b1_cpm(spark, sf), ["gene", "strain"], "rep", "gen", "cpm").groupBy("gene").pivot("strain", ["A", "N", "R"]).agg(F.round(F.avg("fitness"), 6))


@query("r03_mean_pivot", f"WITH {B1} SELECT strain, round(avg(cpm) FILTER (gen = 0), 6) AS g0, round(avg(cpm) FILTER (gen = 10), 6) AS g10 FROM c GROUP BY strain")
def r03(spark, sf):
    return b1_cpm(spark, sf).groupBy("strain").pivot("gen", [0, 10]).agg(F.round(F.avg("cpm"), 6)).withColumnsRenamed({"0": "g0", "10": "g10"})


@query("t32_severity", f"""WITH {ANY}, s AS (SELECT fc.gene, fc.strain, log2(greatest(mean10, 1e-8) / greatest(mean0, 1e-8)) AS f FROM fc ANTI JOIN (SELECT DISTINCT gene, strain FROM m WHERE imputed) d ON fc.gene = d.gene AND fc.strain = d.strain WHERE mean0 > 0 AND mean10 > 0)
SELECT strain, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(f, 0.25), 6) AS q1, round(median(f), 6) AS med, round(quantile_cont(f, 0.75), 6) AS q3 FROM s WHERE f < 0 GROUP BY strain""")
def t32(spark, sf):
    marked = normalised(spark, sf, "any_zero")
    means = X.arm_means(marked, ["gene", "strain"], "gen", "cpm").where("mean0 > 0 and mean10 > 0").join(marked.where("imputed").select("gene", "strain").distinct(), ["gene", "strain"], "left_anti")
    f = means.select("strain", X.log2_ratio_floored("mean10", "mean0").alias("f")).where("f < 0")
    return exact_quantiles(f, ["strain"], "f", [0.25, 0.5, 0.75]).join(f.groupBy("strain").agg(F.count("*").alias("n")), "strain").select("strain", "n", r6(F.col("q")[0], "q1"), r6(F.col("q")[1], "med"), r6(F.col("q")[2], "q3"))


# smaller pieces of the operators above, each on its own


@query("f02_regex_groups", "WITH w AS (SELECT DISTINCT 'S' || l_returnflag || '_Rep' || (l_linenumber % 3) || '_Gen' || CASE WHEN l_linestatus = 'F' THEN 0 ELSE 10 END AS col FROM lineitem) SELECT col, regexp_extract(col, '^S([A-Z])_', 1) AS strain, CAST(regexp_extract(col, '_Rep([0-9]+)', 1) AS INTEGER) AS rep, CAST(regexp_extract(col, '_Gen([0-9]+)$', 1) AS INTEGER) AS gen FROM w")
def f02(spark, sf):
    from screenfold.plans.bindings import table

    arm = F.when(F.col("l_linestatus") == "F", "0").otherwise("10")
    w = table(spark, sf, "lineitem").select(F.concat(F.lit("S"), "l_returnflag", F.lit("_Rep"), (F.col("l_linenumber") % 3).cast("string"), F.lit("_Gen"), arm).alias("col")).distinct()
    part = lambda p: F.regexp_extract("col", p, 1)
    return w.select("col", part("^S([A-Z])_").alias("strain"), part("_Rep([0-9]+)").cast("int").alias("rep"), part("_Gen([0-9]+)$").cast("int").alias("gen"))


@query("f04_suffix_split", f"WITH {B1} SELECT gene, strain, round(avg(cpm) FILTER (gen = 10), 6) AS log2FC, round(avg(cpm) FILTER (gen = 0), 6) AS FDR FROM c GROUP BY ALL")
def f04(spark, sf):
    """Wide columns named strain_measure back to a row for each strain."""
    wide = b1_cpm(spark, sf).withColumn("k", F.concat("strain", F.when(F.col("gen") == 10, "_log2FC").otherwise("_FDR")))
    names = [f"{s}_{m}" for s in "ANR" for m in ("log2FC", "FDR")]
    wide = wide.groupBy("gene").pivot("k", names).agg(F.avg("cpm"))
    long = wide.unpivot(["gene"], names, "k", "v").select("gene", F.regexp_extract("k", "^(.*)_(log2FC|FDR)$", 1).alias("strain"), F.regexp_extract("k", "(log2FC|FDR)$", 1).alias("m"), "v")
    return long.groupBy("gene", "strain").pivot("m", ["log2FC", "FDR"]).agg(F.round(F.max("v"), 6))


@query("t03_apl")
def t03(spark, sf):
    """The adjusted profile likelihood's best grid point of each gene alone, which no prior pulls."""
    return X.estimate_dispersions(b1d_cpm(spark, sf), "gene", "strain", "gen", "cpm", prior_df=1e-9).select("strain", "gene", F.col("tagwise").alias("own"))


@query("a02_arm_means", f"WITH {B1} SELECT gene, strain, round(avg(cpm) FILTER (gen = 0), 6) AS mean0, round(avg(cpm) FILTER (gen = 10), 6) AS mean10 FROM c GROUP BY ALL")
def a02(spark, sf):
    return X.arm_means(b1_cpm(spark, sf), ["gene", "strain"], "gen", "cpm").select("gene", "strain", r6("mean0"), r6("mean10"))


@query("a03_all_any", f"WITH {B1} SELECT gene, strain, gen, bool_and(n = 0) AS all_zero, bool_or(n = 0) AS any_zero FROM b1 GROUP BY ALL")
def a03(spark, sf):
    return b1(spark, sf).groupBy("gene", "strain", "gen").agg(F.every(F.col("n") == 0).alias("all_zero"), F.bool_or(F.col("n") == 0).alias("any_zero"))


@query("a11_upper_quartile", f"WITH {B1D} SELECT strain, gen, rep, round(quantile_cont(CAST(n AS DOUBLE), 0.75) / sum(n), 9) AS uq FROM b1 GROUP BY ALL")
def a11(spark, sf):
    rows = b1d(spark, sf)
    return exact_quantiles(rows, S, "n", [0.75]).join(rows.groupBy(*S).agg(F.sum("n").alias("lib")), S).select(*S, F.round(F.col("q")[0] / F.col("lib"), 9).alias("uq"))


@query("a15_differences", f"WITH {PAIR} SELECT strain, round(median(abs(x - y)), 5) AS median_diff, round(max(abs(x - y)), 5) AS max_diff FROM pr GROUP BY strain")
def a15(spark, sf):
    d = F.abs(F.col("x") - F.col("y"))
    rows = _pairs(spark, sf).withColumn("d", d)
    return exact_quantiles(rows, ["strain"], "d", [0.5]).join(rows.groupBy("strain").agg(F.max("d").alias("most")), "strain").select("strain", F.round(F.col("q")[0], 5).alias("median_diff"), F.round("most", 5).alias("max_diff"))


@query("w04_prefix_mean", f"""WITH {B1D}, m AS (SELECT gene, strain, avg(cpm) AS level FROM c GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY strain ORDER BY round(level, 6), gene) AS rn, count(*) OVER (PARTITION BY strain) AS n FROM m)
SELECT a.gene, a.strain, round(avg(b.level), 5) AS smooth FROM k a JOIN k b ON a.strain = b.strain AND abs(a.rn - b.rn) <= greatest(3, CAST(round_even(0.3::DOUBLE * a.n, 0) AS INTEGER)) // 2 GROUP BY a.gene, a.strain""")
def w04(spark, sf):
    """A moving mean whose width follows the number of genes: differences of running sums."""
    m = b1d_cpm(spark, sf).groupBy("gene", "strain").agg(F.avg("cpm").alias("level")).withColumn("o", F.round("level", 6))
    k = running(m, [F.col("o"), F.col("gene")], {"rn": ("count", F.lit(1)), "sums": ("sum", F.col("level"))}, ["strain"])
    k = stash(k.join(k.groupBy("strain").agg(F.count("*").alias("n")), "strain"), "sums")
    half = F.floor(F.greatest(F.lit(3), F.bround(F.lit(0.3) * F.col("n")).cast("int")) / 2)
    k = k.withColumn("hi", F.least(F.col("n"), F.col("rn") + half)).withColumn("lo", F.greatest(F.lit(0), F.col("rn") - half - 1))
    ends = k.select(F.col("strain").alias("s"), F.col("rn").alias("at"), F.col("sums").alias("v"))
    up = k.join(ends, (F.col("strain") == F.col("s")) & (F.col("hi") == F.col("at"))).withColumnRenamed("v", "top").drop("s", "at")
    both = up.join(ends, (F.col("strain") == F.col("s")) & (F.col("lo") == F.col("at")), "left")
    return both.select("gene", "strain", F.round((F.col("top") - F.coalesce("v", F.lit(0.0))) / (F.col("hi") - F.col("lo")), 5).alias("smooth"))
