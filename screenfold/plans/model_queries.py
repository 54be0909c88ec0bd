"""Queries of splits with models on top."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from screenfold.operators import fitness as X
from screenfold.operators import linkage as L
from screenfold.operators import models as M
from screenfold.operators import sparse as P
from screenfold.operators.counts import cpm
from screenfold.plans.bindings import B1, B1D, B2, SAMPLE, counts, many_strains, table
from screenfold.plans.registry import query

r6 = lambda c, n=None: F.round(c, 6).alias(n or c)
SPLIT = "CASE WHEN {g} % 20 < 14 THEN 'train' WHEN {g} % 20 < 17 THEN 'val' ELSE 'test' END"
SC = f"""{B1}, rf AS (SELECT gene, strain, rep, log2(nullif(max(cpm) FILTER (gen = 10), 0) / nullif(max(cpm) FILTER (gen = 0), 0)) AS f FROM c GROUP BY ALL),
sc AS (SELECT gene, strain, avg(f) AS y, {SPLIT.format(g='gene')} AS Split FROM rf GROUP BY gene, strain HAVING avg(f) IS NOT NULL)"""


def scores(spark, sf):
    c = cpm(counts(spark, sf), list(SAMPLE))
    f = X.replicate_fitness(c, ["gene", "strain"], "rep", "gen", "cpm").groupBy("gene", "strain").agg(F.avg("fitness").alias("y")).where("y is not null")
    return f.withColumn("Split", F.expr(SPLIT.format(g="gene")))


def featured(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("gene"), (F.col("p_retailprice") / 100).alias("price"), F.col("p_size").cast("double").alias("size"))
    return scores(spark, sf).join(p, "gene")


@query("a29_grouping", f"WITH {SC} SELECT strain, gene, round(avg(y), 6) AS mean FROM sc GROUP BY GROUPING SETS ((strain), (gene), ())")
def a29(spark, sf):
    return scores(spark, sf).groupingSets([[F.col("strain")], [F.col("gene")], []], F.col("strain"), F.col("gene")).agg(r6(F.avg("y"), "mean"))


MEANS = f"""{SC}, ft AS (SELECT * FROM sc WHERE Split = 'train'), pr AS (SELECT sc.*, (SELECT avg(y) FROM ft) AS p_total, s.m AS p_strain, coalesce(g.m, (SELECT avg(y) FROM ft)) AS p_gene, g.m IS NULL AS unseen
FROM sc LEFT JOIN (SELECT strain, avg(y) AS m FROM ft GROUP BY strain) s ON sc.strain = s.strain LEFT JOIN (SELECT gene, avg(y) AS m FROM ft GROUP BY gene) g ON sc.gene = g.gene)"""


@query("m04_group_means", f"WITH {MEANS} SELECT gene, strain, round(p_total, 6) AS p_total, round(p_strain, 6) AS p_strain, round(p_gene, 6) AS p_gene FROM pr")
def m04(spark, sf):
    return M.mean_predictions(scores(spark, sf)).select("gene", "strain", r6("p_total"), r6("p_strain"), r6("p_gene"))


@query("m05_unseen", f"WITH {MEANS} SELECT Split, unseen, CAST(count(*) AS BIGINT) AS n, round(avg(p_gene), 6) AS mean_p FROM pr GROUP BY ALL")
def m05(spark, sf):
    return M.mean_predictions(scores(spark, sf)).groupBy("Split", "unseen").agg(F.count("*").alias("n"), r6(F.avg("p_gene"), "mean_p"))


@query("m06_recovery", f"WITH {MEANS} SELECT strain, round(max(abs(d)), 6) AS worst FROM (SELECT strain, avg(y) - avg(p_strain) AS d FROM pr WHERE Split = 'train' GROUP BY strain) GROUP BY strain")
def m06(spark, sf):
    rows = M.mean_predictions(scores(spark, sf)).where("Split = 'train'")
    return rows.groupBy("strain").agg(r6(F.abs(F.avg("y") - F.avg("p_strain")), "worst"))


@query("m07_metrics", f"""WITH {MEANS}, l AS (SELECT Split, y, unnest(['total', 'strain', 'gene']) AS model, unnest([p_total, p_strain, p_gene]) AS p FROM pr)
SELECT model, Split, round(1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)), 6) AS r2, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse FROM l GROUP BY ALL""")
def m07(spark, sf):
    rows = M.mean_predictions(scores(spark, sf)).unpivot(["gene", "strain", "Split", "y"], ["p_total", "p_strain", "p_gene"], "m", "p").withColumn("model", F.substring("m", 3, 20))
    return M.metrics(rows, ["model", "Split"], "y", "p").select("model", "Split", r6("r2"), r6("mae"), r6("rmse"))


@query("m04_additive")
def m04a(spark, sf):
    return M.additive_effects(scores(spark, sf).where("Split = 'train'"))


@query("m08_weights", f"WITH {SC} SELECT strain, round(avg(y) - (SELECT avg(y) FROM sc WHERE Split = 'train' AND strain = 'A'), 6) AS weight FROM sc WHERE Split = 'train' GROUP BY strain")
def m08(spark, sf):
    m = scores(spark, sf).where("Split = 'train'").groupBy("strain").agg(F.avg("y").alias("m"))
    ref = m.where("strain = 'A'").select(F.col("m").alias("ref"))
    return m.crossJoin(ref).select("strain", r6(F.col("m") - F.col("ref"), "weight"))


@query("m01_onehot", "WITH l AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS slot FROM (SELECT DISTINCT p_brand FROM part WHERE p_partkey % 20 < 14)) SELECT p_partkey, l.p_brand AS feature, CAST(slot AS INTEGER) AS slot FROM part JOIN l ON part.p_brand = l.p_brand WHERE slot > 0")
def m01(spark, sf):
    p = table(spark, sf, "part")
    return M.one_hot(p, "p_partkey", "p_brand", p.where("p_partkey % 20 < 14"))


@query("m02_levels", "SELECT 'p_brand' AS block, CAST(count(DISTINCT p_brand) - 1 AS BIGINT) AS width FROM part UNION ALL SELECT 'p_type', CAST(count(DISTINCT p_type) - 1 AS BIGINT) FROM part")
def m02(spark, sf):
    return table(spark, sf, "part").agg((F.countDistinct("p_brand") - 1).alias("p_brand"), (F.countDistinct("p_type") - 1).alias("p_type")).unpivot([], ["p_brand", "p_type"], "block", "width")


@query("m03_rank", "SELECT 1 + (SELECT count(DISTINCT p_brand) - 1 FROM part) + (SELECT count(DISTINCT p_type) - 1 FROM part) AS width, 1 + (SELECT count(DISTINCT p_brand) - 1 FROM part) + (SELECT count(DISTINCT p_type) - 1 FROM part) - (WITH RECURSIVE e AS (SELECT DISTINCT 'b' || p_brand AS x, 't' || p_type AS y FROM part), bw AS (SELECT x, y FROM e UNION SELECT y, x FROM e), rc AS (SELECT x AS id, x AS other FROM bw UNION SELECT rc.id, bw.y FROM rc JOIN bw ON rc.other = bw.x) SELECT count(DISTINCT c) - 1 FROM (SELECT id, min(other) AS c FROM rc GROUP BY id)) AS rank")
def m03(spark, sf):
    """A constant and two one-hot blocks: short of full rank by the parts, less one, that brands and types fall into."""
    p = table(spark, sf, "part")
    ones = p.select("p_partkey", F.lit("1").alias("feature"))
    f = ones.unionByName(M.one_hot(p, "p_partkey", "p_brand").drop("slot")).unionByName(M.one_hot(p, "p_partkey", "p_type").drop("slot"))
    width, rank, _ = P.design_rank(f, "p_partkey")
    return spark.createDataFrame([(width, rank)], "width long, rank long")


@query("m03_dependent")
def m03d(spark, sf):
    """Names of the columns that depend on those before them, over whole one-hot blocks and copies of some."""
    f = annotations(spark, sf).where("v = 1").select("gene", "feature")
    return P.design_rank(f, "gene")[2]


ONE = f"""{SC}, x AS (SELECT sc.*, p_retailprice / 100 AS x FROM sc JOIN part ON gene = p_partkey), g AS (SELECT strain, avg(x) AS mx, avg(y) AS my, sum(x * x) - count(*) * avg(x) * avg(x) AS sxx, sum(x * y) - count(*) * avg(x) * avg(y) AS sxy FROM x WHERE Split = 'train' GROUP BY strain),
w AS (SELECT strain, alpha, sxy / (sxx + alpha) AS b, my - sxy / (sxx + alpha) * mx AS a FROM g, (SELECT unnest([10.0::DOUBLE, 31.6, 100, 316, 1000, 3160, 10000, 31600, 100000]) AS alpha) t)"""


@query("m10_ridge_one", f"WITH {ONE} SELECT strain, alpha, round(b, 6) AS weight, round(a, 6) AS intercept FROM w")
def m10one(spark, sf):
    m = M.ridge(featured(spark, sf).where("Split = 'train'"), "strain", ["price"], "y")
    return m.select("strain", "alpha", r6(F.col("weights")[0], "weight"), r6("intercept"))


TWO = f"""{SC}, x AS (SELECT sc.*, p_retailprice / 100 AS x1, CAST(p_size AS DOUBLE) AS x2 FROM sc JOIN part ON gene = p_partkey),
g AS (SELECT strain, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, covar_pop(x1, x1) * count(*) AS s11, covar_pop(x2, x2) * count(*) AS s22, covar_pop(x1, x2) * count(*) AS s12, covar_pop(x1, y) * count(*) AS c1, covar_pop(x2, y) * count(*) AS c2 FROM x WHERE Split = 'train' GROUP BY strain),
w AS (SELECT strain, alpha, (c1 * (s22 + alpha) - c2 * s12) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) AS b1, (c2 * (s11 + alpha) - c1 * s12) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) AS b2, m1, m2, my FROM g, (SELECT unnest([10.0::DOUBLE, 31.6, 100, 316, 1000, 3160, 10000, 31600, 100000]) AS alpha) t)"""


@query("m10_ridge", f"WITH {TWO} SELECT strain, alpha, round(my - b1 * m1 - b2 * m2, 6) AS intercept, round(b1, 6) AS w_price, round(b2, 6) AS w_size FROM w")
def m10(spark, sf):
    m = M.ridge(featured(spark, sf).where("Split = 'train'"), "strain", ["price", "size"], "y")
    return m.select("strain", "alpha", r6("intercept"), r6(F.col("weights")[0], "w_price"), r6(F.col("weights")[1], "w_size"))


def brands(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("gene"), F.concat(F.lit("brand:"), "p_brand").alias("feature"), F.lit(1).alias("v"))


def all_annotations(spark, sf):
    """Every annotation feature of the parts: brand, type, size, container, and the kinds of ``annotations``."""
    p = table(spark, sf, "part")
    more = [p.select(F.col("p_partkey").alias("gene"), F.concat(F.lit(f"{c}:"), F.col(c).cast("string")).alias("feature"), F.lit(1).alias("v")) for c in p.columns if c not in ("p_partkey", "p_brand", "p_retailprice", "p_name")]
    out = annotations(spark, sf)
    for m in more:
        out = out.unionByName(m)
    return out


@query("m10_annotations")
def m10a(spark, sf):
    """Ridge weights of every annotation feature at every penalty, in each strain."""
    s = scores(spark, sf).where("Split = 'train'").select("strain", "gene", "y")
    return P.sparse_ridge(s, all_annotations(spark, sf), "strain", "gene", "y", "v", M.ALPHAS)


# one-hot columns of one family: each weight is its own shrunken sum about an intercept that is in closed form
BRAND = f"""{SC}, x AS (SELECT sc.*, 'brand:' || p_brand AS feature FROM sc JOIN part ON gene = p_partkey WHERE Split = 'train'), s AS (SELECT strain, feature, sum(y) AS sy, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY ALL),
al AS (SELECT unnest([10.0::DOUBLE, 31.6, 100, 316, 1000, 3160, 10000, 31600, 100000]) AS alpha), cut AS (SELECT strain, alpha, sum(sy / (n + alpha)) / sum(n / (n + alpha)) AS a FROM s, al GROUP BY ALL),
fs AS (SELECT DISTINCT 'brand:' || p_brand AS feature FROM part), bw AS (SELECT cut.strain, cut.alpha, fs.feature, coalesce((sy - n * a) / (n + cut.alpha), 0) AS weight FROM cut CROSS JOIN fs LEFT JOIN s ON s.strain = cut.strain AND s.feature = fs.feature)"""


@query("m10_brand_weights", f"WITH {BRAND} SELECT strain, alpha, feature, round(weight, 6) AS weight FROM bw UNION ALL SELECT strain, alpha, NULL, round(a, 6) FROM cut")
def m10b(spark, sf):
    s = scores(spark, sf).where("Split = 'train'").select("strain", "gene", "y")
    return P.sparse_ridge(s, brands(spark, sf), "strain", "gene", "y", "v", M.ALPHAS).select("strain", "alpha", "feature", r6("weight"))


@query("m16_brand_metrics", f"WITH {BRAND}, e AS (SELECT sc.strain, sc.Split, sc.y, cut.alpha, a + bw.weight AS p FROM sc JOIN part ON gene = p_partkey JOIN cut ON cut.strain = sc.strain JOIN bw ON bw.strain = sc.strain AND bw.alpha = cut.alpha AND bw.feature = 'brand:' || p_brand) SELECT strain, alpha, Split, CAST(count(*) AS BIGINT) AS n, round(1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)), 6) AS r2, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse FROM e GROUP BY ALL")
def m16b(spark, sf):
    """Rows of each strain with the weights of their keys, scored at every penalty."""
    rows, f = scores(spark, sf).select("strain", "gene", "y", "Split"), brands(spark, sf)
    m = P.sparse_ridge(rows.where("Split = 'train'"), f, "strain", "gene", "y", "v", M.ALPHAS)
    p = P.sparse_predictions(rows, m, f, "strain", "gene", "v")
    return M.metrics(p, ["strain", "alpha", "Split"], "y", "p").select("strain", "alpha", "Split", "n", r6("r2"), r6("rmse"))


def _ridge_scores(spark, sf, features=("price", "size")):
    rows = featured(spark, sf)
    return M.ridge_scores(rows, M.ridge(rows.where("Split = 'train'"), "strain", list(features), "y"), "strain", list(features), "y", "Split")


@query("m11_metrics", f"WITH {ONE} SELECT x.strain, alpha, Split, CAST(count(*) AS BIGINT) AS n, round(1 - sum((y - a - b * x) * (y - a - b * x)) / (count(*) * var_pop(y)), 6) AS r2, round(sqrt(avg((y - a - b * x) * (y - a - b * x))), 6) AS rmse FROM x JOIN w ON x.strain = w.strain GROUP BY ALL")
def m11(spark, sf):
    return _ridge_scores(spark, sf, ("price",)).select("strain", "alpha", "Split", "n", r6("r2"), r6("rmse"))


@query("m12_strain_baseline", f"WITH {SC} SELECT strain, round(avg(y), 6) AS baseline FROM sc WHERE Split = 'train' GROUP BY strain")
def m12(spark, sf):
    return scores(spark, sf).where("Split = 'train'").groupBy("strain").agg(r6(F.avg("y"), "baseline"))


@query("m13_shared_alpha", f"WITH {ONE} SELECT strain, arg_min(alpha, abs(alpha - 316)) AS alpha, round(arg_min(b, abs(alpha - 316)), 6) AS weight FROM w GROUP BY strain")
def m13(spark, sf):
    m = M.ridge(featured(spark, sf).where("Split = 'train'"), "strain", ["price"], "y")
    return m.groupBy("strain").agg(F.min_by("alpha", F.abs(F.col("alpha") - 316)).alias("alpha"), r6(F.min_by(F.col("weights")[0], F.abs(F.col("alpha") - 316)), "weight"))


@query("m14_best_alpha", f"WITH {TWO}, {MEANS.replace(SC + ', ', '', 1)}, e AS (SELECT x.strain, alpha, y, my + b1 * (x1 - m1) + b2 * (x2 - m2) AS p FROM x JOIN w ON x.strain = w.strain WHERE Split = 'val'), q AS (SELECT strain, alpha, CAST(count(*) AS BIGINT) AS n, 1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)) AS r2 FROM e GROUP BY ALL), bb AS (SELECT strain, 1 - sum((y - p_strain) * (y - p_strain)) / (count(*) * var_pop(y)) AS base_r2 FROM pr WHERE Split = 'val' GROUP BY strain), k AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY strain ORDER BY r2 DESC, alpha) = 1) SELECT k.strain, alpha, n, round(r2, 6) AS r2, round(base_r2, 6) AS base_r2, round(r2 - base_r2, 6) AS gain FROM k JOIN bb ON k.strain = bb.strain")
def m14(spark, sf):
    best = M.best_alpha(_ridge_scores(spark, sf), "strain", "Split")
    base = M.metrics(M.mean_predictions(scores(spark, sf)), ["strain", "Split"], "y", "p_strain").where("Split = 'val'").select("strain", F.col("r2").alias("base_r2"))
    return best.join(base, "strain").select("strain", "alpha", "n", r6("r2"), r6("base_r2"), r6(F.col("r2") - F.col("base_r2"), "gain"))


@query("a23_weight_spread", f"WITH {ONE} SELECT alpha, round(avg(b), 6) AS mean_w, round(stddev_samp(b), 6) AS sd_w FROM w GROUP BY alpha")
def a23(spark, sf):
    m = M.ridge(featured(spark, sf).where("Split = 'train'"), "strain", ["price"], "y")
    return m.groupBy("alpha").agg(r6(F.avg(F.col("weights")[0]), "mean_w"), r6(F.stddev_samp(F.col("weights")[0]), "sd_w"))


_TOP = "arg_max(p_partkey, (p_retailprice, -p_partkey))"


@query("a24_idxmax", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1")
def a24(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.max(F.struct("p_retailprice", (-F.col("p_partkey")).alias("k"))).alias("b")).select("p_brand", (-F.col("b.k")).alias("p_partkey"))


@query("a35_grid_summary", f"WITH {ONE}, rr AS (SELECT x.strain, alpha, Split, 1 - sum((y - a - b * x) * (y - a - b * x)) / (count(*) * var_pop(y)) AS r2 FROM x JOIN w ON x.strain = w.strain GROUP BY ALL) SELECT Split, alpha, round(avg(r2), 6) AS mean_r2, round(min(r2), 6) AS min_r2, round(max(r2), 6) AS max_r2 FROM rr GROUP BY ALL")
def a35(spark, sf):
    return _ridge_scores(spark, sf, ("price",)).groupBy("Split", "alpha").agg(r6(F.avg("r2"), "mean_r2"), r6(F.min("r2"), "min_r2"), r6(F.max("r2"), "max_r2"))


ANN = "an AS (SELECT p_partkey AS gene, 'brand:' || p_brand AS feature, 1 AS v FROM part UNION ALL SELECT p_partkey, 'half:' || p_brand, CASE WHEN p_size > 25 THEN 1 ELSE 0 END FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 'copy:' || p_brand, 1 FROM part)"


def annotations(spark, sf):
    p = table(spark, sf, "part")
    row = lambda d, tag, v: d.select(F.col("p_partkey").alias("gene"), F.concat(F.lit(tag), "p_brand").alias("feature"), v.alias("v"))
    return row(p, "brand:", F.lit(1)).unionByName(row(p.where("p_partkey % 3 <> 0"), "half:", F.when(F.col("p_size") > 25, 1).otherwise(0))).unionByName(row(p, "copy:", F.lit(1)))


@query("m09_features", f"WITH {ANN}, w AS (SELECT DISTINCT l_partkey AS gene FROM lineitem WHERE l_quantity > 40) SELECT w.gene, feature, v FROM w JOIN an ON w.gene = an.gene WHERE v = 1")
def m09(spark, sf):
    want = table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("gene")).distinct()
    return want.join(annotations(spark, sf).where("v = 1"), "gene")


@query("a25_dup_groups", f"WITH {ANN}, s AS (SELECT feature, string_agg(CAST(gene AS VARCHAR), ',' ORDER BY gene) AS sig FROM an WHERE v = 1 GROUP BY feature), g AS (SELECT feature, count(*) OVER (PARTITION BY sig) AS k, min(feature) OVER (PARTITION BY sig) AS first_of FROM s) SELECT feature, first_of, CAST(k AS BIGINT) AS k FROM g WHERE k > 1")
def a25(spark, sf):
    """Features with equal columns, by a sum of hashes of their positive genes."""
    s = annotations(spark, sf).where("v = 1").groupBy("feature").agg(F.count("*").alias("n"), F.sum(F.xxhash64("gene").cast("decimal(38,0)")).alias("h1"), F.sum(F.xxhash64("gene", F.lit(7)).cast("decimal(38,0)")).alias("h2"))
    w = Window.partitionBy("n", "h1", "h2")
    return s.select("feature", F.min("feature").over(w).alias("first_of"), F.count("*").over(w).alias("k")).where("k > 1")


@query("a26_report", f"WITH {ANN} SELECT feature, CAST(count(*) AS BIGINT) AS scored, CAST(sum(v) AS BIGINT) AS positives, round(avg(v), 6) AS prevalence FROM an GROUP BY feature")
def a26(spark, sf):
    return annotations(spark, sf).groupBy("feature").agg(F.count("v").alias("scored"), F.sum("v").alias("positives"), r6(F.avg("v"), "prevalence"))


@query("a27_coverage", f"WITH {ANN} SELECT gene, round(count(*) / 3.0::DOUBLE, 6) AS coverage FROM an GROUP BY gene")
def a27(spark, sf):
    return annotations(spark, sf).groupBy("gene").agg(r6(F.count("v") / F.lit(3.0), "coverage"))


@query("g13_smart_split", f"WITH m AS (SELECT DISTINCT l_partkey AS uid, l_suppkey AS entry FROM lineitem UNION SELECT p_partkey, -1 FROM part WHERE p_partkey <= 3), x AS (SELECT uid, entry, {SPLIT.format(g='entry')} AS Split FROM m) SELECT uid, Split FROM x QUALIFY row_number() OVER (PARTITION BY uid ORDER BY entry) = 1")
def g13(spark, sf):
    m = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("uid"), F.col("l_suppkey").alias("entry")).unionByName(table(spark, sf, "part").where("p_partkey <= 3").select(F.col("p_partkey").alias("uid"), F.lit(-1).cast("long").alias("entry"))).distinct()
    return m.groupBy("uid").agg(F.min("entry").alias("entry")).select("uid", F.expr(SPLIT.format(g="entry")).alias("Split"))


@query("g14_mapping_audit", "WITH m AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem) SELECT 'shared' AS kind, b AS id, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY b HAVING count(*) > 1 UNION ALL SELECT 'multi', a, CAST(count(*) AS BIGINT) FROM m GROUP BY a HAVING count(*) > 1")
def g14(spark, sf):
    m = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    side = lambda k, c: m.groupBy(F.col(c).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(k).alias("kind"), "id", "n")
    return side("shared", "b").unionByName(side("multi", "a"))


@query("t25_irls")
def t25(spark, sf):
    return M.count_models(counts(spark, sf, "l_suppkey").where("gen = 0").select("gene", "strain", "rep", "n"), "gene", ["rep", "strain"], "n").select("gene", "term", "log2fc")


@query("t27_rnaseq")
def t27(spark, sf):
    return M.count_models(counts(spark, sf, "l_suppkey").where("gen = 0").select("gene", "strain", "rep", "n"), "gene", ["rep", "strain"], "n")


@query("t30_crossref", f"WITH {B1D}, m AS (SELECT gene, strain, avg(cpm) FILTER (gen = 0) AS a, avg(cpm) FILTER (gen = 10) AS b FROM c GROUP BY ALL) SELECT strain, b > a AS up, CAST(count(*) AS BIGINT) AS genes, CAST(count(*) FILTER (gene % 2 = 0) AS BIGINT) AS overlap FROM m GROUP BY ALL HAVING count(*) >= 5")
def t30(spark, sf):
    m = X.arm_means(cpm(counts(spark, sf, "l_suppkey"), list(SAMPLE)), ["gene", "strain"], "gen", "cpm")
    return m.groupBy("strain", (F.col("mean10") > F.col("mean0")).alias("up")).agg(F.count("*").alias("genes"), F.count_if(F.col("gene") % 2 == 0).alias("overlap")).where("genes >= 5")


def _profiles(spark, sf):
    """Fold changes of every gene in every strain, in order of strains; null where a strain has none."""
    fc = many_strains(spark, sf)
    strains = fc.agg(F.array_sort(F.collect_set("strain")).alias("strains"))
    held = fc.where("fc is not null").groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct("strain", "fc"))).alias("m"))
    every = fc.select("gene").distinct().join(held, "gene", "left")
    return every.crossJoin(strains).select("gene", F.transform("strains", lambda s: F.col("m")[s]).alias("v"))


@query("t34_cluster")
def t34(spark, sf):
    return L.average_linkage(_profiles(spark, sf), "gene", "v", "correlation")


@query("t35_cluster")
def t35(spark, sf):
    return L.average_linkage(_profiles(spark, sf), "gene", "v", "cosine")


@query("w07_leaf_order")
def w07(spark, sf):
    return L.leaf_order(L.average_linkage(_profiles(spark, sf), "gene", "v", "correlation"))


@query("t37_clone_corr", f"""WITH {B2}, v AS (SELECT gene % 100 AS base, gene AS id, strain, fc FROM b2 WHERE fc IS NOT NULL), p AS (SELECT a.base, a.id AS id_1, b.id AS id_2, a.fc AS x, b.fc AS y FROM v a JOIN v b ON a.base = b.base AND a.strain = b.strain AND a.id < b.id),
r AS (SELECT *, rank() OVER (PARTITION BY id_1, id_2 ORDER BY x) + (count(*) OVER (PARTITION BY id_1, id_2, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY id_1, id_2 ORDER BY y) + (count(*) OVER (PARTITION BY id_1, id_2, y) - 1) / 2.0::DOUBLE AS ry FROM p)
SELECT base, id_1, id_2, CAST(count(*) AS BIGINT) AS n, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) AS pearson, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) AS spearman FROM r GROUP BY ALL""")
def t37(spark, sf):
    v = many_strains(spark, sf).select((F.col("gene") % 100).alias("base"), F.col("gene").alias("id"), "strain", F.col("fc").alias("value"))
    return M.clone_correlations(v).select("base", "id_1", "id_2", "n", r6("pearson"), r6("spearman"))


@query("m15_design", "WITH r AS (SELECT p_partkey, p_brand AS gene, p_type AS strain FROM part), f AS (SELECT * FROM r WHERE p_partkey % 20 < 14), g AS (SELECT gene AS feature, row_number() OVER (ORDER BY gene) - 1 AS slot FROM (SELECT DISTINCT gene FROM f)), s AS (SELECT strain AS feature, row_number() OVER (ORDER BY strain) - 1 AS slot FROM (SELECT DISTINCT strain FROM f)) SELECT p_partkey, 'gene' AS block, feature, CAST(slot AS INTEGER) AS slot FROM r JOIN g ON gene = feature WHERE slot > 0 UNION ALL SELECT p_partkey, 'strain', feature, CAST(slot + (SELECT count(*) - 1 FROM g) AS INTEGER) FROM r JOIN s ON strain = feature WHERE slot > 0")
def m15(spark, sf):
    r = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("gene"), F.col("p_type").alias("strain"))
    return M.design(r, "p_partkey", "both", r.where("p_partkey % 20 < 14"))


@query("k16_split_map", f"WITH {SC} SELECT DISTINCT gene, Split AS split FROM sc")
def k16(spark, sf):
    return scores(spark, sf).select("gene", F.col("Split").alias("split")).distinct()
