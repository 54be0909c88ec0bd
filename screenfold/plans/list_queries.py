"""Queries over effects: lists, backgrounds, comparisons of lists and enrichment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from screenfold.operators import enrichment as E
from screenfold.operators import lists as L
from screenfold.operators.scan import exact_quantiles
from screenfold.plans.bindings import B1, B2, counts, many_strains, table
from screenfold.plans.registry import query


def effects(spark, sf):
    return L.effects(many_strains(spark, sf), "fc", 0.5)


r6 = lambda c, n=None: F.round(c, 6).alias(n or c)


@query("f03_effects", f"WITH {B2} SELECT gene, strain, del AS deleterious, ben AS beneficial, del OR ben AS any_effect FROM e")
def f03(spark, sf):
    return effects(spark, sf).select("gene", "strain", "deleterious", "beneficial", "any_effect")


@query("a04_strain_counts", f"WITH {B2} SELECT gene, CAST(count(*) FILTER (del) AS BIGINT) AS n_del, CAST(count(*) FILTER (ben) AS BIGINT) AS n_ben FROM e GROUP BY gene")
def a04(spark, sf):
    return L.strain_counts(effects(spark, sf))


@query("a05_common", f"WITH {B2} SELECT gene, CAST(count(*) FILTER (del) AS BIGINT) AS n_strains FROM e GROUP BY gene HAVING count(*) FILTER (del) >= 10")
def a05(spark, sf):
    return L.common(effects(spark, sf), "deleterious", 10)


@query("a06_hist", f"WITH {B2}, k AS (SELECT gene, CAST(count(*) FILTER (del) AS BIGINT) AS n_strains FROM e GROUP BY gene) SELECT n_strains, CAST(count(*) AS BIGINT) AS n_genes FROM k WHERE n_strains > 0 GROUP BY n_strains")
def a06(spark, sf):
    return L.common(effects(spark, sf), "deleterious", 1).groupBy("n_strains").agg(F.count("*").alias("n_genes"))


@query("a07_per_strain", f"WITH {B2} SELECT strain, CAST(count(*) FILTER (del OR ben) AS BIGINT) AS significant, CAST(count(*) FILTER (del) AS BIGINT) AS n_del, CAST(count(*) FILTER (ben) AS BIGINT) AS n_ben FROM e GROUP BY strain")
def a07(spark, sf):
    return effects(spark, sf).groupBy("strain").agg(F.count_if(F.col("any_effect")).alias("significant"), F.count_if(F.col("deleterious")).alias("n_del"), F.count_if(F.col("beneficial")).alias("n_ben"))


@query("a08_any_median", f"""WITH {B2}, s AS (SELECT strain, count(*) FILTER (del OR ben) AS k FROM e GROUP BY strain), g AS (SELECT gene FROM e GROUP BY gene HAVING bool_or(del OR ben))
SELECT (SELECT CAST(count(*) AS BIGINT) FROM g) AS any_genes, (SELECT CAST(floor(median(k)) AS BIGINT) FROM s) AS median_per_strain""")
def a08(spark, sf):
    e = effects(spark, sf)
    genes = e.groupBy("gene").agg(F.bool_or("any_effect").alias("x")).agg(F.count_if(F.col("x")).alias("any_genes"))
    per = e.groupBy("strain").agg(F.count_if(F.col("any_effect")).alias("k")).agg(F.floor(F.median("k")).cast("long").alias("median_per_strain"))
    return genes.crossJoin(per)


@query("a38_cond_sum", f"WITH {B2}, k AS (SELECT gene, count(*) FILTER (del) AS k FROM e GROUP BY gene), h AS (SELECT k, count(*) AS n FROM k GROUP BY k) SELECT CAST(sum(CASE WHEN k >= 8 THEN n ELSE 0 END) AS BIGINT) AS n_genes FROM h")
def a38(spark, sf):
    return L.common(effects(spark, sf), "deleterious", 0).groupBy("n_strains").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n_strains") >= 8, F.col("n")).otherwise(0)), F.lit(0)).alias("n_genes"))


for _rule in ("same", "any"):
    _other = "del" if _rule == "same" else "(del OR ben)"

    @query(f"o04_specific_{_rule}", f"WITH {B2}, o AS (SELECT *, count(*) FILTER ({_other}) OVER (PARTITION BY gene) - CAST({_other} AS INTEGER) AS others FROM e) SELECT gene, strain, CAST(others AS BIGINT) AS others FROM o WHERE del AND others <= {4 if _rule == 'same' else 10}")
    def o04(spark, sf, rule=_rule):
        return L.specific(effects(spark, sf), "deleterious", 4 if rule == "same" else 10, rule).select("gene", "strain", "others")


@query("o05_specific_max3", f"WITH {B2}, o AS (SELECT *, count(*) FILTER (ben) OVER (PARTITION BY gene) AS k FROM e) SELECT gene, strain FROM o WHERE ben AND k <= 3")
def o05(spark, sf):
    return L.specific(effects(spark, sf), "beneficial", 2, "same").select("gene", "strain")


@query("t31_beneficial", f"WITH {B2} SELECT gene, CAST(count(*) FILTER (ben) AS BIGINT) AS n_strains FROM e GROUP BY gene HAVING count(*) FILTER (ben) >= 10 AND NOT bool_or(ben AND strain = 0)")
def t31(spark, sf):
    return L.beneficial_cluster(effects(spark, sf), 10, F.col("strain") == 0)


@query("k07_ragged", f"WITH {B2}, k AS (SELECT gene, strain, row_number() OVER (PARTITION BY strain ORDER BY gene) AS rn FROM e WHERE del) SELECT CAST(rn AS INTEGER) AS rn, max(gene) FILTER (strain = 0) AS s0, max(gene) FILTER (strain = 1) AS s1, max(gene) FILTER (strain = 2) AS s2 FROM k GROUP BY rn")
def k07(spark, sf):
    return L.ragged(effects(spark, sf).where("deleterious"), "gene", "strain", list(range(25))).select("rn", F.col("0").alias("s0"), F.col("1").alias("s1"), F.col("2").alias("s2"))


MEASURED = f"""{B1}, ms AS (SELECT gene FROM (SELECT gene, strain, bool_and(cpm > 40) AS ok FROM c WHERE gen = 0 GROUP BY gene, strain) GROUP BY gene HAVING bool_or(ok))"""


def measured(spark, sf):
    from screenfold.operators.counts import cpm

    return L.measured_at_start(cpm(counts(spark, sf), ["strain", "gen", "rep"]), "gene", "strain", "gen", "cpm", 40.0)


@query("t14_measured", f"WITH {MEASURED} SELECT gene FROM ms")
def t14(spark, sf):
    return measured(spark, sf)


@query("t15_backgrounds", f"""WITH {B2}, cm AS (SELECT gene FROM e GROUP BY gene HAVING count(*) FILTER (del) >= 10), a AS (SELECT DISTINCT gene FROM e WHERE del OR ben)
SELECT 'any_minus_common' AS background, -1 AS strain, gene FROM a WHERE gene NOT IN (SELECT gene FROM cm)
UNION ALL SELECT 'no_effect', strain, gene FROM e WHERE fc IS NOT NULL AND NOT del AND NOT ben""")
def t15(spark, sf):
    e = effects(spark, sf)
    return L.backgrounds(e, L.common(e, "deleterious", 10))


ALPHA2 = f"{B2}, x AS (SELECT gene, CAST(count(*) FILTER (fc <= -0.5) AS BIGINT) AS k FROM b2 GROUP BY gene HAVING count(*) FILTER (fc <= -0.5) >= 7), y AS (SELECT gene, CAST(count(*) FILTER (fc <= -0.6) AS BIGINT) AS k FROM b2 GROUP BY gene HAVING count(*) FILTER (fc <= -0.6) >= 6)"
PROV = f"{ALPHA2}, p AS (SELECT coalesce(x.gene, y.gene) AS gene, x.k AS ours, y.k AS theirs, CASE WHEN y.gene IS NULL THEN 'ours' WHEN x.gene IS NULL THEN 'theirs' ELSE 'both' END AS source FROM x FULL JOIN y ON x.gene = y.gene)"


def two_lists(spark, sf):
    fc = many_strains(spark, sf)
    return tuple(L.common(L.effects(fc, "fc", t), "deleterious", k) for t, k in ((0.5, 7), (0.6, 6)))


def provenance(spark, sf):
    return L.outer_provenance(*two_lists(spark, sf), "gene", "n_strains")


@query("j02_outer_prov", f"WITH {PROV} SELECT gene, ours, theirs, source FROM p")
def j02(spark, sf):
    return provenance(spark, sf)


@query("x24_null_diff", f"WITH {PROV} SELECT gene, coalesce(ours, 0) <> coalesce(theirs, 0) AS differs FROM p")
def x24(spark, sf):
    return provenance(spark, sf).select("gene", (F.coalesce("ours", F.lit(0)) != F.coalesce("theirs", F.lit(0))).alias("differs"))


@query("a17_crosstab", f"WITH {PROV} SELECT source, CAST(count(*) FILTER (coalesce(ours, 0) = coalesce(theirs, 0)) AS BIGINT) AS equal_k, CAST(count(*) FILTER (coalesce(ours, 0) <> coalesce(theirs, 0)) AS BIGINT) AS other_k FROM p GROUP BY source")
def a17(spark, sf):
    d = F.coalesce("ours", F.lit(0)) != F.coalesce("theirs", F.lit(0))
    return provenance(spark, sf).groupBy("source").agg(F.count_if(~d).alias("equal_k"), F.count_if(d).alias("other_k"))


@query("a16_jaccard", f"WITH {PROV} SELECT CAST(count(*) FILTER (source <> 'theirs') AS BIGINT) AS n_ours, CAST(count(*) FILTER (source <> 'ours') AS BIGINT) AS n_theirs, CAST(count(*) FILTER (source = 'both') AS BIGINT) AS shared, round(count(*) FILTER (source = 'both') / count(*)::DOUBLE, 6) AS jaccard FROM p")
def a16(spark, sf):
    return L.jaccard(provenance(spark, sf))


@query("t33_common_severity", f"WITH {B2}, cm AS (SELECT gene FROM e GROUP BY gene HAVING count(*) FILTER (del) >= 10) SELECT strain, round(quantile_cont(fc, 0.25), 6) AS q1, round(median(fc), 6) AS med, round(quantile_cont(fc, 0.75), 6) AS q3 FROM b2 WHERE gene IN (SELECT gene FROM cm) GROUP BY strain")
def t33(spark, sf):
    e = effects(spark, sf)
    got = e.join(L.common(e, "deleterious", 10), "gene", "left_semi")
    got = got.select("strain").distinct().join(exact_quantiles(got, ["strain"], "fc", [0.25, 0.5, 0.75]), "strain", "left")
    return got.select("strain", r6(F.col("q")[0], "q1"), r6(F.col("q")[1], "med"), r6(F.col("q")[2], "q3"))


# enrichment: genes are parts, categories their brands, the query list the parts with a large drop

LIST = f"""{B1}, lf AS (SELECT gene, avg(cpm) FILTER (gen = 10) - avg(cpm) FILTER (gen = 0) AS d FROM c GROUP BY gene), uni AS (SELECT gene FROM lf), ql AS (SELECT gene FROM lf WHERE d < -120), q2 AS (SELECT gene FROM lf WHERE d < -60 AND gene % 3 <> 0)"""


def drops(spark, sf):
    from screenfold.operators.counts import cpm

    c = cpm(counts(spark, sf), ["strain", "gen", "rep"])
    return c.groupBy("gene").agg((F.avg(F.when(F.col("gen") == 10, F.col("cpm"))) - F.avg(F.when(F.col("gen") == 0, F.col("cpm")))).alias("d"))


def categories(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("category"))


_LC = "lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1)"
TAIL = f"list_sum(list_transform(generate_series(observed, least(category_size, query_size)), lambda i: exp({_LC.format('category_size', 'i')} + {_LC.format('(background_size - category_size)', '(query_size - i)')} - ({_LC.format('background_size', 'query_size')}))))"
HYPER = f"""{LIST}, cat AS (SELECT u.gene, p_brand AS category FROM uni u JOIN part ON gene = p_partkey),
h AS (SELECT category, (SELECT count(*) FROM uni)::BIGINT AS background_size, (SELECT count(*) FROM ql)::BIGINT AS query_size, count(*)::BIGINT AS category_size, (count(*) FILTER (gene IN (SELECT gene FROM ql)))::BIGINT AS observed FROM cat GROUP BY category),
hp AS (SELECT *, query_size * category_size / background_size::DOUBLE AS expected, least(1, {TAIL}) AS pvalue FROM h WHERE category_size >= 3 AND observed > 0),
hf AS (SELECT *, pvalue * count(*) OVER () / row_number() OVER (ORDER BY pvalue) AS v FROM hp)"""


@query("t16_hyper", f"WITH {HYPER} SELECT category, background_size, query_size, category_size, observed, round(expected, 6) AS expected, round(observed / expected, 6) AS fold, round(pvalue, 6) AS pvalue, round(least(1, min(v) OVER (ORDER BY pvalue RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS fdr FROM hf")
def t16(spark, sf):
    d = drops(spark, sf)
    got = E.over_representation(d.where("d < -120").select("gene"), d.select("gene"), categories(spark, sf))
    return got.select("category", "background_size", "query_size", "category_size", "observed", r6("expected"), r6("fold"), r6("pvalue"), r6("fdr"))


def _hyper_sql(lists: str, base: str, cats: str, least_query: int) -> str:
    """CTEs ``hf``: over-representation of (list_id, gene) ``lists`` in ``cats`` before the step-up minimum."""
    return f"""ca AS (SELECT DISTINCT c.gene, c.category FROM {cats} c JOIN {base} u ON c.gene = u.gene),
ls AS (SELECT DISTINCT list_id, l.gene FROM {lists} l JOIN {base} u ON l.gene = u.gene), qs AS (SELECT list_id, count(*) AS query_size FROM ls GROUP BY list_id HAVING count(*) >= {least_query}),
cs AS (SELECT category, count(*) AS category_size FROM ca GROUP BY category HAVING count(*) >= 3), hits AS (SELECT list_id, category, count(*) AS observed FROM ls JOIN ca ON ls.gene = ca.gene GROUP BY ALL),
h AS (SELECT list_id, category, observed::BIGINT AS observed, query_size::BIGINT AS query_size, category_size::BIGINT AS category_size, (SELECT count(*) FROM {base})::BIGINT AS background_size FROM hits JOIN qs USING (list_id) JOIN cs USING (category)),
hp AS (SELECT *, query_size * category_size / background_size::DOUBLE AS expected, least(1, {TAIL}) AS pvalue FROM h),
hv AS (SELECT *, pvalue * count(*) OVER (PARTITION BY list_id) / row_number() OVER (PARTITION BY list_id ORDER BY pvalue) AS v FROM hp),
hf AS (SELECT *, least(1, min(v) OVER (PARTITION BY list_id ORDER BY pvalue RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fdr FROM hv)"""


HYPER_COLUMNS = "category, background_size, query_size, category_size, observed, round(expected, 6) AS expected, round(observed / expected, 6) AS fold, round(pvalue, 6) AS pvalue, round(fdr, 6) AS fdr"


def _hyper_columns(got):
    return got.select("category", "background_size", "query_size", "category_size", "observed", r6("expected"), r6("fold"), r6("pvalue"), r6("fdr"))


MINUS = f"""{LIST}, bd AS (SELECT lf.gene, d FROM lf WHERE gene NOT IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#11')), ct AS (SELECT p_partkey AS gene, p_brand AS category FROM part), li AS (SELECT 'q' AS list_id, gene FROM bd WHERE d < -120), {_hyper_sql('li', 'bd', 'ct', 1)}"""


@query("t20_enrich_minus", f"WITH {MINUS} SELECT {HYPER_COLUMNS} FROM hf")
def t20(spark, sf):
    """Over-representation without the genes of one category."""
    d = drops(spark, sf)
    cats = categories(spark, sf)
    gone = cats.where("category = 'Brand#11'").select("gene")
    left = d.join(gone, "gene", "left_anti")
    return _hyper_columns(E.over_representation(left.where("d < -120").select("gene"), left.select("gene"), cats))


@query("t17_overlap", f"""WITH {LIST}, h AS (SELECT (SELECT count(*) FROM uni)::BIGINT AS background_size, (SELECT count(*) FROM ql)::BIGINT AS query_size, (SELECT count(*) FROM q2)::BIGINT AS category_size, (SELECT count(*) FROM ql WHERE gene IN (SELECT gene FROM q2))::BIGINT AS observed)
SELECT background_size AS universe, query_size AS list_a, category_size AS list_b, observed AS overlap, round(query_size * category_size / background_size::DOUBLE, 6) AS expected, round(CASE WHEN observed = 0 THEN 1 ELSE least(1, {TAIL}) END, 6) AS pvalue FROM h""")
def t17(spark, sf):
    d = drops(spark, sf)
    got = E.list_overlap(d.where("d < -120").select("gene"), d.where("d < -60 and gene % 3 <> 0").select("gene"), d.select("gene"))
    return got.select("universe", "list_a", "list_b", "overlap", r6("expected"), r6("pvalue"))


WIL = f"""{LIST}, ft AS (SELECT p_partkey AS gene, 'price' AS feature, p_retailprice AS v FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS DOUBLE) FROM part),
fr AS (SELECT f.feature, f.v, f.gene IN (SELECT gene FROM ql) AS q, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY feature, v) AS t FROM ft f JOIN uni u ON f.gene = u.gene),
w AS (SELECT feature, count(*) FILTER (q) AS n1, count(*) FILTER (NOT q) AS n2, CAST(sum(r) FILTER (q) AS DOUBLE) - count(*) FILTER (q) * (count(*) FILTER (q) + 1) / 2 AS u, median(v) FILTER (q) AS mq, median(v) FILTER (NOT q) AS mb, sum(CAST(t * t - 1 AS DOUBLE)) AS ties FROM fr GROUP BY feature)"""


def features(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("gene"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    return p.unpivot(["gene"], ["price", "size"], "feature", "value")


@query("t18_wilcoxon_u", f"WITH {WIL} SELECT feature, n1::BIGINT AS n_query, n2::BIGINT AS n_background, round(mq, 6) AS median_query, round(mb, 6) AS median_background, round(u, 6) AS statistic, round((abs(u - n1 * n2 / 2.0::DOUBLE) - 0.5) / sqrt(n1 * n2 / 12.0::DOUBLE * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)::DOUBLE))), 6) AS z FROM w WHERE n1 >= 3 AND n2 >= 3")
def t18(spark, sf):
    d = drops(spark, sf)
    got = E.rank_sum(d.where("d < -120").select("gene"), d.select("gene"), features(spark, sf))
    return got.select("feature", "n_query", "n_background", r6("median_query"), r6("median_background"), r6("statistic"), r6("z"))


@query("t18_wilcoxon_p")
def t18p(spark, sf):
    d = drops(spark, sf)
    return E.rank_sum(d.where("d < -120").select("gene"), d.select("gene"), features(spark, sf)).select("feature", "statistic", "direction", "pvalue", "fdr")


SPECIFIC = f"""{B2}, k AS (SELECT gene, count(*) FILTER (del) AS nd FROM e GROUP BY gene), ba AS (SELECT DISTINCT gene FROM e), ct AS (SELECT p_partkey % 200 AS gene, p_type AS category FROM part),
li AS (SELECT CAST(strain AS VARCHAR) AS list_id, gene FROM e JOIN k USING (gene) WHERE del AND nd <= 7), {_hyper_sql('li', 'ba', 'ct', 3)}"""


@query("t21_specific_enrichment", f"WITH {SPECIFIC} SELECT list_id, {HYPER_COLUMNS}, CAST(row_number() OVER (PARTITION BY list_id ORDER BY round(pvalue, 9), category) AS INTEGER) AS place FROM hf QUALIFY place <= 5")
def t21(spark, sf):
    """Categories over-represented in each strain's specific genes; the five best of a strain."""
    e = effects(spark, sf)
    lists = L.specific(e, "deleterious", 6, "same").select(F.col("strain").cast("string").alias("list_id"), "gene")
    cats = table(spark, sf, "part").select((F.col("p_partkey") % 200).alias("gene"), F.col("p_type").alias("category"))
    got = E.over_representation_of_lists(lists, e.select("gene").distinct(), cats, least_query=3)
    got = got.withColumn("place", F.row_number().over(Window.partitionBy("list_id").orderBy(F.round("pvalue", 9), "category"))).where("place <= 5")
    return got.select("list_id", "category", "background_size", "query_size", "category_size", "observed", r6("expected"), r6("fold"), r6("pvalue"), r6("fdr"), "place")


BOTH = f"""{HYPER}, {WIL.removeprefix(LIST + ', ')}"""


@query("t19_both_tests", f"WITH {BOTH} SELECT 'hypergeometric' AS test, category AS term, CAST(observed AS DOUBLE) AS statistic, query_size AS n_query, background_size - query_size AS n_rest FROM hf UNION ALL SELECT 'wilcoxon', feature, round(u, 6), n1::BIGINT, n2::BIGINT FROM w WHERE n1 >= 3 AND n2 >= 3")
def t19(spark, sf):
    d = drops(spark, sf)
    got = E.both_tests(d.where("d < -120").select("gene"), d.select("gene"), categories(spark, sf), features(spark, sf))
    return got.select("test", "term", r6("statistic"), "n_query", "n_rest")


@query("t22_published_overlap", f"""WITH {B1}, m AS (SELECT gene, avg(cpm) FILTER (gen = 0) AS a, avg(cpm) FILTER (gen = 10) AS b FROM c WHERE strain = 'R' GROUP BY gene), uni AS (SELECT gene FROM m WHERE a > 0 AND b > 0), oq AS (SELECT gene FROM m WHERE a > 0 AND b > 0 AND log2(b / a) < -1), pl AS (SELECT p_partkey AS gene FROM part WHERE p_size <= 10),
h AS (SELECT (SELECT count(*) FROM uni)::BIGINT AS background_size, (SELECT count(*) FROM oq)::BIGINT AS query_size, (SELECT count(*) FROM uni WHERE gene IN (SELECT gene FROM pl))::BIGINT AS category_size, (SELECT count(*) FROM oq WHERE gene IN (SELECT gene FROM pl))::BIGINT AS observed)
SELECT background_size AS universe, query_size AS list_a, category_size AS list_b, observed AS overlap, round(query_size * category_size / background_size::DOUBLE, 6) AS expected, round(CASE WHEN observed = 0 THEN 1 ELSE least(1, {TAIL}) END, 6) AS pvalue FROM h""")
def t22(spark, sf):
    """The laboratory strain's deleterious genes against a published list."""
    from screenfold.operators.counts import cpm
    from screenfold.operators.fitness import arm_means, log2_ratio

    m = arm_means(cpm(counts(spark, sf), ["strain", "gen", "rep"]).where("strain = 'R'"), ["gene"], "gen", "cpm").withColumn("fc", log2_ratio("mean10", "mean0")).where("fc is not null")
    published = table(spark, sf, "part").where("p_size <= 10").select(F.col("p_partkey").alias("gene"))
    got = E.list_overlap(m.where("fc < -1").select("gene"), published, m.select("gene"))
    return got.select("universe", "list_a", "list_b", "overlap", r6("expected"), r6("pvalue"))


@query("t23_balance")
def t23(spark, sf):
    """Features and one category of a list, with all genes and without those of another category."""
    d = drops(spark, sf)
    cats = categories(spark, sf)
    member = cats.where("category in ('Brand#12', 'Brand#13')").select("gene", F.lit("in_any_complex").alias("category"))
    return E.balance_tests(d.where("d < -120").select("gene"), d.select("gene"), features(spark, sf), member, cats.where("category = 'Brand#11'").select("gene"))


@query("a28_truth_eval", f"""WITH {B2}, t AS (SELECT *, fc <= -0.6 AS truth FROM e WHERE fc IS NOT NULL) SELECT strain, round(count(*) FILTER (del AND truth) / nullif(count(*) FILTER (truth), 0)::DOUBLE, 6) AS recall, round(count(*) FILTER (del AND truth) / nullif(count(*) FILTER (del), 0)::DOUBLE, 6) AS prec FROM t GROUP BY strain""")
def a28(spark, sf):
    t = effects(spark, sf).where("fc is not null").withColumn("truth", F.col("fc") <= -0.6)
    hit = F.count_if(F.col("deleterious") & F.col("truth"))
    return t.groupBy("strain").agg(r6(F.try_divide(hit.cast("double"), F.count_if(F.col("truth"))), "recall"), r6(F.try_divide(hit.cast("double"), F.count_if(F.col("deleterious"))), "prec"))


@query("t39_validate", f"""WITH {ALPHA2}, s AS (SELECT b.strain, count(*) FILTER (fc <= -0.5) AS a, count(*) FILTER (fc <= -0.6) AS c FROM b2 b GROUP BY strain) SELECT strain, a::BIGINT AS n_ours, c::BIGINT AS n_theirs, round(c / a::DOUBLE, 6) AS jaccard FROM s""")
def t39(spark, sf):
    fc = many_strains(spark, sf)
    a, b = F.coalesce(F.col("fc") <= -0.5, F.lit(False)), F.coalesce(F.col("fc") <= -0.6, F.lit(False))
    return fc.groupBy("strain").agg(F.count_if(a).alias("n_ours"), F.count_if(b).alias("n_theirs"), r6(F.try_divide(F.count_if(a & b).cast("double"), F.count_if(a | b)), "jaccard"))
