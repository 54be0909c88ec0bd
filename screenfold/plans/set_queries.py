"""Queries of joins, sets, sorts and reshapes over the shared tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from screenfold.operators.scan import numbered
from screenfold.plans.bindings import B2, many_strains, table
from screenfold.plans.registry import query

r6 = lambda c, n=None: F.round(c, 6).alias(n or c)


def rounded(x):
    """``round(x, 6)`` of no negative number, by decimals only where the sixth digit is near a tie or the number is large."""
    y = x * 1e6
    return F.when((y < 1e12) & (F.abs(y - F.rint(y)) < 0.499), F.rint(y) / 1e6).otherwise(F.round(x, 6))


def part(spark, sf):
    return table(spark, sf, "part")


def line(spark, sf):
    return table(spark, sf, "lineitem")


@query("j01_left_scores", f"WITH {B2}, l AS (SELECT p_partkey % 200 AS gene, p_brand AS brand FROM part WHERE p_size > 25), s AS (SELECT gene, round(avg(fc), 6) AS score FROM b2 WHERE gene % 3 <> 0 GROUP BY gene) SELECT l.gene, l.brand, s.score FROM l LEFT JOIN s ON l.gene = s.gene")
def j01(spark, sf):
    lst = part(spark, sf).where("p_size > 25").select((F.col("p_partkey") % 200).alias("gene"), F.col("p_brand").alias("brand"))
    return lst.join(many_strains(spark, sf).where("gene % 3 <> 0").groupBy("gene").agg(r6(F.avg("fc"), "score")), "gene", "left")


@query("j03_two_left", "SELECT l_partkey AS uid, p.p_brand AS entry, s.s_name AS split FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) l LEFT JOIN part p ON l_partkey = p_partkey AND p_size > 10 LEFT JOIN supplier s ON l_suppkey = s_suppkey AND s_acctbal > 0")
def j03(spark, sf):
    l = line(spark, sf).select("l_partkey", "l_suppkey").distinct()  # noqa: E741
    p, s = part(spark, sf).where("p_size > 10"), table(spark, sf, "supplier").where("s_acctbal > 0")
    return l.join(p, F.col("l_partkey") == F.col("p_partkey"), "left").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left").select(F.col("l_partkey").alias("uid"), F.col("p_brand").alias("entry"), F.col("s_name").alias("split"))


@query("j04_outer_features", "SELECT p_partkey AS gene, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS price, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS size FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 5 <> 0")
def j04(spark, sf):
    a = part(spark, sf).where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("gene"), F.lit("price").alias("feature"), F.col("p_retailprice").alias("value"))
    b = part(spark, sf).where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("gene"), F.lit("size").alias("feature"), F.col("p_size").cast("double").alias("value"))
    return a.unionByName(b).groupBy("gene").pivot("feature", ["price", "size"]).agg(F.first("value"))


@query("j05_fallback", "SELECT o_orderkey AS id, coalesce(c.c_name, 'Y' || CAST(o_custkey AS VARCHAR)) AS gene FROM orders LEFT JOIN customer c ON o_custkey = c_custkey AND c_acctbal > 0")
def j05(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 0")
    return table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("id"), F.coalesce("c_name", F.concat(F.lit("Y"), F.col("o_custkey").cast("string"))).alias("gene"))


@query("j06_term_names", "SELECT p_partkey AS gene, CASE WHEN p_size < 15 THEN 'F' WHEN p_size < 30 THEN 'P' ELSE 'GO' END || ':' || coalesce(CASE WHEN p_partkey % 4 <> 0 THEN p_name END, CAST(p_partkey AS VARCHAR)) AS term FROM part")
def j06(spark, sf):
    names = part(spark, sf).where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("k"), "p_name")
    p = part(spark, sf).drop("p_name").join(names, F.col("p_partkey") == F.col("k"), "left")
    aspect = F.when(F.col("p_size") < 15, "F").when(F.col("p_size") < 30, "P").otherwise("GO")
    return p.select(F.col("p_partkey").alias("gene"), F.concat(aspect, F.lit(":"), F.coalesce("p_name", F.col("p_partkey").cast("string"))).alias("term"))


@query("j07_inner", f"WITH {B2}, a AS (SELECT DISTINCT gene FROM e WHERE del), b AS (SELECT DISTINCT gene FROM e WHERE ben AND strain < 5) SELECT a.gene FROM a JOIN b ON a.gene = b.gene")
def j07(spark, sf):
    fc = many_strains(spark, sf)
    return fc.where("fc <= -0.5").select("gene").distinct().join(fc.where("fc >= 0.5 and strain < 5").select("gene").distinct(), "gene")


@query("j08_reindex", "SELECT k AS gene, p_brand AS brand FROM (SELECT l_orderkey, l_linenumber, l_partkey + 5 AS k FROM lineitem) LEFT JOIN part ON k = p_partkey")
def j08(spark, sf):
    want = line(spark, sf).select((F.col("l_partkey") + 5).alias("gene"))
    return want.join(part(spark, sf).select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("brand")), "gene", "left")


@query("j09_semi", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#12')")
def j09(spark, sf):
    return line(spark, sf).join(part(spark, sf).where("p_brand = 'Brand#12'"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("j10_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def j10(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_totalprice > 150000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j11_unseen", "SELECT s_suppkey, s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_orderkey % 9 = 0) AS unseen FROM supplier")
def j11(spark, sf):
    seen = line(spark, sf).where("l_quantity = 50 and l_orderkey % 9 = 0").select(F.col("l_suppkey").alias("k")).distinct()
    return table(spark, sf, "supplier").join(seen, F.col("s_suppkey") == F.col("k"), "left").select("s_suppkey", F.col("k").isNull().alias("unseen"))


@query("j12_nearest", "WITH p AS (SELECT user_id, ts AS pts FROM events WHERE event_type = 'purchase') SELECT event_id, CAST(min(abs(date_diff('microsecond', ts, pts))) AS BIGINT) AS gap FROM events e JOIN p ON e.user_id = p.user_id WHERE event_type = 'click' GROUP BY event_id")
def j12(spark, sf):
    """Microseconds from each click to the nearest purchase of its user: a merge of both by time."""
    from screenfold.operators.joins import nearest_gap

    e = table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    return nearest_gap(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "event_id", "user_id", "at").where("gap is not null")


@query("j13_clone_pairs", "WITH c AS (SELECT p_brand || p_size AS base, p_partkey AS id, p_retailprice AS v FROM part) SELECT a.base, a.id AS id_1, b.id AS id_2, round(abs(a.v - b.v), 6) AS diff FROM c a JOIN c b ON a.base = b.base AND a.id < b.id")
def j13(spark, sf):
    from screenfold.operators.joins import pairs_within

    c = part(spark, sf).select(F.concat("p_brand", F.col("p_size").cast("string")).alias("base"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v"))
    return pairs_within(c, "base", "id", "v").select("base", "id_1", "id_2", rounded(F.abs(F.col("v") - F.col("w"))).alias("diff"))


@query("j16_mean_lookup", "SELECT p_partkey, round(avg(p_retailprice) OVER (PARTITION BY p_brand), 6) AS brand_mean FROM part")
def j16(spark, sf):
    m = part(spark, sf).groupBy("p_brand").agg(r6(F.avg("p_retailprice"), "brand_mean"))
    return part(spark, sf).join(m, "p_brand").select("p_partkey", "brand_mean")


@query("j17_align", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 10")
def j17(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "customer").where("c_nationkey < 10"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("j18_append_dedupe", "SELECT p_partkey AS gene, p_brand AS entry FROM part WHERE p_size <= 30 UNION SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'extra' END FROM part WHERE p_brand = 'Brand#12'")
def j18(spark, sf):
    a = part(spark, sf).where("p_size <= 30").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("entry"))
    b = part(spark, sf).where("p_brand = 'Brand#12'").select(F.col("p_partkey").alias("gene"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("extra").alias("entry"))
    return a.unionByName(b).distinct()


@query("j19_index_equal", "SELECT (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part)) AS only_left, (SELECT CAST(count(*) AS BIGINT) FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem)) AS only_right")
def j19(spark, sf):
    a, b = line(spark, sf).select("l_partkey").distinct(), part(spark, sf).select("p_partkey")
    return a.exceptAll(b).agg(F.count("*").alias("only_left")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_right")))


@query("j20_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def j20(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, sf, "orders").where("o_totalprice > 200000").select("o_custkey"))


@query("j21_last_wins", "SELECT l_partkey AS id, arg_max(l_suppkey, l_orderkey * 1000000000 + l_suppkey) AS name FROM lineitem WHERE l_suppkey % 4 <> 0 GROUP BY l_partkey")
def j21(spark, sf):
    return line(spark, sf).where("l_suppkey % 4 <> 0").groupBy(F.col("l_partkey").alias("id")).agg(F.max_by("l_suppkey", F.expr("l_orderkey * 1000000000 + l_suppkey")).alias("name"))


@query("a18_degree", """WITH ed AS (SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b, a.l_linestatus AS kind FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey WHERE a.l_linestatus = b.l_linestatus),
bw AS (SELECT a, b, kind FROM ed UNION ALL SELECT b, a, kind FROM ed) SELECT a AS gene, CAST(count(DISTINCT b) FILTER (kind = 'F') AS BIGINT) AS physical, CAST(count(DISTINCT b) FILTER (kind = 'O') AS BIGINT) AS genetic FROM bw GROUP BY a""")
def a18(spark, sf):
    l = line(spark, sf).select("l_orderkey", "l_linestatus", F.col("l_partkey").alias("a"))  # noqa: E741
    e = l.join(l.withColumnRenamed("a", "b"), ["l_orderkey", "l_linestatus"]).where("a <> b").select("a", "b", "l_linestatus").distinct()
    kind = lambda k: F.countDistinct(F.when(F.col("l_linestatus") == k, F.col("b")))
    return e.groupBy(F.col("a").alias("gene")).agg(kind("F").alias("physical"), kind("O").alias("genetic"))


@query("o01_sorted_topk", "SELECT p_partkey, p_retailprice, CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS place FROM part QUALIFY place <= 25")
def o01(spark, sf):
    top = part(spark, sf).select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(25)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")))


@query("o02_multi_sort", "SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_name, p_partkey) AS INTEGER) AS place FROM part")
def o02(spark, sf):
    rows = part(spark, sf).select("p_brand", "p_partkey", "p_size", "p_name")
    return numbered(rows, [F.desc("p_size"), F.col("p_name"), F.col("p_partkey")], "place", ["p_brand"]).select("p_brand", "p_partkey", "place")


@query("o03_abs_topk", f"WITH {B2} SELECT gene, strain, round(fc, 6) AS fc, CAST(row_number() OVER (ORDER BY abs(round(fc, 6)) DESC NULLS LAST, gene, strain) AS INTEGER) AS place FROM b2 QUALIFY place <= 15")
def o03(spark, sf):
    by = [F.abs("fc").desc_nulls_last(), "gene", "strain"]
    top = many_strains(spark, sf).withColumn("fc", F.round("fc", 6)).orderBy(*by).limit(15)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*by)))


@query("w08_topn_per_group", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders QUALIFY place <= 3")
def w08(spark, sf):
    from screenfold.operators.windows import top_n

    return top_n(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3, "place").select("o_custkey", "o_orderkey", "place")


def _lists(spark, sf):
    fc = many_strains(spark, sf)
    return fc.where("fc <= -0.7").select("gene").distinct(), fc.where("fc >= 0.7").select("gene").distinct()


_L = f"WITH {B2}, a AS (SELECT DISTINCT gene FROM b2 WHERE fc <= -0.7), b AS (SELECT DISTINCT gene FROM b2 WHERE fc >= 0.7)"


@query("o06_union", f"{_L} SELECT gene FROM a UNION SELECT gene FROM b")
def o06(spark, sf):
    a, b = _lists(spark, sf)
    return a.union(b).distinct()


@query("o07_intersect", f"{_L} SELECT gene FROM a INTERSECT SELECT gene FROM b")
def o07(spark, sf):
    a, b = _lists(spark, sf)
    return a.intersect(b)


@query("o08_difference", f"{_L} SELECT gene FROM a EXCEPT SELECT gene FROM b WHERE gene % 2 = 0")
def o08(spark, sf):
    a, b = _lists(spark, sf)
    return a.subtract(b.where("gene % 2 = 0"))


@query("o09_dedupe", "SELECT DISTINCT g FROM (SELECT CASE WHEN p_size < 5 THEN '' ELSE p_brand END AS g FROM part UNION ALL SELECT p_type FROM part) WHERE length(g) > 0")
def o09(spark, sf):
    a = part(spark, sf).select(F.when(F.col("p_size") < 5, "").otherwise(F.col("p_brand")).alias("g"))
    return a.unionByName(part(spark, sf).select(F.col("p_type").alias("g"))).dropDuplicates(["g"]).where(F.length("g") > 0)


@query("o10_concat", "SELECT 'nation' AS kind, CAST(n_nationkey AS BIGINT) AS id FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS BIGINT) FROM region UNION ALL SELECT 'supplier', s_suppkey FROM supplier")
def o10(spark, sf):
    kinds = (("nation", "n_nationkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey"))
    rows = [table(spark, sf, t).select(F.lit(t).alias("kind"), F.col(c).cast("long").alias("id")) for t, c in kinds]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("r04_metric_pivot", "SELECT o_orderstatus AS model, round(avg(o_totalprice) FILTER (o_orderpriority LIKE '1%'), 6) AS p1, round(avg(o_totalprice) FILTER (o_orderpriority LIKE '2%'), 6) AS p2 FROM orders GROUP BY 1")
def r04(spark, sf):
    return table(spark, sf, "orders").withColumn("k", F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1))).groupBy(F.col("o_orderstatus").alias("model")).pivot("k", ["p1", "p2"]).agg(F.round(F.avg("o_totalprice"), 6))


@query("r07_sets", "SELECT p_brand AS category, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS sizes FROM part GROUP BY p_brand")
def r07(spark, sf):
    return part(spark, sf).groupBy(F.col("p_brand").alias("category")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("p_size")), lambda x: x.cast("string")), ",").alias("sizes"))


@query("r08_feature_pairs", "SELECT p_partkey AS gene, 'feature_type:' || p_type AS category FROM part WHERE p_type <> ''")
def r08(spark, sf):
    return part(spark, sf).where("p_type <> ''").select(F.col("p_partkey").alias("gene"), F.concat(F.lit("feature_type:"), "p_type").alias("category"))


@query("r09_dual_label", "SELECT p_partkey AS gene, unnest([p_brand, 'in_any_complex']) AS category FROM part")
def r09(spark, sf):
    return part(spark, sf).select(F.col("p_partkey").alias("gene"), F.explode(F.array("p_brand", F.lit("in_any_complex"))).alias("category"))


@query("a30_complete", "WITH k AS (SELECT l_partkey AS uid, CAST(count(DISTINCT l_returnflag) AS BIGINT) AS n FROM lineitem GROUP BY 1) SELECT uid, n = 3 AS complete FROM k")
def a30(spark, sf):
    return line(spark, sf).groupBy(F.col("l_partkey").alias("uid")).agg(F.countDistinct("l_returnflag").alias("n")).select("uid", (F.col("n") == 3).alias("complete"))


@query("a31_first_of", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def a31(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").withColumn("k", F.row_number().over(w)).where("k = 1").select("o_custkey", "o_orderkey")


@query("a34_blanks", "SELECT 'lang' AS col, CAST(count(*) FILTER (lang = '') AS BIGINT) AS blanks FROM documents UNION ALL SELECT 'source', CAST(count(*) FILTER (source = 'src1') AS BIGINT) FROM documents")
def a34(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.when(F.col("source") == "src1", "").otherwise(F.col("source")).alias("source"))
    return d.agg(*[F.count_if(F.col(c) == "").alias(c) for c in d.columns]).unpivot([], ["lang", "source"], "col", "blanks")


@query("f09_drops", "SELECT p_partkey FROM part WHERE p_size <> 1 AND p_brand <> 'Brand#11' AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 1)")
def f09(spark, sf):
    p, keys = part(spark, sf), ["p_partkey"]
    gone = [p.where("p_size = 1").select(*keys), p.where("p_brand = 'Brand#11'").select(*keys), line(spark, sf).where("l_quantity = 1").select(F.col("l_partkey").alias("p_partkey"))]
    for g in gone:
        p = p.join(g, "p_partkey", "left_anti")
    return p.select("p_partkey")


@query("a19_drop_summary", "SELECT p_type AS strain, CAST(count(*) FILTER (p_size = 1) AS BIGINT) AS dubious, CAST(count(*) FILTER (p_size <> 1 AND p_brand = 'Brand#11') AS BIGINT) AS nonfunctional, CAST(count(*) FILTER (p_size <> 1 AND p_brand <> 'Brand#11') AS BIGINT) AS kept FROM part GROUP BY 1")
def a19(spark, sf):
    why = F.when(F.col("p_size") == 1, "dubious").when(F.col("p_brand") == "Brand#11", "nonfunctional").otherwise("kept")
    return part(spark, sf).withColumn("why", why).groupBy(F.col("p_type").alias("strain")).pivot("why", ["dubious", "nonfunctional", "kept"]).count().na.fill(0)


@query("f10_any_cell", "SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE 'ASIA' IN (n_name, r_name)")
def f10(spark, sf):
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.unpivot(["n_nationkey"], ["n_name", "r_name"], "c", "v").where("v = 'ASIA'").select("n_nationkey").distinct()


@query("f11_duplicates", "SELECT p_partkey, p_brand, p_size FROM part QUALIFY count(*) OVER (PARTITION BY p_brand, p_size) > 1")
def f11(spark, sf):
    return part(spark, sf).select("p_partkey", "p_brand", "p_size").withColumn("k", F.count("*").over(Window.partitionBy("p_brand", "p_size"))).where("k > 1").drop("k")


@query("f12_constant_rows", "SELECT l_suppkey AS gene, coalesce(var_samp(l_quantity), 0) = 0 AS constant FROM (SELECT DISTINCT l_suppkey, CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE l_quantity END AS l_quantity FROM lineitem) GROUP BY 1")
def f12(spark, sf):
    x = line(spark, sf).select("l_suppkey", F.when(F.col("l_suppkey") % 10 == 0, 1.0).otherwise(F.col("l_quantity")).alias("q")).distinct()
    return x.groupBy(F.col("l_suppkey").alias("gene")).agg((F.min("q") == F.max("q")).alias("constant"))


@query("f13_all_null", f"WITH {B2} SELECT gene FROM b2 GROUP BY gene HAVING count(fc) > 0")
def f13(spark, sf):
    wide = many_strains(spark, sf).groupBy("gene").pivot("strain", list(range(25))).agg(F.first("fc"))
    return wide.na.drop("all", subset=[str(i) for i in range(25)]).select("gene")


@query("f14_interactions", "SELECT l_partkey AS a, l_suppkey AS b, l_linestatus AS kind FROM lineitem WHERE l_partkey <> l_suppkey AND l_returnflag = 'A' AND l_linestatus <> ''")
def f14(spark, sf):
    return line(spark, sf).where("l_partkey <> l_suppkey and l_returnflag = 'A' and l_linestatus <> ''").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_linestatus").alias("kind"))


@query("f15_essential", "SELECT p_partkey FROM part WHERE p_name ILIKE '%a%' OR p_type ILIKE '%promo%'")
def f15(spark, sf):
    return part(spark, sf).where("p_name ilike '%a%' or p_type ilike '%promo%'").select("p_partkey")
