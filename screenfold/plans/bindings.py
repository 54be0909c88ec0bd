"""How the shared test tables stand in for screens: the same tables as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenfold.operators.counts import densify

SAMPLE = ("strain", "gen", "rep")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _arms(spark: SparkSession, sf: str, gene: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col(gene).alias("gene"), F.col("l_returnflag").alias("strain"), F.when(F.col("l_linestatus") == "F", 0).otherwise(10).alias("gen"), (F.col("l_linenumber") % 3).cast("int").alias("rep"), "l_quantity")
    return rows.groupBy("gene", *SAMPLE).agg(F.sum("l_quantity").cast("long").alias("n"))


def counts(spark: SparkSession, sf: str, gene: str = "l_partkey") -> DataFrame:
    """B1 (by part) and B1d (by supplier): dense counts of genes in strains, generations, replicates."""
    return densify(_arms(spark, sf, gene), ["gene"], list(SAMPLE))


def many_strains(spark: SparkSession, sf: str) -> DataFrame:
    """B2: (gene, strain, fc) of 200 genes in the strains of suppliers' nations."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.groupBy((F.col("l_partkey") % 200).alias("gene"), F.col("s_nationkey").alias("strain"), F.when(F.col("l_linestatus") == "F", 0).otherwise(10).alias("gen")).agg(F.sum("l_quantity").cast("long").alias("n"))
    from screenfold.operators.counts import cpm
    from screenfold.operators.fitness import log2_ratio

    both = cpm(rows, ["strain", "gen"]).groupBy("gene", "strain").agg(F.max(F.when(F.col("gen") == 10, F.col("cpm"))).alias("end"), F.max(F.when(F.col("gen") == 0, F.col("cpm"))).alias("start"))
    return both.select("gene", "strain", log2_ratio("end", "start").alias("fc"))


def _b1_sql(gene: str) -> str:
    return f"""r AS (SELECT {gene} AS gene, l_returnflag AS strain, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 10 END AS gen,
  CAST(l_linenumber % 3 AS INTEGER) AS rep, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL),
b1 AS (SELECT g.gene, s.strain, s.gen, s.rep, coalesce(r.n, 0) AS n FROM (SELECT DISTINCT gene FROM r) g CROSS JOIN (SELECT DISTINCT strain, gen, rep FROM r) s
  LEFT JOIN r ON r.gene = g.gene AND r.strain = s.strain AND r.gen = s.gen AND r.rep = s.rep),
c AS (SELECT *, n * 1e6 / sum(n) OVER (PARTITION BY strain, gen, rep) AS cpm FROM b1)"""


B1 = _b1_sql("l_partkey")
B1D = _b1_sql("l_suppkey")
B2 = """b2c AS (SELECT l_partkey % 200 AS gene, s_nationkey AS strain, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 10 END AS gen,
  CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
b2p AS (SELECT *, n * 1e6 / sum(n) OVER (PARTITION BY strain, gen) AS cpm FROM b2c),
b2 AS (SELECT gene, strain, log2(max(CASE WHEN gen = 10 THEN cpm END) / max(CASE WHEN gen = 0 THEN cpm END)) AS fc FROM b2p GROUP BY gene, strain),
e AS (SELECT *, coalesce(fc <= -0.5, false) AS del, coalesce(fc >= 0.5, false) AS ben FROM b2)"""
