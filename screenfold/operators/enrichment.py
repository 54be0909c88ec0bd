"""Tests of gene lists against categories and features. All lists run in one job."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from screenfold.functions import kernels
from screenfold.operators.scan import ranked_values
from screenfold.operators.windows import with_fdr


@F.pandas_udf(DoubleType())
def _hyper_tail(hits: pd.Series, population: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
    return pd.Series(kernels.hypergeometric_tails(hits.to_numpy(), population.to_numpy(), marked.to_numpy(), drawn.to_numpy()))


@F.pandas_udf(DoubleType())
def _rank_sum_p(u: pd.Series, n1: pd.Series, n2: pd.Series, tied: pd.Series, z: pd.Series) -> pd.Series:
    """Exact if a side has 8 or fewer and nothing is tied, else normal."""
    out = kernels.erfc(np.maximum(z.to_numpy(dtype=float), 0) / math.sqrt(2))
    for k in np.flatnonzero((np.minimum(n1, n2) <= 8) & ~tied.astype(bool)):
        out[k] = kernels.rank_sum_exact(u.iloc[k], int(n1.iloc[k]), int(n2.iloc[k]))
    return pd.Series(out)


def over_representation_of_lists(lists: DataFrame, background: DataFrame, categories: DataFrame, least_category: int = 3, least_query: int = 1, p_cut: float = 5e-4) -> DataFrame:
    """Hypergeometric tests of each (list_id, gene) list in each category.

    Genes outside the background do not count. Categories of fewer than ``least_category`` genes and
    those without a hit are left out before the false-discovery rates, which are by list.
    """
    base = background.select("gene").distinct()
    lists = lists.select("list_id", "gene").distinct().join(base, "gene", "left_semi")
    cats = categories.select("gene", "category").distinct().join(base, "gene", "left_semi")
    total = base.agg(F.count("*").alias("background_size"))
    sizes = lists.groupBy("list_id").agg(F.count("*").alias("query_size")).where(F.col("query_size") >= least_query)
    per = cats.groupBy("category").agg(F.count("*").alias("category_size")).where(F.col("category_size") >= least_category)
    hits = lists.join(cats, "gene").groupBy("list_id", "category").agg(F.count("*").alias("observed"))
    rows = hits.join(sizes, "list_id").join(per, "category").crossJoin(total)
    rows = rows.withColumn("expected", F.col("query_size") * F.col("category_size") / F.col("background_size").cast("double"))
    rows = rows.withColumn("fold", F.try_divide(F.col("observed").cast("double"), F.col("expected"))).withColumn("pvalue", _hyper_tail("observed", "background_size", "category_size", "query_size"))
    done = with_fdr(rows, "pvalue", ["list_id"])
    return done.withColumn("passes_p_threshold", F.col("pvalue") < p_cut).withColumn("passes_fdr_05", F.col("fdr") < 0.05)


def over_representation(query: DataFrame, background: DataFrame, categories: DataFrame, **options) -> DataFrame:
    return over_representation_of_lists(query.select(F.lit("query").alias("list_id"), "gene"), background, categories, **options)


def list_overlap(a: DataFrame, b: DataFrame, universe: DataFrame) -> DataFrame:
    """One row: sizes, overlap and the chance of as large an overlap; none has p 1."""
    u = universe.select("gene").distinct()
    flag = lambda d, n: d.select("gene", F.lit(True).alias(n)).distinct()
    rows = u.join(flag(a, "a"), "gene", "left").join(flag(b, "b"), "gene", "left")
    got = rows.agg(F.count("*").alias("universe"), F.count("a").alias("list_a"), F.count("b").alias("list_b"), F.count_if(F.col("a") & F.col("b")).alias("overlap"))
    got = got.withColumn("expected", F.try_divide(F.col("list_a").cast("double") * F.col("list_b"), F.col("universe")))
    return got.withColumn("fold", F.try_divide(F.col("overlap").cast("double"), F.col("expected"))).withColumn("pvalue", _hyper_tail("overlap", "universe", "list_b", "list_a"))


def rank_sum(query: DataFrame, background: DataFrame, features: DataFrame, least: int = 3) -> DataFrame:
    """Two-sided rank-sum test of each feature, the query against the rest of the background."""
    rows = features.where("value is not null").join(background.select("gene").distinct(), "gene", "left_semi")
    rows = rows.join(query.select("gene", F.lit(True).alias("q")).distinct(), "gene", "left").withColumn("q", F.coalesce("q", F.lit(False)))
    # equal values are one row until their rank is joined back, so no feature is one task
    places = ranked_values(rows, ["feature"], "value").select("feature", "value", (F.col("upto") - (F.col("ties") - 1) / 2.0).alias("r"), F.col("ties").alias("t"))
    rows = rows.join(places, ["feature", "value"])
    inq = F.col("q")
    got = rows.groupBy("feature").agg(
        F.count_if(inq).alias("n_query"), F.count_if(~inq).alias("n_background"), F.sum(F.when(inq, F.col("r"))).alias("r1"), F.median(F.when(inq, F.col("value"))).alias("median_query"),
        F.median(F.when(~inq, F.col("value"))).alias("median_background"), F.sum((F.col("t") * F.col("t") - 1).cast("double")).alias("ties"),
    ).where((F.col("n_query") >= least) & (F.col("n_background") >= least))
    n1, n2 = F.col("n_query").cast("double"), F.col("n_background").cast("double")
    got = got.withColumn("statistic", F.col("r1") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - F.col("ties") / ((n1 + n2) * (n1 + n2 - 1))))
    got = got.withColumn("z", F.try_divide(F.abs(F.col("statistic") - n1 * n2 / 2) - 0.5, sd))
    got = got.withColumn("pvalue", _rank_sum_p("statistic", "n_query", "n_background", (F.col("ties") > 0), F.coalesce("z", F.lit(0.0))))
    way = F.when(F.col("median_query") > F.col("median_background"), "higher").when(F.col("median_query") < F.col("median_background"), "lower").otherwise("equal")
    return with_fdr(got.withColumn("direction", way), "pvalue")


def both_tests(query: DataFrame, background: DataFrame, categories: DataFrame, features: DataFrame) -> DataFrame:
    """(test, term, statistic, n_query, n_rest, pvalue, fdr): over-representation in each category and
    rank sums of each feature. Empty categories or features leave their test out."""
    hyper = over_representation(query, background, categories)
    hyper = hyper.select(F.lit("hypergeometric").alias("test"), F.col("category").alias("term"), F.col("observed").cast("double").alias("statistic"), F.col("query_size").alias("n_query"), (F.col("background_size") - F.col("query_size")).alias("n_rest"), "pvalue", "fdr")
    ranks = rank_sum(query, background, features)
    return hyper.unionByName(ranks.select(F.lit("wilcoxon").alias("test"), F.col("feature").alias("term"), "statistic", "n_query", F.col("n_background").alias("n_rest"), "pvalue", "fdr"))


def balance_tests(query: DataFrame, background: DataFrame, features: DataFrame, members: DataFrame, dropped: DataFrame, p_cut: float = 5e-4) -> DataFrame:
    """(subset, test, term, in_query, in_background, direction, pvalue, passes_p_threshold): features and
    one category's members in the query, with all genes and without the ``dropped`` ones."""
    out = None
    for subset, keep in (("all genes", lambda d: d), ("without dropped", lambda d: d.join(dropped.select("gene"), "gene", "left_anti"))):
        q = keep(query.select("gene"))
        base = keep(query.select("gene").unionByName(background.select("gene")).distinct())
        ranks = rank_sum(q, base, features).select(F.lit("rank sum").alias("test"), F.col("feature").alias("term"), F.col("median_query").alias("in_query"), F.col("median_background").alias("in_background"), "direction", "pvalue")
        way = F.when(F.col("observed") > F.col("expected"), "higher").otherwise("lower")
        hyper = over_representation(q, base, members).select(F.lit("hypergeometric").alias("test"), F.col("category").alias("term"), F.col("observed").cast("double").alias("in_query"), F.col("expected").alias("in_background"), way.alias("direction"), "pvalue")
        both = ranks.unionByName(hyper).select(F.lit(subset).alias("subset"), "*", (F.col("pvalue") < p_cut).alias("passes_p_threshold"))
        out = both if out is None else out.unionByName(both)
    return out
