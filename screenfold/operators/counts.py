"""Count tables in long form: grids, lane sums, library sizes and normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenfold.operators.scan import exact_quantiles, mean_ranks_of
from screenfold.plans.session import stash


def densify(counts: DataFrame, genes: Sequence[str], samples: Sequence[str], value: str = "n") -> DataFrame:
    """Every gene in every sample, with 0 where nothing was counted.

    Samples are few: they become one array that each gene explodes, so no grid is joined twice.
    """
    sheet = counts.select(F.struct(*samples).alias("s")).distinct().agg(F.array_sort(F.collect_list("s")).alias("sheet"))
    grid = counts.select(*genes).distinct().crossJoin(sheet).withColumn("s", F.explode("sheet")).select(*genes, "s.*")
    return grid.join(counts.select(*genes, *samples, value), [*genes, *samples], "left").na.fill(0, [value])


def lane_sum(lanes: Sequence[DataFrame], keys: Sequence[str], value: str = "n") -> DataFrame:
    """Element-wise sum of aligned tables; a cell that a lane lacks is missing in the sum."""
    both = lanes[0]
    for lane in lanes[1:]:
        both = both.unionByName(lane)
    return both.groupBy(*keys).agg(F.when(F.count(value) == len(lanes), F.sum(value)).alias(value))


def library_size(sample: Sequence[str], value: str = "n") -> Column:
    return F.sum(value).over(Window.partitionBy(*sample))


def cpm(counts: DataFrame, sample: Sequence[str], value: str = "n", out: str = "cpm", guard: bool = True) -> DataFrame:
    """Counts per million of the library; a library without reads gives 0, or null without ``guard``."""
    share = F.try_divide(F.col(value).cast("double"), library_size(sample, value).cast("double")) * 1e6
    return counts.withColumn(out, F.coalesce(share, F.lit(0.0)) if guard else share)


def trimmed_mean_factors(counts: DataFrame, gene: str, sample: str, value: str = "n", trim_ratio: float = 0.3, trim_level: float = 0.05) -> DataFrame:
    """(sample, factor): trimmed mean of log ratios against a reference sample.

    The reference is the sample whose upper quartile, as a share of its library, is nearest the mean
    of all; among genes seen in both, extreme ratios and levels are trimmed by average rank and the
    rest weighted by inverse variance. Factors are centred to a geometric mean of 1. Quartiles and
    ranks are scans in slices, so the genes of a sample never meet in one task.
    """
    rows = counts.select(F.col(gene).alias("g"), F.col(sample).alias("s"), F.col(value).cast("double").alias("n"))
    # genes without any read do not take part
    rows = rows.withColumn("gt", F.sum("n").over(Window.partitionBy("g"))).where("gt > 0")
    rows = stash(rows, "reads")
    upper = exact_quantiles(rows, ["s"], "n", [0.75]).select("s", F.col("q")[0].alias("q"))
    quart = rows.groupBy("s").agg(F.sum("n").alias("lib")).join(upper, "s").withColumn("uq", F.try_divide("q", "lib"))
    every = Window.partitionBy()  # samples, of which there are few
    quart = quart.withColumn("off", F.abs(F.col("uq") - F.avg("uq").over(every))).withColumn("ref", F.min(F.struct("off", "s")).over(every)["s"])
    rows = rows.join(quart.select("s", "lib", "ref"), "s")
    ref = rows.where("s = ref").select("g", F.col("n").alias("rn"), F.col("lib").alias("rlib"))
    both = rows.where("s <> ref and n > 0").join(ref.where("rn > 0"), "g")
    both = both.select("s", "g", F.log2((F.col("n") / F.col("lib")) / (F.col("rn") / F.col("rlib"))).alias("m"), (F.log2((F.col("n") / F.col("lib")) * (F.col("rn") / F.col("rlib"))) / 2).alias("a"), ((F.col("lib") - F.col("n")) / (F.col("lib") * F.col("n")) + (F.col("rlib") - F.col("rn")) / (F.col("rlib") * F.col("rn"))).alias("v"))
    both = stash(both, "ratios")
    both = mean_ranks_of(both, ["s"], {"rm": "m", "ra": "a"}).join(both.groupBy("s").agg(F.count("*").alias("k")), "s")

    def inside(rank: str, trim: float) -> Column:
        low = F.floor(F.col("k") * trim) + 1
        return (F.col(rank) >= low) & (F.col(rank) <= F.col("k") + 1 - low)

    kept = both.where(inside("rm", trim_ratio) & inside("ra", trim_level))
    logs = kept.groupBy("s").agg((F.sum(F.col("m") / F.col("v")) / F.sum(1 / F.col("v"))).alias("f"))
    out = quart.select("s").join(logs, "s", "left").withColumn("f", F.coalesce("f", F.lit(0.0)) * F.lit(0.6931471805599453))
    return out.select(F.col("s").alias(sample), F.exp(F.col("f") - F.avg("f").over(every)).alias("factor"))


def impute_mask(counts: DataFrame, gene: str, strain: str, gen: str, cpm_col: str = "cpm", value: str = "n", rule: str = "all_zero", threshold: float = 20.0) -> DataFrame:
    """Adds ``imputed``: zero end-point cells of genes present at the start.

    Present: every start replicate at ``threshold`` CPM or more. ``all_zero`` asks that every end
    replicate be 0, ``any_zero`` that one is.
    """
    w = Window.partitionBy(gene, strain)
    start, end = F.col(gen) == 0, F.col(gen) == 10
    present = F.coalesce(F.every(F.when(start, F.col(cpm_col) >= threshold)).over(w), F.lit(False))
    zero = F.when(end, F.col(value) == 0)
    dropped = F.coalesce((F.every(zero) if rule == "all_zero" else F.bool_or(zero)).over(w), F.lit(False))
    return counts.withColumn("imputed", end & (F.col(value) == 0) & present & dropped)


def add_pseudocount(counts: DataFrame, sample: Sequence[str], value: str = "n", amount: float = 1.0) -> DataFrame:
    """Imputed cells get ``amount`` reads, then every library is normalised again."""
    filled = counts.withColumn("filled", F.col(value) + F.when(F.col("imputed"), amount).otherwise(0.0))
    return cpm(filled, sample, "filled", "cpm")
