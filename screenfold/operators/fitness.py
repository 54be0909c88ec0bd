"""Effects between start and end, and tests of them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenfold.functions import kernels
from screenfold.operators.windows import with_fdr
from screenfold.plans.session import shuffle_width, stash

FLOOR = 1e-8


def arm_means(values: DataFrame, keys: Sequence[str], gen: str, value: str) -> DataFrame:
    """Mean over replicates of each arm."""
    arm = lambda g, n: F.avg(F.when(F.col(gen) == g, F.col(value))).alias(n)
    return values.groupBy(*keys).agg(arm(0, "mean0"), arm(10, "mean10"))


def log2_ratio_floored(end: str, start: str) -> Column:
    return F.log2(F.greatest(F.col(end), F.lit(FLOOR)) / F.greatest(F.col(start), F.lit(FLOOR)))


def log2_ratio(end: str, start: str) -> Column:
    """Null instead of an infinity or NaN."""
    return F.log2(F.try_divide(F.col(end), F.col(start)))


def replicate_fitness(values: DataFrame, keys: Sequence[str], rep: str, gen: str, value: str) -> DataFrame:
    """(keys, rep, fitness): end over start of the same replicate."""
    both = arm_means(values, [*keys, rep], gen, value)
    return both.select(*keys, rep, log2_ratio("mean10", "mean0").alias("fitness"))


def deviance_term(y: Column, mu: Column, phi: float) -> Column:
    """One observation's negative-binomial deviance; 0 log 0 is 0."""
    r = 1.0 / phi
    head = F.when(y > 0, y * F.ln(y / mu)).otherwise(F.lit(0.0))
    return 2 * (head - (y + r) * F.ln((y + r) / (mu + r)))


def likelihood_ratio(values: DataFrame, keys: Sequence[str], gen: str, value: str, phi: float) -> DataFrame:
    """(keys, mean0, mean10, log2fc, lr): two arms against one mean, at a fixed dispersion.

    With equal library sizes the fitted means are the arm means, so no iteration is needed.
    """
    w = Window.partitionBy(*keys)
    arm = Window.partitionBy(*keys, gen)
    rows = values.withColumn("_all", F.greatest(F.avg(value).over(w), F.lit(FLOOR))).withColumn("_arm", F.greatest(F.avg(value).over(arm), F.lit(FLOOR)))
    y = F.col(value)
    gain = deviance_term(y, F.col("_all"), phi) - deviance_term(y, F.col("_arm"), phi)
    m = lambda g, n: F.max(F.when(F.col(gen) == g, F.col("_arm"))).alias(n)
    out = rows.groupBy(*keys).agg(m(0, "mean0"), m(10, "mean10"), F.greatest(F.lit(0.0), F.sum(gain)).alias("lr"))
    return out.withColumn("log2fc", F.log2(F.col("mean10") / F.col("mean0")))


def _slice_offsets(table: pa.Table) -> pa.Table:
    """Of the slices of a strain: genes and profile sums before each, of all, and the best common grid point."""
    table = table.sort_by("slice")
    n = table.column("n").to_numpy()
    sums = np.array(table.column("sums").to_pylist())
    upto = np.cumsum(sums, 0)
    rows = len(n)
    best = float(kernels.GRID[int(upto[-1].argmax())])
    return pa.table({"strain": table.column("strain"), "slice": table.column("slice"), "before": pa.array(np.cumsum(n) - n), "held": pa.array(list(upto - sums), pa.list_(pa.float64())), "genes": pa.array(np.full(rows, n.sum())), "common": pa.array(np.full(rows, best))})


def estimate_dispersions(values: DataFrame, gene: str, strain: str, gen: str, value: str, prior_df: float = 10.0, span: float = 0.3) -> DataFrame:
    """(strain, gene, common, trended, tagwise).

    Genes are cut into slices of their order of abundance, written once. A task makes the profile
    likelihoods of its slice over a fixed grid and their running sums, one array a gene; sums of slices
    are added up, slice by slice. The common dispersion is where the sum of all is largest; the trend
    is the mean over the ``span`` nearest ranks, taken as the difference of the running sums at the two
    ends, which are joined by rank; tagwise likelihoods add the trend with the weight ``prior_df`` over
    the gene's residual degrees of freedom (samples less arms). Ties take the lowest grid point, genes
    of equal level their order. A strain's genes are never one task.
    """
    rows = values.select(F.col(strain).alias("strain"), F.col(gene).alias("gene"), F.col(gen).alias("gen"), F.col(value).cast("double").alias("y"))
    packed = rows.groupBy("strain", "gene").agg(F.sort_array(F.collect_list(F.when(F.col("gen") == 0, F.col("y")))).alias("y0"), F.sort_array(F.collect_list(F.when(F.col("gen") == 10, F.col("y")))).alias("y1"), F.avg("y").alias("level")).where("level > 0")
    arms = (F.size("y0") > 0).cast("int") + (F.size("y1") > 0).cast("int")
    packed = packed.withColumn("df", F.greatest(F.lit(1), F.size("y0") + F.size("y1") - arms))
    kinds = dict(packed.dtypes)
    order = [F.col("strain"), F.col("level"), F.col("gene")]
    cut = packed.repartitionByRange(shuffle_width(values.sparkSession), *order).sortWithinPartitions(*order).withColumn("slice", F.spark_partition_id())
    cut = cut.select("strain", "gene", "slice", "df", "y0", "y1")

    def profile(batches):
        at, name, sums = 0, object(), 0.0  # no strain yet
        for b in batches:
            ll = kernels.adjusted_profiles(b.column(4).to_pylist(), b.column(5).to_pylist())
            upto, ranks = np.empty_like(ll), np.empty(len(ll), np.int64)
            for k, s in enumerate(b.column(0).to_pylist()):
                if s != name:
                    at, name, sums = 0, s, np.zeros(len(kernels.GRID))
                at, sums = at + 1, sums + ll[k]
                ranks[k], upto[k] = at, sums
            arrays = [pa.array(list(x), pa.list_(pa.float64())) for x in (ll, upto)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(4)), pa.array(ranks), *arrays], ["strain", "gene", "slice", "df", "own_rank", "ll", "own_upto"])

    made = stash(cut.mapInArrow(profile, f"strain {kinds['strain']}, gene {kinds['gene']}, slice int, df int, own_rank long, ll array<double>, own_upto array<double>"), "profiles")
    slices = made.groupBy("strain", "slice").agg(F.count("*").alias("n"), F.max_by("own_upto", "own_rank").alias("sums"))
    offsets = slices.groupBy("strain").applyInArrow(_slice_offsets, f"strain {kinds['strain']}, slice int, before long, held array<double>, genes long, common double")
    made = made.join(offsets, ["strain", "slice"])
    made = made.withColumn("rank", F.col("own_rank") + F.col("before")).withColumn("upto", F.zip_with("own_upto", "held", lambda a, b: a + b))
    half = F.floor(F.greatest(F.lit(3), F.round(F.lit(span) * F.col("genes"))) / 2).cast("int")
    first, last = F.greatest(F.col("rank") - half, F.lit(1)) - 1, F.least(F.col("rank") + half, F.col("genes"))
    ends = made.select("strain", "rank", "upto")
    near = made.select("strain", "gene", "df", "ll", "common", first.alias("first"), last.alias("last"))
    near = near.join(ends.toDF("strain", "last", "to_last"), ["strain", "last"]).join(ends.toDF("strain", "first", "to_first"), ["strain", "first"], "left")
    near = near.select("strain", "gene", "common", "df", (F.col("last") - F.col("first")).alias("wide"), "ll", "to_last", F.coalesce("to_first", F.array(*[F.lit(0.0)] * len(kernels.GRID))).alias("to_first"))

    def choose(batches):
        grid = lambda c: c.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(kernels.GRID))
        for b in batches:
            if b.num_rows:
                trend = (grid(b.column("to_last")) - grid(b.column("to_first"))) / b.column("wide").to_numpy()[:, None]
                tag = grid(b.column("ll")) + prior_df / b.column("df").to_numpy()[:, None] * trend
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(kernels.GRID[trend.argmax(1)]), pa.array(kernels.GRID[tag.argmax(1)])], ["strain", "gene", "common", "trended", "tagwise"])

    return near.mapInArrow(choose, f"strain {kinds['strain']}, gene {kinds['gene']}, common double, trended double, tagwise double")


def fitness_table(values: DataFrame, gene: str, strain: str, gen: str, value: str) -> DataFrame:
    """(strain, gene, log2fc, lr, pvalue, fdr, dispersion, mean0, mean10) with tagwise dispersions."""
    disp = estimate_dispersions(values, gene, strain, gen, value).select(F.col("strain").alias(strain), F.col("gene").alias(gene), F.col("tagwise").alias("dispersion"))
    packed = values.groupBy(strain, gene).agg(F.sort_array(F.collect_list(F.when(F.col(gen) == 0, F.col(value).cast("double")))).alias("y0"), F.sort_array(F.collect_list(F.when(F.col(gen) == 10, F.col(value).cast("double")))).alias("y1"))
    rows = packed.join(disp, [strain, gene])

    mean = lambda c: F.greatest(F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c), F.lit(FLOOR))
    rows = rows.withColumn("mean0", mean(F.col("y0"))).withColumn("mean10", mean(F.col("y1")))
    joint = F.concat("y0", "y1")
    rows = rows.withColumn("every", mean(joint))

    def dev(c, mu):
        r = 1 / F.col("dispersion")
        return F.aggregate(c, F.lit(0.0), lambda a, y: a + 2 * (F.when(y > 0, y * F.ln(y / mu)).otherwise(0.0) - (y + r) * F.ln((y + r) / (mu + r))))

    rows = rows.withColumn("lr", F.greatest(F.lit(0.0), dev(joint, F.col("every")) - dev(F.col("y0"), F.col("mean0")) - dev(F.col("y1"), F.col("mean10"))))
    rows = rows.withColumn("log2fc", F.log2(F.col("mean10") / F.col("mean0"))).withColumn("pvalue", kernels.chi2_tail_udf("lr", F.lit(1)))
    return with_fdr(rows.select(strain, gene, "log2fc", "lr", "pvalue", "dispersion", "mean0", "mean10"), "pvalue", [strain])
