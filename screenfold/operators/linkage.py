"""Average-linkage clustering of any number of genes.

With cosine or correlation distance the mean distance of two clusters follows from the sums of their
unit profiles, d = 1 - A.B / (|A| |B|), so a cluster is one row with a vector and no table of distances is
kept. Average linkage is reducible: clusters that are each other's nearest may merge at once, in any
order, and give the same tree. Rounds compare clusters block by block and merge all such pairs, until
what is left fits one task, which ends the sequence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenfold.operators.scan import numbered
from screenfold.plans.session import Scratch, shuffle_width, stash

#: Clusters that one task merges to the end, clusters of a block, merges whose leaves one task puts in order.
ONE_TASK, BLOCK, LEAVES = 2000, 2000, 100_000
MERGES = "round int, root long, left_round int, left long, right_round int, right long, height double, size long"


def unit_profiles(profiles: DataFrame, gene: str, values: str, metric: str) -> DataFrame:
    """(root, round, size, v) of single genes: their place in order, and the profile as a unit vector.

    Missing values count as 0; a profile without any length stays 0 and is at distance 1 of all.
    """
    v = F.transform(values, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    if metric == "correlation":
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        v = F.transform(v, lambda x: x - total(v) / F.size(v))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = profiles.select(F.col(gene).alias("gene"), v.alias("v")).withColumn("norm", norm)
    rows = rows.withColumn("v", F.when(F.col("norm") > 0, F.transform("v", lambda x: x / F.col("norm"))).otherwise(F.col("v")))
    return numbered(rows, [F.col("gene")], "root", start=0).select(F.col("root").cast("long").alias("root"), F.lit(-1).alias("round"), F.lit(1).cast("long").alias("size"), "v")


def nearest(clusters: DataFrame, n: int) -> DataFrame:
    """(root, other, height): each cluster's nearest, of equals the pair with the smallest roots.

    Blocks of clusters meet two at a time as matrices; each cluster gets one row from a pair of blocks.
    """
    k = max(1, -(-n // BLOCK))
    rows = clusters.withColumn("blk", F.pmod(F.xxhash64("root"), F.lit(k)).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    rows = rows.select(F.least("blk", "with").alias("i"), F.greatest("blk", "with").alias("j"), "blk", "root", "size", "v")

    def meet(key, table):
        table = table.sort_by("root")
        blk, root, size = (table.column(c).to_numpy() for c in ("blk", "root", "size"))
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(root), -1) / size[:, None]
        a, b = (np.flatnonzero(blk == x.as_py()) for x in key)
        out = []
        if len(a) and len(b):
            d = 1 - v[a] @ v[b].T
            d[root[a][:, None] == root[b][None, :]] = np.inf
            for own, others, m in ((a, b, d), (b, a, d.T)) if key[0] != key[1] else ((a, b, np.minimum(d, d.T)),):
                least = m.argmin(1)  # rows are by root, so of equals the smallest
                out.append((root[own], root[others][least], m[np.arange(len(own)), least]))
        cells = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, float))]
        fine = np.isfinite(cells[2])
        return pa.table([pa.array(c[fine]) for c in cells], ["root", "other", "height"])

    found = rows.groupBy("i", "j").applyInArrow(meet, "root long, other long, height double")
    # pairs in one order for both ends: height, then the smaller root, then the larger
    first = F.min(F.struct("height", F.least("root", "other").alias("low"), F.greatest("root", "other").alias("high"), "other")).alias("m")
    return found.groupBy("root").agg(first).select("root", "m.other", "m.height")


def _finish(table: pa.Table, begin: int) -> pa.Table:
    """All merges of the clusters that are left, each step of them a round of its own from ``begin`` on."""
    table = table.sort_by("root")
    root, made, size = (table.column(c).to_pylist() for c in ("root", "round", "size"))
    n = len(root)
    out = []
    if n > 1:
        sizes = np.array(size, float)
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1) / sizes[:, None]
        d = 1 - v @ v.T
        d = np.minimum(d, d.T)
        np.fill_diagonal(d, np.inf)
        for step in range(n - 1):
            i, j = divmod(int(np.argmin(d)), n)
            i, j = min(i, j), max(i, j)
            out.append((begin + step, root[i], made[i], root[i], made[j], root[j], float(d[i, j]), int(sizes[i] + sizes[j])))
            merged = (d[i] * sizes[i] + d[j] * sizes[j]) / (sizes[i] + sizes[j])
            d[i], d[:, i] = merged, merged
            d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
            sizes[i] += sizes[j]
            made[i] = begin + step
    names = [f.split()[0] for f in MERGES.split(", ")]
    kinds = [pa.int32() if f.split()[1] == "int" else pa.float64() if f.split()[1] == "double" else pa.int64() for f in MERGES.split(", ")]
    return pa.table({c: pa.array([o[k] for o in out], t) for k, (c, t) in enumerate(zip(names, kinds))})


def average_linkage(profiles: DataFrame, gene: str, values: str, metric: str = "correlation", one_task: int = ONE_TASK) -> DataFrame:
    """(step, left, right, height, size) of agglomerative clustering, in order of height.

    Genes are numbered in order from 0 and the cluster that step s makes is the number of genes plus s.
    Of equally near pairs that with the smallest genes merges first. Up to ``one_task`` clusters merge
    in one task; more go through rounds first.
    """
    spark = profiles.sparkSession
    scratch = Scratch(spark, "clusters")
    clusters = scratch.keep(unit_profiles(profiles, gene, values, metric))
    genes = n = clusters.count()
    merges, turn = None, 0
    while n > one_task:
        near = stash(nearest(clusters, n), "nearest")
        a, b = near.alias("a"), near.alias("b")
        pairs = a.join(b, (F.col("a.other") == F.col("b.root")) & (F.col("b.other") == F.col("a.root"))).where("a.root < b.root").select(F.col("a.root").alias("left"), F.col("b.root").alias("right"), F.col("a.height").alias("height"))
        left, right = clusters.select(F.col("root").alias("left"), F.col("round").alias("left_round"), F.col("size").alias("s1"), F.col("v").alias("v1")), clusters.select(F.col("root").alias("right"), F.col("round").alias("right_round"), F.col("size").alias("s2"), F.col("v").alias("v2"))
        made = stash(pairs.join(left, "left").join(right, "right").select(F.lit(turn).alias("round"), F.col("left").alias("root"), "left_round", "left", "right_round", "right", "height", (F.col("s1") + F.col("s2")).alias("size"), F.zip_with("v1", "v2", lambda x, y: x + y).alias("v")), "merges")
        gone = made.select(F.col("left").alias("root")).unionByName(made.select(F.col("right").alias("root")))
        clusters = scratch.keep(clusters.join(gone, "root", "left_anti").unionByName(made.select("root", "round", "size", "v")))
        merges = made.drop("v") if merges is None else merges.unionByName(made.drop("v"))
        n, turn = clusters.count(), turn + 1
    last = clusters.groupBy(F.lit("all")).applyInArrow(lambda _, t: _finish(t, turn), MERGES)
    merges = last if merges is None else stash(merges.unionByName(last), "merges")
    if turn == 0:  # one task has them in order already
        placed = merges.withColumn("step", F.col("round").cast("long"))
    else:
        placed = numbered(merges, [F.col("height"), F.col("round"), F.col("root")], "step", start=0).withColumn("step", F.col("step").cast("long"))
        placed = stash(placed, "placed")
    key = placed.select(F.col("round").alias("r"), F.col("root").alias("k"), (F.col("step") + genes).alias("id"))
    out = placed
    for side in ("left", "right"):
        named = key.select(F.col("r").alias(f"{side}_round"), F.col("k").alias(side), F.col("id").alias(f"{side}_id"))
        out = out.join(named, [f"{side}_round", side], "left").withColumn(f"{side}_id", F.coalesce(f"{side}_id", side))
    return out.select("step", F.least("left_id", "right_id").alias("left"), F.greatest("left_id", "right_id").alias("right"), "height", "size")


def leaf_order(merges: DataFrame, one_task: int = LEAVES) -> DataFrame:
    """(place, leaf): leaves of a clustering from left to right.

    A left part begins where its merge does, a right part after the left one's leaves. Up to ``one_task``
    merges go from the last one down in one task; for more, each node adds what its ancestors add, twice as many
    of them a round.
    """
    n = merges.count() + 1
    if n - 1 > one_task:
        size = merges.select((F.col("step") + n).alias("node"), "size")
        ends = merges.join(size.toDF("left", "held"), "left", "left").select((F.col("step") + n).alias("up"), "left", "right", F.coalesce("held", F.lit(1)).alias("held"))
        nodes = ends.select(F.explode(F.array(F.struct(F.col("left").alias("node"), F.lit(0).cast("long").alias("add")), F.struct(F.col("right").alias("node"), F.col("held").cast("long").alias("add")))).alias("x"), "up").select("x.node", "up", "x.add")
        root = 2 * n - 2
        scratch = Scratch(merges.sparkSession, "leaves")
        nodes = scratch.keep(nodes)
        while not nodes.where(F.col("up") != root).isEmpty():
            over = nodes.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("add").alias("more"))
            nodes = scratch.keep(nodes.join(over, "up", "left").select("node", F.coalesce("next", "up").alias("up"), (F.col("add") + F.coalesce("more", F.lit(0))).alias("add")))
        return nodes.where(F.col("node") < n).select(F.col("add").alias("place"), F.col("node").alias("leaf"))

    def run(got):
        got = got.sort_by("step")
        left, right, held = (got.column(c).to_pylist() for c in ("left", "right", "size"))
        begins = {n + len(left) - 1: 0} if left else {}
        count = lambda x: 1 if x < n else held[x - n]
        for k in range(len(left) - 1, -1, -1):
            at = begins[n + k]
            begins[left[k]], begins[right[k]] = at, at + count(left[k])
        leaves = sorted((at, x) for x, at in begins.items() if x < n)
        return pa.table({"place": pa.array([a for a, _ in leaves], pa.int64()), "leaf": pa.array([x for _, x in leaves], pa.int64())})

    return merges.select("step", "left", "right", "size").groupBy(F.lit("all")).applyInArrow(lambda _, t: run(t), "place long, leaf long")
