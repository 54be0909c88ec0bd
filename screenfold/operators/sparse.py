"""Ridge regression and ranks on wide sparse designs given in long form, (row, feature, value).

A row's entries are packed once. Tasks turn packed rows into products of column blocks, blocks are summed
over tasks by Spark, and only matrices as wide as the features meet in one place: one factorisation
of a group's Gram matrix serves every penalty. Designs wider than ``WIDE`` are solved by conjugate
gradients, whose products run over the rows where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenfold.operators.scan import numbered
from screenfold.plans.session import shuffle_width, stash

#: Widest design whose Gram matrix is formed, columns of a block, rows of a dense chunk, bytes of the
#: vectors that conjugate gradients hand to every task.
WIDE, BLOCK, CHUNK, MOST_BYTES = 4096, 512, 1024, 256 << 20


def feature_slots(features: DataFrame, feature: str = "feature") -> DataFrame:
    """(feature, slot): features in order, from 0."""
    return numbered(features.select(feature).where(F.col(feature).isNotNull()).distinct(), [F.col(feature)], "slot", start=0)


def packed_rows(rows: DataFrame, features: DataFrame, slots: DataFrame, key: str, value: str, feature: str = "feature") -> DataFrame:
    """``rows`` with the arrays ``at`` and ``x`` of their key's entries by slot; both empty for a key without any.

    Missing and zero values are no entries; of a repeated (key, feature) the values are summed.
    """
    entries = features.where(F.col(value).isNotNull() & (F.col(value) != 0)).join(slots, feature)
    entries = entries.groupBy(key, "slot").agg(F.sum(F.col(value).cast("double")).alias("x"))
    held = entries.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("slot", "x"))).alias("entry"))
    held = held.select(key, F.col("entry.slot").alias("at"), F.col("entry.x").alias("x"))
    none = lambda c, t: F.coalesce(F.col(c), F.array().cast(f"array<{t}>")).alias(c)
    return rows.join(held, key, "left").select(*rows.columns, none("at", "int"), none("x", "double"))


def _chunks(batches, width: int) -> Iterator[tuple]:
    """(group, rows as a dense matrix, y) of at most ``CHUNK`` rows of one group, from batches sorted by group."""
    for b in batches:
        groups = b.column("by").to_pylist()
        y = b.column("y").to_numpy(zero_copy_only=False)
        at, x = b.column("at"), b.column("x")
        begin = 0
        while begin < len(groups):
            end = begin + 1
            while end < len(groups) and end - begin < CHUNK and groups[end] == groups[begin]:
                end += 1
            part = at.slice(begin, end - begin)
            held = part.value_lengths().to_numpy(zero_copy_only=False)
            dense = np.zeros((end - begin, width))
            dense[np.repeat(np.arange(end - begin), held), part.flatten().to_numpy(zero_copy_only=False)] = x.slice(begin, end - begin).flatten().to_numpy(zero_copy_only=False)
            yield groups[begin], dense, y[begin:end]
            begin = end


def gram_blocks(rows: DataFrame, width: int) -> DataFrame:
    """(by, i, j, n, sy, block): sums over the rows of each group of the products of column blocks i <= j.

    ``rows`` is (by, y, at, x). Columns are those of the design, then one of ones and y, so that counts,
    sums and right-hand sides come with the Gram matrix.
    """
    kind = rows.schema["by"].dataType.simpleString()
    side = BLOCK
    blocks = -(-(width + 2) // side)
    out = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("block", pa.binary())])

    def products(batches):
        held, group, any_row, sample = {}, None, False, None

        def flush():
            keys = list(held)
            by = pa.array([group] * len(keys), type=sample)
            return pa.RecordBatch.from_arrays([by, *(pa.array([k[d] for k in keys], pa.int32()) for d in (0, 1)), pa.array([held[k].tobytes() for k in keys], pa.binary())], ["by", *out.names])

        def stream():
            nonlocal sample
            for b in batches:
                sample = b.schema.field("by").type
                yield b

        for by, dense, y in _chunks(stream(), width):
            if any_row and by != group:
                yield flush()
                held = {}
            group, any_row = by, True
            full = np.concatenate([dense, np.ones((len(y), 1)), y[:, None]], 1)
            used = [b for b in range(blocks) if full[:, b * side : (b + 1) * side].any()]
            for i in used:
                left = full[:, i * side : (i + 1) * side].T
                for j in used:
                    if i <= j:
                        add = left @ full[:, j * side : (j + 1) * side]
                        held[i, j] = held[i, j] + add if (i, j) in held else add
        if any_row:
            yield flush()

    def total(table):
        parts = [np.frombuffer(p, np.float64) for p in table.column("block").to_pylist()]
        return table.slice(0, 1).set_column(3, "block", pa.array([np.sum(parts, axis=0).tobytes()], pa.binary()))

    salted = rows.repartition(shuffle_width(rows.sparkSession)).sortWithinPartitions("by")
    shape = f"by {kind}, i int, j int, block binary"
    return salted.mapInArrow(products, shape).groupBy("by", "i", "j").applyInArrow(total, shape)


def _whole(table: pa.Table, width: int, side: int) -> np.ndarray:
    """The symmetric matrix that a group's blocks make up."""
    m = np.zeros((width + 2,) * 2)
    for i, j, raw in zip(*(table.column(c).to_pylist() for c in ("i", "j", "block"))):
        a, b = slice(i * side, min(width + 2, (i + 1) * side)), slice(j * side, min(width + 2, (j + 1) * side))
        m[a, b] = np.frombuffer(raw).reshape(a.stop - a.start, -1)
        m[b, a] = m[a, b].T
    return m


def solve_all(gram: np.ndarray, right: np.ndarray, alphas: list[float]) -> list[np.ndarray]:
    """Weights for each penalty from one factorisation of the centred Gram matrix."""
    values, vectors = np.linalg.eigh(gram)
    turned = vectors.T @ right
    return [vectors @ (turned / (np.maximum(values, 0) + a)) for a in alphas]


def sparse_ridge(train: DataFrame, features: DataFrame, by: str, key: str, y: str, value: str, alphas: list[float], feature: str = "feature", wide: int = WIDE) -> DataFrame:
    """(by, alpha, feature, weight) with the intercept, which is not penalised, as feature null.

    ``train`` is (by, key, y) and ``features`` (key, feature, value) in long form; all features get a
    weight for every group, 0 where no row of the group has them. Rows without y take no part; repeated
    rows count as often as they are there. Up to ``wide`` features a group's Gram matrix meets in a
    task; beyond that all groups and penalties are solved together by conjugate gradients.
    """
    slots = stash(feature_slots(features, feature), "slots")
    width = slots.count()
    rows = train.where(F.col(y).isNotNull()).select(F.col(by).alias("by"), F.col(key), F.col(y).cast("double").alias("y"))
    rows = stash(packed_rows(rows, features, slots, key, value, feature).select("by", "y", "at", "x"), "packed")
    kind = rows.schema["by"].dataType.simpleString()
    shape = f"by {kind}, alpha double, intercept double, weights array<double>"
    if width <= wide:
        side = BLOCK

        def solve(table):
            m = _whole(table, width, side)
            n, s, sy = m[width, width], m[width, :width], m[width, width + 1]
            found = solve_all(m[:width, :width] - np.outer(s, s) / n, m[:width, width + 1] - s * sy / n, alphas)
            by_ = pa.array([table.column("by")[0].as_py()] * len(alphas), table.schema.field("by").type)
            return pa.table([by_, pa.array(alphas, pa.float64()), pa.array([float(sy / n - w @ s / n) for w in found]), pa.array(found, pa.list_(pa.float64()))], ["by", "alpha", "intercept", "weights"])

        models = gram_blocks(rows, width).groupBy("by").applyInArrow(solve, shape)
    else:
        models = train.sparkSession.createDataFrame(conjugate_gradients(rows, width, alphas), shape)
    weights = models.select("by", "alpha", F.posexplode("weights").alias("slot", "weight")).join(slots, "slot").select("by", "alpha", feature, "weight")
    cut = models.select("by", "alpha", F.lit(None).cast(slots.schema[feature].dataType).alias(feature), F.col("intercept").alias("weight"))
    return weights.unionByName(cut).withColumnRenamed("by", by)


def conjugate_gradients(rows: DataFrame, width: int, alphas: list[float], tolerance: float = 1e-10, most: int = 500) -> list[tuple]:
    """(by, alpha, intercept, weights) of every group and penalty.

    One pass over the rows a step multiplies the search directions of all of them. What goes to every
    task is groups x penalties x features numbers; more than ``MOST_BYTES`` of them are refused.
    """
    sums = rows.groupBy("by").agg(F.count("*").alias("n"), F.avg("y").alias("my")).collect()  # one row a group
    names = [r["by"] for r in sums]
    n, my = np.array([r["n"] for r in sums], float), np.array([r["my"] for r in sums])
    place = {g: k for k, g in enumerate(names)}
    if len(names) * len(alphas) * width * 8 > MOST_BYTES:
        raise ValueError("groups x penalties x features are too many for conjugate gradients")

    def over(multiply) -> np.ndarray:
        """[group, features, columns]: sums over rows of x times ``multiply(group, x, y)``."""

        def run(batches):
            held: dict = {}
            for by, dense, y in _chunks(batches, width):
                add = dense.T @ multiply(place[by], dense, y)
                held[place[by]] = held.get(place[by], 0) + add
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.ascontiguousarray(v).tobytes() for v in held.values()], pa.binary())], ["g", "v"])

        def total(table):
            v = np.sum([np.frombuffer(x) for x in table.column("v").to_pylist()], axis=0)
            return pa.table([table.column("g").slice(0, 1), pa.array([v.tobytes()], pa.binary())], ["g", "v"])

        got = rows.sortWithinPartitions("by").mapInArrow(run, "g int, v binary").groupBy("g").applyInArrow(total, "g int, v binary").collect()  # the vectors
        out = [np.zeros((width, 1))] * len(names)
        for r in got:
            out[r["g"]] = np.frombuffer(r["v"]).reshape(width, -1)
        return np.stack([np.broadcast_to(o, (width, max(x.shape[1] for x in out))) for o in out])

    first = over(lambda g, x, y: np.stack([np.ones(len(y)), y - my[g]], 1))
    mean, right = first[:, :, 0] / n[:, None], first[:, :, 1]  # [group, feature]
    penalty = np.array(alphas)[None, None]
    w = np.zeros((len(names), width, len(alphas)))
    r = np.repeat(right[:, :, None], len(alphas), 2)
    p, size = r.copy(), (r * r).sum(1)
    goal = tolerance**2 * np.maximum(size, 1e-300)
    for _ in range(most):
        if (size <= goal).all():
            break
        moved = p - 0.0
        shift = np.einsum("gf,gfa->ga", mean, moved)  # rows are centred without being made dense
        product = over(lambda g, x, y: x @ moved[g] - shift[g]) + penalty * moved  # centring the left side adds nothing: what it meets sums to zero
        step = np.where(size > goal, size / np.maximum((moved * product).sum(1), 1e-300), 0)
        w += step[:, None] * moved
        r -= step[:, None] * product
        fresh = (r * r).sum(1)
        p = r + (fresh / np.maximum(size, 1e-300))[:, None] * p
        size = fresh
    return [(names[g], float(a), float(my[g] - mean[g] @ w[g, :, k]), w[g, :, k].tolist()) for g in range(len(names)) for k, a in enumerate(alphas)]


def sparse_predictions(rows: DataFrame, models: DataFrame, features: DataFrame, by: str, key: str, value: str, feature: str = "feature") -> DataFrame:
    """``rows`` with each penalty's (alpha, p): a join of entries with weights and one sum a row.

    Keys without entries, or with unseen features only, get the intercept.
    """
    cut = models.where(F.col(feature).isNull()).select(by, "alpha", F.col("weight").alias("cut"))
    entries = features.where(F.col(value).isNotNull() & (F.col(value) != 0)).select(key, feature, F.col(value).cast("double").alias("x"))
    keys = rows.select(by, key).distinct()
    part = keys.join(entries, key).join(models, [by, feature]).groupBy(by, key, "alpha").agg(F.sum(F.col("x") * F.col("weight")).alias("part"))
    got = rows.join(cut, by).join(part, [by, key, "alpha"], "left")
    return got.withColumn("p", F.col("cut") + F.coalesce("part", F.lit(0.0))).drop("cut", "part")


# ---------------------------------------------------------------------------------------------------


def _triangle(m: np.ndarray) -> np.ndarray:
    return np.linalg.qr(m, mode="r") if len(m) > m.shape[1] else m


def staircase(r: np.ndarray, tolerance: float) -> tuple[int, list[int]]:
    """Rank of an upper triangle, and the columns that depend on those before them.

    The triangle is brought to a staircase: a column is dependent if what it has below the steps so far
    is nothing beside its own length, so of equal columns the first stays; else a reflection of the few
    rows that it reaches makes it the next step.
    """
    left = r.copy()
    length = np.sqrt((r * r).sum(0))
    step, dependent = 0, []
    for c in range(r.shape[1]):
        rows = slice(step, min(c + 1, len(left)))
        own = left[rows, c].copy()
        norm = np.sqrt((own * own).sum())
        if norm <= tolerance * length[c]:
            dependent.append(c)
            continue
        if len(own) > 1:
            own[0] += np.copysign(norm, own[0])
            left[rows, c:] -= np.outer(own, 2 / (own @ own) * (own @ left[rows, c:]))
        step += 1
    return step, dependent


def design_rank(features: DataFrame, key: str, value: str | None = None, feature: str = "feature", fan: int = 8, tolerance: float = 1e-9) -> tuple[int, int, DataFrame]:
    """(width, rank, dependent features) of a design in long form, by a tree of QR factorisations.

    Tasks factor their own rows, triangles of ``fan`` tasks are stacked and factored, and so on until
    one is left: each is at most features x features, whatever the rows. Columns come in order of
    their names; the dependent ones follow from those before them.
    """
    spark = features.sparkSession
    entries = features.withColumn("v", F.col(value).cast("double") if value else F.lit(1.0))
    slots = stash(feature_slots(entries, feature), "slots")
    width = slots.count()
    if not width:
        return 0, 0, slots.select(feature)
    rows = packed_rows(entries.select(key).distinct(), entries, slots, key, "v", feature).select(F.lit(0).alias("by"), F.lit(0.0).alias("y"), "at", "x")
    tasks = shuffle_width(spark)

    def factor(batches):
        r = np.zeros((0, width))
        for _, dense, _ in _chunks(batches, width):
            r = _triangle(np.concatenate([r, dense]))
        if len(r):
            from pyspark import TaskContext

            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["node", "r"])

    def join(table):
        stacked = np.concatenate([np.frombuffer(x).reshape(-1, width) for x in table.column("r").to_pylist()])
        return pa.table([pa.array([table.column("node")[0].as_py()], pa.int64()), pa.array([_triangle(stacked).tobytes()], pa.binary())], ["node", "r"])

    level = rows.repartition(tasks).mapInArrow(factor, "node long, r binary")
    while tasks > 1:
        tasks = -(-tasks // fan)
        level = level.withColumn("node", F.floor(F.col("node") / fan).cast("long")).groupBy("node").applyInArrow(join, "node long, r binary")
    top = level.collect()  # one triangle
    if not top:
        return width, 0, slots.select(feature)
    rank, dependent = staircase(np.linalg.qr(np.frombuffer(top[0]["r"]).reshape(-1, width), mode="r"), tolerance)
    return width, rank, slots.where(F.col("slot").isin(dependent)).select(feature)
