"""Graph operators over edge tables.

Edges are rows, never a matrix: nothing here grows with the square of the nodes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenfold.plans.session import Scratch, stash

#: Edges that a task unites at a time before anything is shuffled, and rows of a block of nodes.
CHUNK, BLOCK_ROWS, LEAST_BLOCKS = 500_000, 250_000, 8
#: Rows between blocks: what a node is known to be linked with, the part it has, a block's question for
#: a node's part, and the answer.
LINK, PART, ASK, ANSWER = 0, 1, 2, 3


def unite(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (u, v), ascending, and the smallest node that edges connect each with."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    up = np.arange(len(nodes))
    a, b = at[: len(u)], at[len(u) :]
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[up]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up != up[up]).any():
            up = up[up]


def _mix(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _local_links(edges: DataFrame) -> DataFrame:
    """(u, v): each node of a chunk of edges with the smallest that the chunk connects it with."""

    def run(batches):
        held, n = [], 0

        def flush():
            u, v = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in unite(u, v)], ["u", "v"])

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
            if n >= CHUNK:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return edges.mapInArrow(run, "u long, v long")


def _step(blocks: int):
    """One exchange: a block of nodes unites what it was told and tells other blocks."""

    def home(ids):
        return (_mix(ids) % np.uint64(blocks)).astype(np.int32)

    def run(key, rows):
        own = key[0].as_py()
        kind, u, v = (rows.column(c).to_numpy() for c in ("kind", "u", "v"))
        asks = kind == ASK
        nodes, low = unite(u[~asks], v[~asks])
        at = home(nodes)
        mine, moved = at == own, nodes != low
        # another block's node that lost its place here; what an answer said, its block knows
        told = kind == ANSWER
        news = ~mine & moved
        news[news] = ~np.isin(nodes[news], u[told]) | (low[news] < _best(nodes[news], u[told], v[told]))
        roots = np.unique(low[mine])
        far = roots[home(roots) != own]
        asked, by = u[asks], v[asks]
        reply = low[np.searchsorted(nodes, asked)] if len(asked) else asked
        go = reply != asked
        parts = [
            (np.full(mine.sum(), own), PART, nodes[mine], low[mine]),
            (at[news], LINK, nodes[news], low[news]),
            (home(far), ASK, far, np.full(len(far), own)),
            (by[go], ANSWER, asked[go], reply[go]),
        ]
        whole = [np.concatenate([np.full(len(p[2]), p[1]) if i == 1 else p[i] for p in parts]) for i in range(4)]
        return pa.table({"block": pa.array(whole[0].astype(np.int32)), "kind": pa.array(whole[1].astype(np.int8)), "u": pa.array(whole[2].astype(np.int64)), "v": pa.array(whole[3].astype(np.int64))})

    return run


def _best(nodes: np.ndarray, told: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The smallest answer for each node; a large number where there is none."""
    out = np.full(len(nodes), np.iinfo(np.int64).max)
    at = np.searchsorted(nodes, told)
    fits = (at < len(nodes)) & (nodes[np.minimum(at, max(len(nodes) - 1, 0))] == told) if len(nodes) else np.zeros(len(told), bool)
    np.minimum.at(out, at[fits], of[fits])
    return out


def _whole_number_components(links: DataFrame, max_rounds: int) -> DataFrame:
    spark = links.sparkSession
    scratch = Scratch(spark, "components")
    first = scratch.keep(_local_links(links))
    blocks = max(LEAST_BLOCKS, -(-first.count() // BLOCK_ROWS))
    step = _step(blocks)

    def homes(batches):
        for b in batches:
            u = b.column(0).to_numpy()
            at = (_mix(u) % np.uint64(blocks)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(u), LINK, np.int8)), b.column(0), b.column(1)], ["block", "kind", "u", "v"])

    shape = "block int, kind byte, u long, v long"
    now, quiet = first.mapInArrow(homes, shape), False
    for _ in range(max_rounds):
        now = scratch.keep(now.groupBy("block").applyInArrow(step, shape))
        scratch.forget()
        still = now.where(F.col("kind").isin(LINK, ANSWER)).isEmpty()
        if still and quiet:
            return now.where(F.col("kind") == PART).select(F.col("u").alias("id"), F.col("v").alias("component"))
        quiet = still
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(id, component) for every node of ``edges``; component is the smallest id reachable.

    Tasks first unite the edges they read, so that a hub of any degree leaves one row a node. Nodes
    then live in blocks by a hash. In each round a block unites the links it was told of, tells the
    blocks of nodes that lost their place, and asks for each distinct part of its nodes once, so a node
    gets at most two rows from a block. Rounds are logarithmic in the diameter; each is one shuffle and
    one table below the checkpoint folder, and removes the table before it. Edges with a null end
    are left out, self loops only name their node, ties and repeats do not matter. An empty table gives
    an empty table. Ids that are no whole numbers are numbered in their order first.
    """
    raw = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    kind = raw.schema["a"].dataType
    if kind.typeName() in ("byte", "short", "integer", "long"):
        got = _whole_number_components(raw.select(F.col("a").cast("long"), F.col("b").cast("long")), max_rounds)
        return got.select(F.col("id").cast(kind), F.col("component").cast(kind))
    raw = stash(raw, "edges")
    ids = raw.select(F.col("a").alias("id")).unionAll(raw.select("b")).distinct().orderBy("id")
    ids = stash(ids.withColumn("n", F.monotonically_increasing_id()), "ids")
    numbers = raw.join(ids.toDF("a", "na"), "a").join(ids.toDF("b", "nb"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    got = _whole_number_components(numbers, max_rounds)
    return got.join(ids.toDF("_id", "id"), "id").join(ids.toDF("_low", "component"), "component").select(F.col("_id").alias("id"), F.col("_low").alias("component"))
