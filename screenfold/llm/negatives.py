"""Op 13: hard negatives by a secondary-sort shuffle.

Anchors, a stated part of the rows, are scored against all rows block by block as matrix products. A task
keeps of its pairs only what can be part of the result: the best of the anchor's own label, which are its
candidates for positives, and, once the positives are known, for each positive's window the best of other
labels inside it. Their scores are packed into keys of (anchor, descending score, id), dealt out by anchor
and sorted inside the partitions, and an iterator over the sorted pairs opens a window at each positive
and emits the negatives that fall into it. It holds an anchor's open windows and no pair.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from screenfold.llm.common import finite_vectors, matrix, scaled_floor
from screenfold.plans.session import Scratch, shuffle_width

#: Components become floor(SCALE * x). Rows and anchors of a block, its bytes, and cells of a product held at a time.
SCALE, ROWS, ANCHORS, BLOCK_BYTES, CELLS = 256, 4096, 1024, 4 << 20, 2_000_000
#: Scores beyond these bounds, and ids, are kept as 64-bit numbers that sort as bytes do.
TOP = (1 << 63) - 1


@dataclass(frozen=True)
class Mining:
    """How many positives an anchor has and negatives a positive, and the window: negatives score from
    ``low`` to ``high`` per cent of the positive."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95

    def window(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of a negative; for a score below zero the least is above the largest."""
        return -((-self.low * score) // 100), (self.high * score) // 100

    def holds(self, positive: int, negative: int) -> bool:
        return self.low * positive <= 100 * negative <= self.high * positive


PACKED = "n int, kind string, id binary, label binary, at binary, asks binary, x binary"
FIELDS = [("n", pa.int32()), ("kind", pa.string()), *((f, pa.binary()) for f in ("id", "label", "at", "asks", "x"))]


class Block:
    """Rows of one task as arrays, by ascending id. ``at`` is a row's own number, whatever its id;
    ``asks`` tells the anchors."""

    NUMBERS = ("id", "label", "at", "asks")

    def __init__(self, ids: np.ndarray, labels: np.ndarray, at: np.ndarray, x: np.ndarray, asks: np.ndarray):
        order = np.lexsort((at, ids))
        self.id, self.label, self.at, self.x, self.asks = ids[order], labels[order], at[order], x[order], asks[order]

    def pack(self) -> dict:
        most = max(abs(int(self.x.max(initial=0))), abs(int(self.x.min(initial=0))))
        kind = next(k for k in ("<i2", "<i4", "<i8") if most <= np.iinfo(k).max)
        return {f: getattr(self, f).astype("<i8").tobytes() for f in self.NUMBERS} | {"kind": kind, "x": self.x.astype(kind).tobytes(), "n": len(self.id)}

    @classmethod
    def unpack(cls, row: dict) -> Block:
        out = cls.__new__(cls)
        for f in cls.NUMBERS:
            setattr(out, f, np.frombuffer(row[f], "<i8"))
        out.x = np.frombuffer(row["x"], row["kind"]).reshape(row["n"], -1)
        return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows as whole numbers: exact, but those beyond 2^62 count as that."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(a.shape[1], 1)
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return np.clip(a.astype(object) @ b.astype(object).T, -(1 << 62), 1 << 62).astype(np.int64)


def best_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each group, by falling score and then rising id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    first = np.searchsorted(g, g)
    return order[np.arange(len(g)) - first < most]


def _parts(anchors: Block, rows: Block, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors, rows, scores) of the pairs of one label or of different ones, so many at a time."""
    for label in np.unique(anchors.label):
        own = np.flatnonzero(anchors.label == label)
        others = np.flatnonzero(rows.label == label if same else rows.label != label)
        step = max(1, CELLS // max(1, len(others)))
        for k in range(0, len(own) if len(others) else 0, step):
            yield own[k : k + step], others, products(anchors.x[own[k : k + step]], rows.x[others])


def block_positives(anchors: Block, rows: Block, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the first ``most`` rows of each anchor's own label, itself left out."""
    out = []
    for own, others, s in _parts(anchors, rows, True):
        itself = anchors.at[own][:, None] == rows.at[others][None, :]
        width = min(most + 1, s.shape[1])  # one more, as the anchor may be among them
        least = -np.partition(-s, width - 1, axis=1)[:, width - 1]
        a, r = np.nonzero((s >= least[:, None]) & ~itself)
        keep = best_each(a, s[a, r], others[r], most)
        out.append((own[a[keep]], others[r[keep]], s[a[keep], r[keep]]))
    return tuple(np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3))


def block_negatives(anchors: Block, rows: Block, scores: np.ndarray, rule: Mining) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the first rows of other labels in the window of each positive.

    ``scores`` has the positives' scores of each anchor, below zero where it has fewer.
    """
    low, high = rule.window(scores)
    none = scores < 0
    least = np.where(none, TOP, low).min(1, initial=TOP)
    largest = np.where(none, -1, high).max(1, initial=-1)
    out = []
    for own, others, s in _parts(anchors, rows, False):
        a, r = np.nonzero((s >= least[own][:, None]) & (s <= largest[own][:, None]))
        score = s[a, r]
        del s
        for k in range(scores.shape[1]):
            inside = np.flatnonzero((score >= low[own[a], k]) & (score <= high[own[a], k]) & ~none[own[a], k])
            keep = inside[best_each(a[inside], score[inside], others[r[inside]], rule.negatives)]
            out.append(np.stack([own[a[keep]], others[r[keep]], score[keep]]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.unique(np.concatenate(out, 1), axis=1))


def _sortable(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8")


def keys(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """(anchor, descending score, id) of pairs as 24 bytes that sort in this order."""
    raw = np.stack([_sortable(anchor), ~_sortable(score), _sortable(ids)], 1).astype(">u8").tobytes()
    return [raw[k : k + 24] for k in range(0, len(raw), 24)]


def unpack_key(key: bytes) -> tuple[int, int, int]:
    a, s, i = struct.unpack(">QQQ", key)
    return a - (1 << 63), (1 << 63) - 1 - s, i - (1 << 63)


def stream(pairs: Iterable[tuple[bytes, tuple[bool, int]]], rule: Mining) -> Iterator[tuple]:
    """(anchor id, positive, rank, negative, scores) from sorted pairs (key, (is it a positive, anchor's id)).

    A negative scores less than its positive and so comes after it, but for a score of zero, where a
    smaller id may come first: so the first negatives of score zero are held.
    """
    current, windows, zeros = None, [], []
    for key, (positive, anchor_id) in pairs:
        anchor, score, vec = unpack_key(key)
        if anchor != current:
            current, windows, zeros = anchor, [], []
        if positive:
            if len(windows) < rule.positives:
                early = zeros if score == 0 else []
                for rank, z in enumerate(early, 1):
                    yield anchor_id, vec, rank, z, 0, 0
                windows.append([vec, score, len(early)])
            continue
        if score == 0 and len(zeros) < rule.negatives:
            zeros.append(vec)
        for w in windows:
            if w[2] < rule.negatives and rule.holds(w[1], score):
                w[2] += 1
                yield anchor_id, w[0], w[2], vec, w[1], score


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(df: DataFrame, anchors: str = "vec_id % 50 = 0", label: str = "label", rule: Mining = Mining(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Hard negatives of the rows that fulfil ``anchors``, an SQL condition; ``label`` is an SQL expression.

    Returns (anchor_id, positive_id, rank, negative_id, positive_score, negative_score). Rows with a
    null id or label, or a vector that is null or not finite, take no part. A row is another row than
    its repeats: rows of one id are ranked one after the other, each is an anchor of its own, and a repeat can be
    an anchor's positive. Shorter vectors end in zeros. Ids and labels are whole numbers; components
    beyond 2^62 and scores beyond it count as that. Clashing columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = finite_vectors(df, vec_col, F.col(id_col).cast("long").alias("id"), F.expr(label).cast("long").alias("label"), F.coalesce(F.expr(anchors), F.lit(False)).alias("asks"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL")
    found = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("vector"))).first()
    n, asking, width = found[0], found[1], found[2] or 0
    if not asking:
        return spark.createDataFrame([], RESULT)
    per_block = max(64, min(ROWS, BLOCK_BYTES // (2 * max(width, 1))))
    groups, parts = -(-n // per_block), -(-asking // min(ANCHORS, per_block))

    def pack_rows(batches):
        number, held, have = TaskContext.get().partitionId(), [], 0
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                x = scaled_floor(matrix(part.column("vector"), width), SCALE)
                at = (number << 33) + have + np.arange(len(x))
                held.append((part.column("id").to_numpy(), part.column("label").to_numpy(), at, x, part.column("asks").to_numpy(zero_copy_only=False)))
                have += len(x)
        if held:
            block = Block(*(np.concatenate([h[i] for h in held]) for i in range(5)))
            yield pa.RecordBatch.from_pylist([block.pack() | {"block": number}], pa.schema([("block", pa.int32()), *FIELDS]))

    blocks = scratch.keep(rows.repartition(groups).mapInArrow(pack_rows, f"block int, {PACKED}"))

    def spread_anchors(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                block = Block.unpack(row)
                chosen = np.flatnonzero(block.asks)
                part = (row["block"] + np.arange(len(chosen))) % parts
                x = pa.array(list(block.x[chosen].astype(np.int64)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block.id[chosen]), pa.array(block.label[chosen]), pa.array(block.at[chosen]), x], ["part", "id", "label", "at", "x"])

    with_part = pa.schema([("part", pa.int32()), *FIELDS])

    def pack_anchors(table):
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(table.num_rows, width)
        block = Block(*(table.column(c).to_numpy() for c in ("id", "label", "at")), x, np.ones(len(x), bool))
        return pa.Table.from_pylist([block.pack() | {"part": table.column("part")[0].as_py()}], with_part)

    asked = blocks.mapInArrow(spread_anchors, "part int, id long, label long, at long, x array<long>").groupBy("part").applyInArrow(pack_anchors, f"part int, {PACKED}")
    asked = scratch.keep(asked)

    def each_pair(anchors_of: DataFrame, f, shape: str) -> DataFrame:
        """``f`` on each block of anchors with each block of rows: an equi-join of numbered blocks, one pair a group."""
        left = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        right = anchors_of.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        left = left.repartition(max(1, min(groups * parts, 8 * shuffle_width(spark))), "block", "part")
        return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(f, shape)

    found_pairs = pa.schema([("part", pa.int32()), *((c, pa.int64()) for c in ("anchor", "anchor_id", "score", "id", "at"))])

    def positives(left, right):
        if not left.num_rows or not right.num_rows:
            return found_pairs.empty_table()
        r, row = Block.unpack(left.to_pylist()[0]), right.to_pylist()[0]
        a = Block.unpack(row)
        i, j, score = block_positives(a, r, rule.positives)
        return pa.table([np.full(len(i), row["part"], np.int32), a.at[i], a.id[i], score, r.id[j], r.at[j]], schema=found_pairs)

    best = each_pair(asked, positives, "part int, anchor long, anchor_id long, score long, id long, at long")
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "at")
    best = scratch.keep(best.withColumn("k", F.row_number().over(first)).where(F.col("k") <= rule.positives))

    def with_scores(table, got):
        row = table.to_pylist()[0]
        block = Block.unpack(row)
        scores = np.full((row["n"], rule.positives), -1, np.int64)
        order = np.argsort(block.at)
        if got.num_rows:
            place = order[np.searchsorted(block.at[order], got.column("anchor").to_numpy())]
            scores[place, got.column("k").to_numpy() - 1] = got.column("score").to_numpy()
        return pa.Table.from_pylist([row | {"scores": scores.astype("<i8").tobytes()}], with_part.append(pa.field("scores", pa.binary())))

    known = best.select("part", "anchor", "k", "score")
    scored = scratch.keep(asked.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(with_scores, f"part int, {PACKED}, scores binary"))
    packed_pairs = pa.schema([("key", pa.binary()), ("positive", pa.bool_()), ("anchor_id", pa.int64())])

    def negatives(left, right):
        if not left.num_rows or not right.num_rows:
            return packed_pairs.empty_table()
        r, row = Block.unpack(left.to_pylist()[0]), right.to_pylist()[0]
        a, scores = Block.unpack(row), np.frombuffer(row["scores"], "<i8").reshape(-1, rule.positives)
        i, j, score = block_negatives(a, r, scores, rule)
        return pa.table([pa.array(keys(a.at[i], score, r.id[j]), pa.binary()), np.zeros(len(i), bool), a.id[i]], schema=packed_pairs)

    def keyed(batches):
        for b in batches:
            c = {n: b.column(n).to_numpy() for n in ("anchor", "score", "id")}
            yield pa.RecordBatch.from_arrays([pa.array(keys(c["anchor"], c["score"], c["id"]), pa.binary()), pa.array(np.ones(b.num_rows, bool)), b.column("anchor_id")], schema=packed_pairs)

    shape = "key binary, positive boolean, anchor_id long"
    pairs = best.mapInArrow(keyed, shape).unionAll(each_pair(scored, negatives, shape))

    def pair(row: Row) -> tuple[bytes, tuple[bool, int]]:
        return bytes(row[0]), (row[1], row[2])

    def place(key: bytes) -> int:
        return int.from_bytes(key[:8], "big") * 0x9E3779B97F4A7C15 % (1 << 64) >> 32

    sorted_pairs = pairs.rdd.map(pair).repartitionAndSortWithinPartitions(shuffle_width(spark), place)
    return spark.createDataFrame(sorted_pairs.mapPartitions(lambda it: stream(it, rule)), RESULT, verifySchema=False)


#: DuckDB SQL of the registered query.
SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM pairs WHERE same) WHERE k <= 5),
w AS (SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
  FROM p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 3
"""
