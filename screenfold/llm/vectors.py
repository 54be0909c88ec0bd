"""Op 6: near-duplicate vectors by navigable small-world graphs, one a shard.

Each shard's vectors form a hierarchical graph. Two shards meet in one task, and every vector of either
is searched for in the other's graph, with beams that widen until an audit against the whole matrix
finds no link missed. Candidates are verified by cosine in double precision. Tasks give out only how many
links a vector has and the part it lies in, never the links, so a large group of near copies leaves one
row a vector and task; the parts are united into components.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenfold.operators.graph import connected_components, unite
from screenfold.plans.session import stash

DEGREE, BUILD_BEAM, FIRST_BEAM, LEVEL_RATE = 12, 32, 24, 16
#: Cells of a matrix product that a task holds at a time, and edges that it holds before it unites them.
CELLS, HELD_EDGES = 8_000_000, 2_000_000
#: Places in the beams of queries that are searched for in step, so that what they look at stays in a core's cache.
IN_STEP = 24_000


def search(vectors: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of many queries; (ids, similarities) of each beam, best first, -1 for none."""
    parts = np.array_split(np.arange(len(queries)), len(queries) * beam // IN_STEP + 1)
    got = [_in_step(vectors, neighbours, queries[p], entry[p], beam) for p in parts]
    return np.concatenate([ids for ids, _ in got]), np.concatenate([sim for _, sim in got])


def _in_step(vectors: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Every step opens each query's best unopened candidate and merges its neighbours into the beam.

    A query ends when its beam holds nothing unopened.
    """
    n = len(queries)
    ids = np.full((n, beam), -1, dtype=np.int32)
    sim = np.full((n, beam), -np.inf, dtype=np.float32)
    opened = np.zeros((n, beam), dtype=bool)
    ids[:, 0] = entry
    sim[:, 0] = np.einsum("ij,ij->i", queries, vectors[entry])
    live = np.arange(n)
    while len(live):
        waiting = np.where(opened[live] | (ids[live] < 0), -np.inf, sim[live])
        best = waiting.argmax(1)
        go = waiting[np.arange(len(live)), best] > -np.inf
        live, best = live[go], best[go]
        if not len(live):
            break
        opened[live, best] = True
        near = neighbours[ids[live, best]]
        held = ids[live]
        fresh = ~(near[:, :, None] == held[:, None, :]).any(2) & (near >= 0)
        r, c = np.nonzero(fresh)
        score = np.full(near.shape, -np.inf, dtype=np.float32)
        score[r, c] = np.einsum("ij,ij->i", vectors[near[r, c]], queries[live[r]])
        # only a query whose beam takes something in has to be sorted anew
        gain = score.max(1) > sim[live, -1]
        live_gain, score = live[gain], score[gain]
        all_sim = np.concatenate([sim[live_gain], score], 1)
        all_ids = np.concatenate([held[gain], np.where(fresh[gain], near[gain], -1)], 1)
        all_open = np.concatenate([opened[live_gain], np.zeros(score.shape, dtype=bool)], 1)
        order = np.argsort(-all_sim, axis=1, kind="stable")[:, :beam]
        sim[live_gain], ids[live_gain], opened[live_gain] = np.take_along_axis(all_sim, order, 1), np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_open, order, 1)
    return ids, sim


def diverse(vectors: np.ndarray, ids: np.ndarray, sim: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates, best first, those that are closer to the row than to any one taken."""
    rows, width = ids.shape
    out = np.full((rows, degree), -1, dtype=np.int64)
    for r in range(rows):
        taken: list[int] = []
        spare: list[int] = []
        own = ids[r][ids[r] >= 0]
        among = vectors[own] @ vectors[own].T
        for k in range(len(own)):
            if len(taken) == degree:
                break
            (taken if not taken or among[k, taken].max() < sim[r, k] else spare).append(k)
        taken += spare[: degree - len(taken)]
        out[r, : len(taken)] = own[taken]
    return out


class Graph:
    """A hierarchical small-world graph over unit vectors.

    The layer of a vector is drawn by position, one in ``LEVEL_RATE`` of a layer going up. Vectors are
    inserted in batches that double, so each is searched among at least half of those before it.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = np.ascontiguousarray(vectors, dtype=np.float32)
        n = len(vectors)
        rng = np.random.default_rng(3)
        level = np.floor(-np.log(rng.random(n) + 1e-12) / np.log(LEVEL_RATE)).astype(int)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(int(level.max(initial=0)), -1, -1):
            members = np.flatnonzero(level >= at)
            if len(members):
                self.layers.append((members, self._build(members)))

    def _build(self, members: np.ndarray) -> np.ndarray:
        v, n, degree = self.vectors[members], len(members), 2 * DEGREE
        near = np.full((n, degree), -1, dtype=np.int32)
        done = 1
        while done < n:
            new = np.arange(done, min(n, 2 * done, done + 2000))
            if done <= 256:
                s = v[new] @ v[:done].T
                ids = np.argsort(-s, axis=1, kind="stable")[:, :BUILD_BEAM]
                sim = np.take_along_axis(s, ids, 1)
            else:
                ids, sim = search(v, near, v[new], np.zeros(len(new), dtype=np.int64), BUILD_BEAM)
            # vectors of one batch may be each other's nearest
            own = v[new] @ v[new].T
            np.fill_diagonal(own, -np.inf)
            mates = np.argsort(-own, axis=1, kind="stable")[:, :DEGREE]
            ids = np.concatenate([ids, new[mates]], 1)
            sim = np.concatenate([sim, np.take_along_axis(own, mates, 1)], 1)
            order = np.argsort(-sim, axis=1, kind="stable")
            ids, sim = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)
            near[new, :DEGREE] = diverse(v, ids, sim, DEGREE)
            back: dict[int, list[int]] = {}
            for a in new:
                for b in near[a, :DEGREE]:
                    if b >= 0:
                        back.setdefault(int(b), []).append(int(a))
            for b, extra in back.items():
                have = near[b][near[b] >= 0].tolist()
                both = np.array(list(dict.fromkeys(have + extra)))
                if len(both) > degree:
                    s = v[both] @ v[b]
                    o = np.argsort(-s, kind="stable")
                    both = diverse(v, both[o][None], s[o][None], degree)[0]
                near[b] = -1
                near[b, : len(both)] = both
            done = int(new[-1]) + 1
        return near

    def query(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the beams in the bottom layer, entered through the layers above."""
        q = np.ascontiguousarray(queries, dtype=np.float32)
        entry = np.zeros(len(q), dtype=np.int64)
        for k, (members, near) in enumerate(self.layers):
            last = k == len(self.layers) - 1
            ids, sim = search(self.vectors[members], near, q, entry, beam if last else 4)
            if last:
                return np.where(ids >= 0, members[np.maximum(ids, 0)], -1), sim
            below = self.layers[k + 1][0]
            entry = np.searchsorted(below, members[np.maximum(ids[:, 0], 0)])
        return np.full((len(q), 1), -1), np.full((len(q), 1), -np.inf)

    def dump(self) -> bytes:
        import io

        out = io.BytesIO()
        np.savez(out, **{f"m{i}": m.astype(np.int32) for i, (m, _) in enumerate(self.layers)}, **{f"n{i}": x for i, (_, x) in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes, vectors: np.ndarray) -> Graph:
        """The graph that ``dump`` wrote; its vectors are kept apart from it."""
        import io

        got = np.load(io.BytesIO(blob))
        self = cls.__new__(cls)
        self.vectors = np.ascontiguousarray(vectors, dtype=np.float32)
        self.layers = [(got[f"m{i}"].astype(np.int64), got[f"n{i}"]) for i in range(sum(k[0] == "m" for k in got.files))]
        return self


def links_in(graph: Graph, exact: np.ndarray, queries: np.ndarray, least: float, recall: float, audit: int, keys: np.ndarray, own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, shard rows) with cosine of at least ``least`` in double precision, and whole rows.

    Beams double for queries whose beam is full of links. Once a wider beam would cost more than the
    shard's whole matrix does, a query that still needs it is a whole row: its links are not among the
    pairs, but left to be read off the matrix. Then ``audit`` of the other queries, or a thousandth of
    them all if that is more, are compared with the whole shard, half of them drawn by key and half
    from those that have links, and as many again of those that have none: half with the best
    similarity below ``least``, half by key. While the share of their links found is below ``recall``,
    all beams double, up to the size of the shard. With ``own`` the queries are the shard's rows, and no
    row is asked to find itself.
    """
    n, beam = len(graph.vectors), FIRST_BEAM
    audit = max(audit, len(queries) // 1000)
    by_key = np.argsort(keys, kind="stable")
    best = np.full(len(queries), -np.inf)
    rows = np.arange(len(queries))
    while True:
        width, left, got, whole = min(beam, n), rows, [np.zeros(0, np.int64)], rows[:0]
        while len(left):
            full = []
            for part in np.array_split(left, len(left) * width // 400_000 + 1):
                ids, sim = graph.query(queries[part], width)
                hit = (sim >= least - 1e-4) & (ids >= 0)
                full.append(part[hit[:, -1]])
                if own:
                    sim = np.where(ids == part[:, None], -np.inf, sim)
                    hit &= ids != part[:, None]
                r, c = np.nonzero(hit)
                best[part] = np.maximum(best[part], np.where(ids >= 0, sim, -np.inf).max(1))
                got.append(part[r] * n + ids[r, c])
            if width >= n:
                break
            left = np.concatenate(full) if full else left[:0]
            width = min(2 * width, n)
            if width >= 4 * FIRST_BEAM and 2 * DEGREE * width * width > exact.size:
                whole = left
                break
        q, s = np.divmod(np.unique(np.concatenate(got)), n)
        part = ~np.isin(q, whole)
        q, s = q[part], s[part]
        ok = np.concatenate([np.einsum("ij,ij->i", queries[a], exact[b]) >= least for a, b in zip(np.array_split(q, len(q) // 50_000 + 1), np.array_split(s, len(s) // 50_000 + 1))])
        found_q, found_s = q[ok], s[ok]
        order = by_key[~np.isin(by_key, whole)]
        picked = order[: audit // 2]
        linked = np.unique(found_q)
        alone = order[~np.isin(order, linked)]
        missed = alone[np.argsort(-best[alone], kind="stable")][: audit // 2]
        others = alone[~np.isin(alone, picked) & ~np.isin(alone, missed)][: audit - audit // 2]
        check = np.unique(np.concatenate([picked, linked[np.argsort(keys[linked], kind="stable")][: audit - len(picked)], missed, others]))
        truth = 0
        for c in np.array_split(check, len(check) // 64 + 1):
            near = queries[c] @ exact.T >= least
            if own:
                near[np.arange(len(c)), c] = False
            truth += int(near.sum())
        if truth == 0 or np.isin(found_q, check).sum() >= recall * truth or beam >= n:
            return found_q, found_s, whole
        beam *= 2


@dataclass
class Shard:
    """Nodes of one shard and vector length: ids, how many vectors each stands for, unit vectors, graph."""

    ids: np.ndarray
    copies: np.ndarray
    exact: np.ndarray
    graph: Graph

    @property
    def keys(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return self.ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


class Edges:
    """Edges between nodes, united whenever many are held."""

    def __init__(self):
        self.held, self.n = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        self.held.append((u, v))
        self.n += len(u)
        if self.n >= HELD_EDGES:
            self.held, self.n = [self.parts()], 0

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        return unite(*(np.concatenate([x[i] for x in self.held]) for i in (0, 1)))


def read_whole(one: Shard, rows: np.ndarray, other: Shard, skip: np.ndarray, least: float, edges: Edges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many vectors of ``other`` each of ``rows`` links with, and the pairs with rows not in ``skip``.

    The links of a block of rows are counted and united in place, so their number costs no memory.
    """
    counts, got = np.zeros(len(rows), np.int64), [np.zeros((2, 0), np.int64)]
    for at in () if not len(rows) else np.array_split(np.arange(len(rows)), len(rows) * len(other.ids) // CELLS + 1):
        mine = rows[at]
        hits = one.exact[mine] @ other.exact.T >= least
        if one is other:
            hits[np.arange(len(mine)), mine] = False
        counts[at] = hits @ other.copies
        columns = np.flatnonzero(hits.any(0))
        edges.add(one.ids[mine[hits[:, columns].argmax(0)]], other.ids[columns])
        near = hits[:, columns].astype(np.float32)
        i, j = np.nonzero(np.triu(near @ near.T > 0, 1))
        edges.add(one.ids[mine[i]], one.ids[mine[j]])
        r, c = np.nonzero(hits[:, ~skip])
        got.append(np.stack([mine[r], np.flatnonzero(~skip)[c]]))
    return counts, *np.concatenate(got, 1)


def links_between(a: Shard, b: Shard, least: float, recall: float, audit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, others, low) of every linked node of two shards, or of one given twice.

    others is the number of vectors that it links with in the other shard, found from either end; low is
    the smallest node that the links connect it with.
    """
    edges = Edges()
    x, y, whole_a = links_in(b.graph, b.exact, a.exact, least, recall, audit, a.keys, a is b)
    q, p, whole_b = (x, y, whole_a) if a is b else links_in(a.graph, a.exact, b.exact, least, recall, audit, b.keys)
    is_a, is_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
    is_a[whole_a], is_b[whole_b] = True, True
    count_a, u, v = read_whole(a, whole_a, b, is_b, least, edges)
    count_b, s, r = (count_a, u, v) if a is b else read_whole(b, whole_b, a, is_a, least, edges)
    i, j = np.divmod(np.unique(np.concatenate([x, p, u, r]) * len(b.ids) + np.concatenate([y, q, v, s])), len(b.ids))
    edges.add(a.ids[i], b.ids[j])
    others_a = np.bincount(i, weights=b.copies[j], minlength=len(a.ids)).astype(np.int64)
    others_a[whole_a] = count_a
    others_b = np.bincount(j, weights=a.copies[i], minlength=len(b.ids)).astype(np.int64)
    others_b[whole_b] = count_b
    nodes, low = edges.parts()
    known, others = (a.ids, others_a) if a is b else (np.concatenate([a.ids, b.ids]), np.concatenate([others_a, others_b]))
    order = np.argsort(known)
    return nodes, others[order][np.searchsorted(known[order], nodes)], low


def near_vectors(vectors: DataFrame, least: float = 0.9, shards: int = 8, shard_rows: int = 200_000, shard_values: int = 12_800_000, recall: float = 1.0, audit: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Equal vectors are one node with a count, whatever their number, so copies never meet in a beam. A
    shard has about ``shard_rows`` nodes and ``shard_values`` components of vectors at most.
    Null, zero and non-finite vectors, and those with a null component, link with nothing. Vectors of
    different lengths are never compared. Repeated rows are copies of each other; a row without an id
    is counted by the others but gets its vector's component. Other columns are not read; an empty
    table gives an empty one.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    # a null component makes the norm null, a NaN one NaN; infinite ones are caught by the last test
    usable = F.coalesce(F.col("v").isNotNull() & (F.size("v") > 0) & (norm > 0) & ~F.isnan(norm) & (norm < F.lit(float("inf"))), F.lit(False))
    keyed = rows.withColumn("key", F.when(usable, F.sha2(F.to_json("v").cast("binary"), 256)))
    light = keyed.select("id", "key")
    nodes = keyed.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.max(F.size("v")).alias("dim"))
    # vectors differ by key, so any of a key's rows will do: the first id, or all equal rows of it once
    nodes = stash(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    total, values = nodes.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    shards = max(1, min(max(shards, -(-total // shard_rows), -(-values // shard_values)), -(-total // 64)))
    firsts = keyed.join(nodes, "key").where(F.col("id").eqNullSafe(F.col("rep"))).groupBy("node", "copies").agg(F.max("v").alias("v"))
    unit = F.transform("v", lambda x: x / norm)
    placed = firsts.select("node", "copies", unit.alias("v"), F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"))

    def build(key, rows):
        """One row for each vector length of a shard."""
        ids, copies = (np.array(rows.column(c), dtype=np.int64) for c in ("node", "copies"))
        length = rows.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        out = []
        for dim in np.unique(length):
            at = np.flatnonzero(length == dim)
            at = at[np.argsort(ids[at], kind="stable")]
            exact = np.asarray(rows.column("v").combine_chunks().take(pa.array(at)).flatten(), dtype=np.float64).reshape(len(at), dim)
            out.append({"shard": key[0].as_py(), "dim": int(dim), "ids": ids[at].tobytes(), "copies": copies[at].tobytes(), "graph": Graph(exact).dump(), "exact": exact.tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("copies", pa.binary()), ("graph", pa.binary()), ("exact", pa.binary())]))

    def held(row) -> Shard:
        exact = np.frombuffer(row["exact"], np.float64).reshape(-1, row["dim"])
        return Shard(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["copies"], np.int64), exact, Graph.load(row["graph"], exact))

    def find(key, rows):
        low, high = (k.as_py() for k in key)
        by = {(r["dim"], r["shard"]): r for r in rows.to_pylist()}
        got = [(np.zeros(0, np.int64),) * 3]
        for dim in sorted({d for d, _ in by}):
            if (dim, low) in by and (dim, high) in by:
                one = held(by[dim, low])
                got.append(links_between(one, one if low == high else held(by[dim, high]), least, recall, audit))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*got)], ["node", "others", "low"])

    graphs = stash(placed.groupBy("shard").applyInArrow(build, "shard int, dim int, ids binary, copies binary, graph binary, exact binary"), "graphs")
    # each two shards meet once, so what is sent is (vectors x shards)
    other = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    meeting = graphs.withColumn("other", other).withColumn("from", F.least("shard", "other")).withColumn("to", F.greatest("shard", "other")).drop("other")
    found = stash(meeting.groupBy("from", "to").applyInArrow(find, "node long, others long, low long"), "linked")
    counts = found.groupBy("node").agg(F.sum("others").alias("others"))
    comps = connected_components(found, "node", "low").select(F.col("id").alias("node"), "component")
    named = nodes.join(comps, "node", "left").withColumn("root", F.coalesce("component", "node"))
    low = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(low, "root").join(counts, "node", "left")
    named = named.select("key", "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    # vectors that link with nothing have no key: those rows, however many, are not joined
    none = light.where("key IS NULL").select("key", "id", F.lit(None).cast(light.schema["id"].dataType).alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    out = light.where("key IS NOT NULL").join(named, "key").select(*none.columns).unionByName(none)
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = out.select(F.col("id").cast(kind).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
