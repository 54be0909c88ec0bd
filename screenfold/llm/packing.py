"""Op 12: best-fit packing by a grouping genetic algorithm on islands.

Texts are cut into pieces of at most a sequence's length. Whole pieces fill a sequence of their own; the rest
is dealt into problems of a few thousand pieces. For each problem several islands breed packings of their
own: a child takes over whole well-filled bins of one parent, the other parent's bins that hold a document twice
are dissolved, and the documents so displaced go where they fit best. After each round the elite of an island
moves to the next. Bins that are still not full meet those of other problems in a next, smaller level, where
they begin as they are, so that a level never needs more bins than the one before.
"""

from __future__ import annotations

import json
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenfold.llm.common import slices
from screenfold.llm.token_counts import byte_symbols
from screenfold.plans.session import Scratch, shuffle_width

#: Pre-tokenizer of byte-level vocabularies; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Ids of texts as 32-bit little-endian bytes, equal to those of the tokenizer file's library.

    A byte-level vocabulary whose ids follow its merges means the same to a rank-based encoder, which is
    several times faster; any other tokenizer, and texts that hold an added token, go to the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.ranks = self._ranks(json.load(f))

    def _ranks(self, read: dict):
        """The rank-based encoder, or None if the file asks for anything else than plain byte-level merges."""
        model, before = read["model"], read.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not read.get("normalizer")
        if not plain or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        symbols = byte_symbols()
        if any(vocab.get(c, 256) > 255 for c in symbols) or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        import tiktoken

        byte = {c: b for b, c in enumerate(symbols)}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.ranks is None or any(x in text for x in self.added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        try:
            return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:  # runs of white space too long for its pattern engine
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer: str, limit: int, end: int, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32, at) of every piece of every document; ``at`` numbers them."""
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, at long"

    def run(batches):
        encoder, at = Encoder(tokenizer), TaskContext.get().partitionId() << 33
        tail = int(end).to_bytes(4, "little")
        for b in slices(batches):
            row, out = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = encoder.encode(text or "") + tail
                n = len(ids) // 4
                start, stop, piece = 0, (n - 1) % limit + 1, 0
                while start < n:
                    row.append(k)
                    out.append((piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, stop, piece = stop, stop + limit, piece + 1
            cells = list(zip(*out)) if out else [[]] * 4
            numbers = np.arange(at, at + len(row))
            at += len(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))), pa.array(numbers, pa.int64())], [id_col, "piece", "start", "length", "ids_crc32", "at"])

    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, shape)


@dataclass(frozen=True)
class Breeding:
    """Pieces of a problem, islands of it, packings of an island, rounds between which elites move,
    children a round, and the largest share of a parent's bins that a child takes over."""

    items: int = 4096
    islands: int = 3
    population: int = 6
    rounds: int = 2
    children: int = 12
    share: float = 0.15


class Bins:
    """Bins by the room they have left, to find the one that a size fits best."""

    def __init__(self, limit: int, room: np.ndarray):
        self.limit, self.held, self.mask, self.n = limit, {}, 0, len(room)
        for b in np.flatnonzero(room).tolist():
            self._put(b, int(room[b]))

    def _put(self, b: int, room: int) -> None:
        if room:
            self.held.setdefault(room, []).append(b)
            self.mask |= 1 << room

    def place(self, size: int) -> int:
        """The fullest bin that takes ``size``, else a new one."""
        fits = self.mask >> size
        if not fits:
            b, room = self.n, self.limit
            self.n += 1
        else:
            room = size + (fits & -fits).bit_length() - 1
            held = self.held[room]
            b = held.pop()
            if not held:
                self.mask &= ~(1 << room)
        self._put(b, room - size)
        return b


def best_fit(sizes: np.ndarray, order: np.ndarray, limit: int, bins: np.ndarray | None = None) -> np.ndarray:
    """Bin of each piece; those that have none (-1) are placed in ``order``, each where it fits best."""
    out = np.full(len(sizes), -1, np.int32) if bins is None else bins.copy()
    has = out >= 0
    room = limit - np.bincount(out[has], sizes[has], int(out.max(initial=-1)) + 1).astype(np.int64)
    open_bins = Bins(limit, room)
    for k, size in zip(order.tolist(), sizes[order].tolist()):
        out[k] = open_bins.place(size)
    return out


def fills(sizes: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return np.bincount(bins, sizes).astype(np.int64)


def fitness(sizes: np.ndarray, bins: np.ndarray, limit: int) -> tuple[int, float]:
    """Fewer bins are better, then bins that differ more in fill; larger is fitter."""
    got = fills(sizes, bins)
    return -len(got), float(((got / limit) ** 2).sum())


def _close(bins: np.ndarray) -> np.ndarray:
    """The same groups, numbered without gaps; -1 stays."""
    found, at = np.unique(bins, return_inverse=True)
    return (at - (1 if len(found) and found[0] < 0 else 0)).astype(np.int32)


def crossover(sizes: np.ndarray, receiver: np.ndarray, giver: np.ndarray, limit: int, share: float, rng: np.random.Generator) -> np.ndarray:
    """``receiver`` with whole well-filled bins of ``giver`` in it.

    Bins of the receiver that hold a document of an injected bin, and its few emptiest, are dissolved;
    their other documents go where they fit best, larger ones first.
    """
    full = fills(sizes, giver)
    taken = rng.random(len(full)) < rng.uniform(0.01, share) * 2 * (full >= np.median(full))
    injected = taken[giver]
    gone = np.zeros(int(receiver.max()) + 1, bool)
    gone[receiver[injected]] = True
    emptiest = np.argsort(fills(sizes, receiver), kind="stable")[: int(rng.integers(1, 6))]
    gone[emptiest] = True
    child = np.where(gone[receiver], -1, receiver)
    child = np.where(injected, giver + len(gone), child)
    displaced = np.flatnonzero(child < 0)
    order = displaced[np.argsort(-sizes[displaced] * rng.uniform(0.95, 1.05, len(displaced)))]
    return best_fit(sizes, order, limit, _close(child))


def first_packings(sizes: np.ndarray, limit: int, n: int, rng: np.random.Generator, start: np.ndarray | None) -> list[np.ndarray]:
    """``start`` if there is one, best fit by falling size, and best fit in orders that are near it."""
    out = [] if start is None else [_close(start)]
    out.append(best_fit(sizes, np.argsort(-sizes, kind="stable"), limit))
    while len(out) < n:
        out.append(best_fit(sizes, np.argsort(-sizes * rng.uniform(0.8, 1.25, len(sizes))), limit))
    return out[:n]


def breed(sizes: np.ndarray, population: list[np.ndarray], limit: int, how: Breeding, rng: np.random.Generator) -> list[np.ndarray]:
    """The population after ``how.children`` children, fittest first; ends when no packing can be better."""
    least = -(-int(sizes.sum()) // limit)
    held = sorted(((fitness(sizes, p, limit), k, p) for k, p in enumerate(population)), key=lambda x: (x[0], -x[1]), reverse=True)
    for child in range(how.children):
        if -held[0][0][0] <= least:
            break
        a, b = sorted(rng.choice(len(held), 2, replace=False).tolist()) if len(held) > 1 else (0, 0)
        new = crossover(sizes, held[a][2], held[b][2], limit, how.share, rng)
        fit = fitness(sizes, new, limit)
        if fit > held[-1][0] and all(fit != x[0] for x in held):
            held[-1] = (fit, len(population) + child, new)
            held.sort(key=lambda x: (x[0], -x[1]), reverse=True)
    return [p for _, _, p in held]


def _evolve(islands: DataFrame, limit: int, how: Breeding, turn: int) -> DataFrame:
    """One round of every island: (shard, island, sizes, population, elite, bins, spread)."""
    out = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("sizes", pa.binary()), ("population", pa.list_(pa.binary())), ("elite", pa.binary()), ("bins", pa.int32()), ("spread", pa.float64())])

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                sizes = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
                rng = np.random.default_rng((row["shard"], row["island"], turn, len(sizes)))
                held = [np.frombuffer(p, "<i4") for p in row["population"]]
                if turn == 0:
                    held = first_packings(sizes, limit, how.population, rng, held[0] if held else None)
                elif row["guest"] is not None and row["guest"] not in row["population"]:
                    held[-1] = np.frombuffer(row["guest"], "<i4")
                held = breed(sizes, held, limit, how, rng)
                score = fitness(sizes, held[0], limit)
                raw = [p.astype("<i4").tobytes() for p in held]
                yield pa.RecordBatch.from_pylist([{"shard": row["shard"], "island": row["island"], "sizes": row["sizes"], "population": raw, "elite": raw[0], "bins": -score[0], "spread": score[1]}], out)

    return islands.mapInArrow(run, "shard long, island int, sizes binary, population array<binary>, elite binary, bins int, spread double")


def _problems(rows: DataFrame) -> DataFrame:
    """(shard, sizes, population) of each problem, its pieces by ``at``; packed as they are where they have bins."""

    def run(table):
        table = table.sort_by("at")
        group = table.column("group")
        start = [] if group.null_count else [np.unique(group.to_numpy(), return_inverse=True)[1].astype("<i4").tobytes()]
        return pa.table({"shard": table.column("shard").slice(0, 1), "sizes": [table.column("length").to_numpy().astype("<i4").tobytes()], "population": pa.array([start], pa.list_(pa.binary()))})

    return rows.select("shard", "at", "length", "group").groupBy("shard").applyInArrow(run, "shard long, sizes binary, population array<binary>")


def _level(scratch: Scratch, rows: DataFrame, columns: list[str], limit: int, how: Breeding) -> DataFrame:
    """``columns`` of every piece with (shard, bin, offset, room): the best packing that any island found."""
    wide = shuffle_width(rows.sparkSession)
    islands = scratch.keep(_problems(rows)).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(how.islands - 1))))
    islands = scratch.keep(_evolve(islands.withColumn("guest", F.lit(None).cast("binary")).repartition(wide, "shard", "island"), limit, how, 0))
    for turn in range(1, how.rounds):
        elite = islands.select("shard", ((F.col("island") + 1) % how.islands).alias("island"), F.col("elite").alias("guest"))
        islands = scratch.keep(_evolve(islands.join(elite, ["shard", "island"]).repartition(wide, "shard", "island"), limit, how, turn))
    best = islands.groupBy("shard").agg(F.max_by("elite", F.struct(-F.col("bins"), "spread", -F.col("island"))).alias("elite"))

    def assign(items, found):
        items = items.sort_by("at")
        bins = np.frombuffer(found.column("elite")[0].as_py(), "<i4")
        sizes = items.column("length").to_numpy()
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(sizes[order])
        begins = np.searchsorted(bins[order], np.arange(int(bins.max()) + 1))
        offset = np.empty(len(bins), np.int64)
        offset[order] = ends - sizes[order] - (ends - sizes[order])[begins][bins[order]]
        room = limit - fills(sizes, bins)
        return pa.table([*(items.column(c) for c in columns), items.column("shard"), pa.array(bins, pa.int32()), pa.array(offset), pa.array(room[bins])], [*columns, "shard", "bin", "offset", "room"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(columns).schema)
    return scratch.keep(rows.select(*columns, "shard").groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(assign, f"{kinds}, shard long, bin int, offset long, room long"))


def pack(docs: DataFrame, tokenizer: str, limit: int = 1024, end: int = 2, how: Breeding = Breeding(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    A null text is empty and holds the end id alone. Repeated rows and null ids are documents of their
    own. Texts of any length are encoded whole; only those of more than ``limit`` ids are cut, the first
    piece being the shorter one. Other columns are not read; an empty table gives an empty one. Levels
    end with the one that is a single problem, or that saves less than one bin in 10,000.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    columns = [id_col, "piece", "start", "length", "ids_crc32", "at"]
    cut = scratch.keep(pieces(docs, tokenizer, limit, end, id_col, text_col))
    out = cut.where(F.col("length") == limit).select(*columns[:-1], (-1 - F.col("at")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < limit).withColumn("group", F.lit(None).cast("long"))
    key, level, before = F.xxhash64("at"), 0, None
    while n := rest.count():
        shards = -(-n // how.items)
        rest = rest.withColumn("shard", F.pmod(key, F.lit(shards)))
        packed = _level(scratch, rest, columns, limit, how)
        last = packed.where("offset = 0")
        bins, open_bins = last.agg(F.count("*"), F.count_if(F.col("room") > 0)).first()
        done = shards == 1 or (before is not None and before - bins < bins / 10_000) or open_bins < 2
        settled = packed if done else packed.where("room = 0")
        sequence = F.lit(level << 56) + F.shiftleft("shard", 24) + F.col("bin")
        out = out.unionAll(settled.select(*columns[:-1], sequence.alias("sequence_id"), "offset"))
        if done:
            break
        rest = packed.where("room > 0").select(*columns, (F.shiftleft("shard", 24) + F.col("bin")).alias("group"))
        key, level, before = F.xxhash64("group"), level + 1, open_bins
    return out
