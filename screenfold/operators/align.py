"""An edge table of similar sequences: seeds, candidate pairs by joins, banded alignments in Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenfold.plans.session import stash

#: Score of a match, a mismatch and a gap; a value is a score times ``UNIT`` plus the matches on the way.
MATCH, MISMATCH, GAP, UNIT = 2, -1, -2, 1 << 24
#: Pairs that are aligned together.
TOGETHER = 1024


@dataclass(frozen=True)
class Seeding:
    """Letters of a seed, seeds of which the least is taken, letters on either side of a pair's main
    diagonal, the most sequences of a seed that are paired with each other, and the fewest seeds of a pair."""

    k: int = 5
    window: int = 6
    band: int = 24
    most: int = 200
    shared: int = 1


def minimisers(sequence: bytes, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(seed hashes, places): of each ``window`` neighbouring k-letter words that with the least hash; a
    word that is taken twice counts at its first place."""
    n = len(sequence) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters = np.frombuffer(sequence, np.uint8).astype(np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = (h ^ letters[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    w = min(window, n)
    at = np.unique(np.lib.stride_tricks.sliding_window_view(h, w).argmin(1) + np.arange(n - w + 1))
    seeds, first = np.unique(h[at], return_index=True)
    return seeds.view(np.int64), at[first]


def rows_of(la: np.ndarray, lb: np.ndarray, diagonal: np.ndarray, band: int) -> np.ndarray:
    """Rows of the first sequence that the band meets, which are the most matches a pair can have."""
    return np.minimum(la, lb - diagonal + band) - np.maximum(0, -diagonal - band)


def banded(a: list[bytes], b: list[bytes], diagonal: np.ndarray, band: int) -> np.ndarray:
    """Matches of the best alignment of each pair that stays within ``band`` of its diagonal.

    Gaps at the ends are free. Of equal scores that with more matches counts. ``TOGETHER`` pairs of about
    as many rows go row by row together.
    """
    la, lb = (np.array([len(s) for s in x], np.int64) for x in (a, b))
    rows, found = rows_of(la, lb, diagonal, band), np.zeros(len(a), np.int64)
    order = np.argsort(rows, kind="stable")
    order = order[(rows[order] > 0) & (lb[order] > 0)]
    for k in range(0, len(order), TOGETHER):
        part = order[k : k + TOGETHER]
        found[part] = _together([a[i] for i in part], [b[i] for i in part], la[part], lb[part], diagonal[part].astype(np.int64), rows[part], band)
    return found


def _together(a: list[bytes], b: list[bytes], la: np.ndarray, lb: np.ndarray, diagonal: np.ndarray, rows: np.ndarray, band: int) -> np.ndarray:
    """``banded`` of pairs that go together.

    A row is (offsets from the diagonal, pairs), raised by two units an offset and one a row, so that a
    gap along the row is a running maximum and a mismatch costs nothing. Cells left of the first letter
    begin out of reach and stay there; cells beyond the last lead only further out, and are not looked at.
    """
    most, wide, pairs = int(rows.max()), 2 * band + 1, np.arange(len(a))
    small = max(la.max(), lb.max()) + wide < 4096
    kind, unit, none = (np.int32, 1 << 12, -(1 << 29)) if small else (np.int64, UNIT, -(1 << 60))
    start = np.maximum(0, -diagonal - band)
    left = diagonal + start - band  # the place in b of offset 0 in row 0
    x, y = np.zeros((len(a), most), np.uint8), np.zeros((len(a), most + wide), np.uint8)
    for p, (s, t) in enumerate(zip(a, b)):
        s = s[start[p] : start[p] + most]
        x[p, : len(s)] = np.frombuffer(s, np.uint8)
        at = int(left[p]) - 1  # of the letter before the first place
        t = t[max(0, at) : at + most + wide]
        y[p, max(0, -at) : max(0, -at) + len(t)] = np.frombuffer(t, np.uint8)
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    lift = (-GAP * unit * np.arange(wide))[:, None]
    j = left + np.arange(wide)[:, None]
    row = np.where((j == 0) | ((start == 0) & (j >= 0) & (j <= lb)), lift, none).astype(kind)
    other, up, gain = np.empty_like(row), np.empty_like(row[1:]), np.empty_like(row)
    best, ends, last = np.zeros(len(a), np.int64), lb - left, la - start
    match, gap = kind((MATCH - MISMATCH) * unit + 1), kind((MISMATCH - GAP - GAP) * unit)
    for r in range(1, most + 1):
        np.copyto(gain, y[r : r + wide] == x[r - 1])
        np.multiply(gain, match, out=gain)
        np.subtract(row[1:], gap, out=up)
        row += gain
        np.maximum(row[:-1], up, out=row[:-1])
        if r <= wide:
            at = -left - r
            zero = np.flatnonzero((at >= 0) & (at < wide))
            row[at[zero], zero] = lift[at[zero], 0] - MISMATCH * unit * r
        step = 1
        while step < wide:
            other[:step] = row[:step]
            np.maximum(row[step:], row[:-step], out=other[step:])
            row, other, step = other, row, 2 * step
        at = ends - r
        there = np.flatnonzero((at >= 0) & (at < wide) & (r <= rows))
        if len(there):
            best[there] = np.maximum(best[there], row[at[there], there].astype(np.int64) - lift[at[there], 0] + MISMATCH * unit * r)
        for p in pairs[last == r]:
            low, high = max(0, 1 - int(left[p]) - r), min(wide, int(ends[p]) - r + 1)
            if low < high:
                best[p] = max(best[p], int((row[low:high, p].astype(np.int64) - lift[low:high, 0]).max()) + MISMATCH * unit * r)
    return best % unit


def seeds_of(classes: DataFrame, how: Seeding) -> DataFrame:
    """(cid, seed, at) of the sequences."""

    def run(batches):
        for b in batches:
            found = [minimisers((s or "").encode(), how.k, how.window) for s in b.column(1).to_pylist()]
            sizes = [len(f[0]) for f in found]
            cid = np.repeat(b.column(0).to_numpy(), sizes)
            parts = [np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int64())], ["cid", "seed", "at"])

    return classes.select("cid", "sequence").mapInArrow(run, "cid long, seed long, at long")


def classes_of(sequences: DataFrame) -> DataFrame:
    """(id, cid, sequence): letters in upper case, and the first id that has them."""
    rows = sequences.where("id IS NOT NULL AND sequence <> ''").select(F.col("id").cast("long").alias("id"), F.upper("sequence").alias("sequence"))
    keyed = rows.withColumn("key", F.sha2(F.col("sequence").cast("binary"), 256))
    first = keyed.groupBy("key").agg(F.min("id").alias("cid"))
    return keyed.join(first, "key").select("id", "cid", "sequence")


def frequent_seeds(sequences: DataFrame, how: Seeding = Seeding()) -> DataFrame:
    """(seed, n) of the seeds that more than ``most`` different sequences of (id, sequence) have."""
    rows = sequences.where("id IS NOT NULL AND sequence <> ''").select(F.upper("sequence").alias("sequence"))
    held = seeds_of(rows.distinct().select(F.lit(0).cast("long").alias("cid"), "sequence"), how).groupBy("seed").agg(F.count("*").alias("n"))
    return held.where(F.col("n") > how.most)


def similar_sequences(sequences: DataFrame, least: float = 0.4, how: Seeding = Seeding()) -> tuple[DataFrame, DataFrame]:
    """Edges (g1, g2, identity), g1 < g2, of (id, sequence), and (seed, n) of the frequent seeds.

    Identity is the matches of the best alignment over the letters of the shorter sequence. Equal
    sequences are aligned once: each is linked with the first of them, and others with that. Sequences are
    compared if they share ``shared`` seeds; those of a seed that more than ``most`` have are compared with its
    longest only, and such seeds are returned. Null and empty sequences and null ids have no edges. Letters
    are compared as they are, in any case. Pairs whose band has fewer rows than ``least`` asks matches are
    not aligned.
    """
    named = stash(classes_of(sequences), "sequences")
    classes = named.where("id = cid").dropDuplicates(["cid"]).select("cid", "sequence", F.length(F.col("sequence").cast("binary")).alias("n"))
    seeds = stash(seeds_of(classes, how).join(classes.select("cid", "n"), "cid"), "seeds")
    held = seeds.groupBy("seed").agg(F.count("*").alias("held"), F.max(F.struct("n", (-F.col("cid")).alias("back"), "at")).alias("longest"))
    held = stash(held.where("held > 1"), "held")
    rare = seeds.join(held.where(F.col("held") <= how.most).select("seed"), "seed")
    a, b = rare.select("seed", F.col("cid").alias("g1"), F.col("n").alias("n1"), F.col("at").alias("at1")), rare.select("seed", F.col("cid").alias("g2"), F.col("n").alias("n2"), F.col("at").alias("at2"))
    pairs = a.join(b, "seed").where("g1 < g2").select("g1", "g2", "n1", "n2", (F.col("at2") - F.col("at1")).alias("shift"))
    hubs = held.where(F.col("held") > how.most).select("seed", (-F.col("longest.back")).alias("hub"), F.col("longest.n").alias("hub_n"), F.col("longest.at").alias("hub_at"))
    stars = seeds.join(hubs, "seed").where("cid <> hub")
    first = F.col("cid") < F.col("hub")
    shift = F.when(first, F.col("hub_at") - F.col("at")).otherwise(F.col("at") - F.col("hub_at"))
    n1, n2 = F.when(first, F.col("n")).otherwise(F.col("hub_n")), F.when(first, F.col("hub_n")).otherwise(F.col("n"))
    pairs = pairs.unionByName(stars.select(F.least("cid", "hub").alias("g1"), F.greatest("cid", "hub").alias("g2"), n1.alias("n1"), n2.alias("n2"), shift.alias("shift")))
    near = pairs.groupBy("g1", "g2", "n1", "n2", F.round(F.col("shift") / (how.band / 2)).alias("lane")).agg(F.count("*").alias("n"), F.min("shift").alias("shift"))
    near = near.groupBy("g1", "g2", "n1", "n2").agg(F.sum("n").alias("n"), F.max_by("shift", F.struct("n", -F.abs("lane"), "lane")).alias("shift")).where(F.col("n") >= how.shared)
    rows = F.least("n1", F.col("n2") - F.col("shift") + how.band) - F.greatest(F.lit(0), -F.col("shift") - how.band)
    near = near.where(rows / F.least("n1", "n2") >= least).select("g1", "g2", "shift")
    side = lambda g, s: classes.select(F.col("cid").alias(g), F.col("sequence").alias(s))
    both = near.join(side("g1", "s1"), "g1").join(side("g2", "s2"), "g2").select("g1", "g2", "shift", "s1", "s2")

    def align(batches):
        for batch in batches:
            one, two = ([s.encode() for s in batch.column(c).to_pylist()] for c in (3, 4))
            found = banded(one, two, batch.column(2).to_numpy(), how.band) / np.array([min(len(s), len(t)) for s, t in zip(one, two)])
            keep = pa.array(found >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["g1", "g2", "identity"]).filter(keep)

    edges = both.mapInArrow(align, "g1 long, g2 long, identity double")
    copies = named.where("id <> cid").select(F.col("cid").alias("g1"), F.col("id").alias("g2"), F.lit(1.0).alias("identity")).distinct()
    return stash(edges.unionByName(copies), "similar"), held.where(F.col("held") > how.most).select("seed", F.col("held").alias("n"))
