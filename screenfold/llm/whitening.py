"""Op 11: whitening of vectors by a bit-sliced scatter matrix.

Components become whole numbers, shifted so that each dimension's least is 0. A task packs every bit plane
of a dimension over its rows into words; the AND of two planes and the count of its bits, weighted by the
planes' places, sum to the exact cross-product of two dimensions. Cross-products are centred as integers
and only then become doubles for the eigenvectors. What tasks hand over is one row for each dimension,
whatever their number of rows; the driver sees the covariance matrix and nothing that grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenfold.llm.common import finite_vectors, matrix, scaled_floor

#: x = floor(SCALE * c) + BASE; components kept; rows that are packed at a time.
SCALE, BASE, COMPONENTS, ROWS = 64, 1_000_000, 32, 8192
#: Bits of a limb of a cross-product, and what share of the trace counts as no variance.
LIMB, NOTHING = 32, 1e-13


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: rows of the fit, sums of each dimension, the covariance, its eigenvalues from
    the largest down and the unit eigenvectors as columns."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def width(self) -> int:
        return len(self.sums)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: longs where they suffice, Python's integers elsewhere."""
        most = self.n * max(int(np.abs(x).max(initial=0)), 1) + max((abs(s) for s in self.sums), default=0)
        if most < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def project(self, deviations: np.ndarray, k: int) -> np.ndarray:
        """Whitened values of the first ``k`` components; NaN for those without variance."""
        usable = self.values[:k] > NOTHING * max(np.trace(self.covariance), 0)
        scale = np.full(len(usable), np.nan)
        scale[usable] = 1 / np.sqrt(self.values[:k][usable])
        return (deviations / self.n).astype(np.float64) @ self.vectors[:, :k] * scale

    @property
    def explained(self) -> np.ndarray:
        trace = np.trace(self.covariance)
        return self.values / trace if trace > 0 else np.full(self.width, np.nan)


def whole_numbers(vectors: pa.Array, width: int) -> np.ndarray:
    return scaled_floor(matrix(vectors, width), SCALE) + BASE


def chunks(batches, width: int, rows: int = ROWS) -> Iterator[np.ndarray]:
    """Whole numbers of a task's vectors, ``rows`` at a time."""
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, rows):
            x = whole_numbers(b.column(0).slice(at, rows), width)
            held.append(x)
            n += len(x)
            if n >= rows:
                x = np.concatenate(held)
                yield x[:rows]
                held, n = [x[rows:]], n - rows
    if n:
        yield np.concatenate(held)


def bit_planes(shifted: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes of each dimension, one after another, as words of 64 rows; where a dimension's begin; each plane's place."""
    rows, width = shifted.shape
    words = -(-rows // 64)
    begins = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)
    planes = np.zeros((begins[-1], words * 8), np.uint8)
    places = np.arange(begins[-1]) - np.repeat(begins[:-1], bits)
    for place in range(max(bits)):
        has = np.flatnonzero(np.array(bits) > place)
        packed = np.packbits(((shifted[:, has] >> np.uint64(place)) & np.uint64(1)).astype(np.uint8), axis=0, bitorder="little")
        planes[begins[has] + place, : len(packed)] = packed.T
    return planes.view(np.uint64), begins, places


def add_scatter(limbs: np.ndarray, shifted: np.ndarray, bits: list[int]) -> None:
    """Add the cross-products of some rows, dimension i with each j from i on, to ``limbs`` [limb, i, j]."""
    planes, begins, places = bit_planes(shifted, bits)
    for i in range(len(bits)):
        first = begins[i]
        for p in range(first, begins[i + 1]):
            both = np.bitwise_count(planes[p] & planes[first:]).sum(axis=1, dtype=np.int64)
            weight = places[p] + places[first:]
            for limb in range(int(weight.max()) // LIMB + 1):
                part = np.where(weight // LIMB == limb, both << (weight % LIMB), 0)
                limbs[limb, i, i:] += np.add.reduceat(part, begins[i:-1] - first)
    _carry(limbs)


def _carry(limbs: np.ndarray) -> None:
    for k in range(len(limbs) - 1):
        limbs[k + 1] += limbs[k] >> LIMB
        limbs[k] &= (1 << LIMB) - 1


def fit(df: DataFrame, vec_col: str = "embedding") -> Whitening | None:
    """The whitening of all vectors of ``df`` that are there and finite; None if there are none.

    Vectors of unequal length end in zeros. Repeated rows count as often as they are there. Components
    beyond 2^62 / 64 count as that. One pass finds ranges and sums, a second the cross-products; both
    are exact, so neither order nor number of tasks matters.
    """
    rows = finite_vectors(df, vec_col)
    found = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    n, width = found[0], found[1] or 0
    if not n or not width:
        return None

    def ranges(batches):
        low = high = None
        total = [0] * width
        for x in chunks(batches, width):
            low = x.min(0) if low is None else np.minimum(low, x.min(0))
            high = x.max(0) if high is None else np.maximum(high, x.max(0))
            exact = x if max(abs(int(low.min())), abs(int(high.max()))) < 1 << 48 else x.astype(object)
            total = [a + int(b) for a, b in zip(total, exact.sum(0))]
        if low is not None:
            high_part = pa.array([t >> LIMB for t in total], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(low), pa.array(high), high_part, pa.array([t & ((1 << LIMB) - 1) for t in total], pa.int64())], ["i", "low", "high", "above", "below"])

    each = rows.mapInArrow(ranges, "i int, low long, high long, above long, below long").groupBy("i")
    each = each.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("above").alias("above"), F.sum("below").alias("below")).collect()  # one row a dimension
    each.sort(key=lambda r: r["i"])
    low = np.array([r["low"] for r in each], np.int64)
    bits = [max(1, int(r["high"] - r["low"]).bit_length()) for r in each]
    sums = [(r["above"] << LIMB) + r["below"] for r in each]
    shifted_sums = [s - n * int(a) for s, a in zip(sums, low)]
    height = 2 * (max(bits) - 1) // LIMB + 3

    def scatter(batches):
        limbs = np.zeros((height, width, width), np.int64)
        some = False
        for x in chunks(batches, width):
            add_scatter(limbs, (x - low).view(np.uint64), bits)
            some = True
        if some:
            flat = [limbs[:, i, i:].ravel() for i in range(width)]
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(flat, pa.list_(pa.int64()))], ["i", "limbs"])

    def centred(part):
        i = part.column("i")[0].as_py()
        limbs = np.zeros((height, width - i), np.int64)
        for got in part.column("limbs"):
            limbs += got.values.to_numpy(zero_copy_only=False).reshape(height, -1)
        product = sum(limbs[k].astype(object) << (LIMB * k) for k in range(height))
        cells = [(n * int(q) - shifted_sums[i] * s) / (n * n) for q, s in zip(product, shifted_sums[i:])]
        return pa.table({"i": pa.array([i], pa.int32()), "cells": pa.array([cells], pa.list_(pa.float64()))})

    parts = rows.mapInArrow(scatter, "i int, limbs array<long>").groupBy("i").applyInArrow(centred, "i int, cells array<double>").collect()  # the covariance
    v = np.zeros((width, width))
    for r in parts:
        v[r["i"], r["i"] :] = r["cells"]
    v += np.triu(v, 1).T
    values, vectors = np.linalg.eigh(v)
    return Whitening(n, sums, v, values[::-1].copy(), np.ascontiguousarray(vectors[:, ::-1]))


def apply(df: DataFrame, model: Whitening, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, deviation, whitened) of every finite vector.

    ``deviation`` is the sum over dimensions of (n x - S)^2, null where no long holds it; ``whitened``
    has a value for each of the first components, null for one without variance. Rows with a null id or
    a repeated one stay; other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                apart = model.deviations(whole_numbers(part.column("vector"), model.width))
                size = float(max(abs(int(apart.max(initial=0))), abs(int(apart.min(initial=0)))))
                exact = apart if model.width * size * size < 2.0**62 else apart.astype(object)
                squares = [s if s < 1 << 63 else None for s in (exact * exact).sum(1).tolist()]
                white = model.project(apart, components)
                k = white.shape[1]
                flat = pa.array(white.ravel(), from_pandas=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(white) * k + 1, k) if k else np.zeros(len(white) + 1), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(squares, pa.int64()), lists], [id_col, "deviation", "whitened"])

    return finite_vectors(df, vec_col, F.col(id_col)).mapInArrow(run, f"`{id_col}` {kind}, deviation long, whitened array<double>")


def identity_error(white: DataFrame) -> float | None:
    """Largest absolute entry of the covariance of ``apply``'s values minus the identity, over components with variance."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                w = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                w = np.concatenate([np.nan_to_num(w), np.ones((len(w), 1))], 1)
                total = w.T @ w if total is None else total + w.T @ w
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["cell", "value"])

    cells = white.select("whitened").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()  # (components + 1)^2 rows
    if not cells:
        return None
    total = np.zeros(len(cells))
    for r in cells:
        total[r["cell"]] = r["value"]
    total = total.reshape(int(len(cells) ** 0.5), -1)
    n, mean = total[-1, -1], total[-1, :-1] / total[-1, -1]
    covariance = total[:-1, :-1] / n - np.outer(mean, mean)
    has = np.diag(total[:-1, :-1]) > 0
    return float(np.abs(covariance[np.ix_(has, has)] - np.eye(has.sum())).max(initial=0)) if has.any() else None


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each finite vector and component: (id, component, n, deviation, whitened, explained, identity_error).

    Fitted on all rows of ``df``. A table without finite vectors gives no rows; a component without
    variance gives null as ``whitened``, and a table without any null as ``explained`` and
    ``identity_error`` too. Ties of eigenvalues are in the order of the eigenvector routine.
    """
    columns = (id_col, "component", "n", "deviation", "whitened", "explained", "identity_error")
    model = fit(df, vec_col)
    if model is None:
        kind = df.schema[id_col].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    white = apply(df, model, components, id_col, vec_col)
    error = identity_error(white)
    explained = F.array(*(F.lit(None if np.isnan(e) else float(e)).cast("double") for e in model.explained[:components]))
    out = white.select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    out = out.withColumns({"component": (F.col("at") + 1).cast("int"), "n": F.lit(model.n).cast("long"), "explained": F.get(explained, F.col("at")), "identity_error": F.lit(error).cast("double")})
    return out.select(*columns)
