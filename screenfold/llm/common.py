"""What the text operators share: ASCII-space words, stable hashes, table access."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; bytes.split knows exactly these six spaces."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, forgetting everything once ``most`` words are held."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(word) > LONG_WORD:  # not kept: the cache is bounded in bytes too
            return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= self.most:
            self.clear()
        got = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the input moves every bit of the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of one text, in order; a shorter text is one window, none without words."""
    if len(h) == 0:
        return h
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, 0x9E3779B97F4A7C15 + n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return out


#: Bytes of text that are hashed at a time, and the longest word that arithmetic hashes; longer ones get a digest.
PIECE, LONG_WORD = 1 << 20, 64


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values of bytes with A-Z lower-cased and spaces 0, without that lower-casing, and powers of an odd base and its inverse."""
    values = np.frombuffer(hashlib.shake_128(b"bytes").digest(256 * 8), np.uint64).copy()
    values[[9, 10, 11, 12, 13, 32]] = 0
    lower = values.copy()
    lower[65:91] = values[97:123]
    base = int.from_bytes(hashlib.blake2b(b"base", digest_size=8).digest(), "little") | 1

    def powers(x):
        out = np.ones(PIECE + LONG_WORD, np.uint64)
        n = 1
        while n < len(out):  # doubling: the first n powers times the n-th
            m = min(n, len(out) - n)
            out[n : n + m] = out[:m] * np.uint64(pow(x, n, 1 << 64))
            n += m
        return out

    return lower, values, powers(base), powers(pow(base, -1, 1 << 64))


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of every text of a string column, in order, and where each text's begin.

    Words are ``[^\\x20\\x09-\\x0D]+``; a null has none. A word's hash is the sum of its bytes' random
    values times powers of an odd base; words of over 64 bytes get a digest. Equal words have equal
    hashes anywhere; different ones share theirs at the rate of random 57-bit numbers or less.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    text = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = ~((text == 32) | ((text >= 9) & (text <= 13)))
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = at[(at > 0) & (at < len(text))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    folded, plain, power, inverse = _tables()
    values = folded if lower else plain
    out = np.zeros(len(first), np.uint64)
    k = 0
    with np.errstate(over="ignore"):
        while k < len(first):
            stop = max(k + 1, int(np.searchsorted(last, first[k] + PIECE, "right")))
            a, b = first[k], min(last[stop - 1], first[k] + PIECE)
            sums = np.add.reduceat(values[text[a:b]] * power[: b - a], first[k:stop] - a)
            out[k:stop] = mix64(sums * inverse[first[k:stop] - a])
            k = stop
    for i in np.flatnonzero(last - first > LONG_WORD):
        word = text[first[i] : last[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word.lower() if lower else word, digest_size=8).digest(), "little")
    return out, np.searchsorted(first, at)


def windows(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``ngram_hashes`` of every text of ``word_hashes``, and where each text's begin."""
    held = np.diff(at)
    times = np.where(held >= n, held - n + 1, np.minimum(held, 1))
    begins = np.concatenate([[0], np.cumsum(times)])
    whole = ngram_hashes(h, n) if len(h) >= n else np.zeros(0, np.uint64)
    pick = np.arange(begins[-1]) - np.repeat(begins[:-1] - at[:-1], times)
    out = np.zeros(len(pick), np.uint64)
    fits = np.repeat(held >= n, times)
    out[fits] = whole[pick[fits]]
    for i in np.flatnonzero((held > 0) & (held < n)):
        out[begins[i]] = ngram_hashes(h[at[i] : at[i + 1]], n)[0]
    return out, begins


def distinct_each(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct values of each text, and where each text's begin; ``values`` gets sorted."""
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[at[:-1][at[:-1] < len(values)]] = True
    return values[new], np.concatenate([[0], np.cumsum(new)])[at]


def pack_sorted(values: np.ndarray, width: int) -> bytes:
    """Ascending numbers of ``width`` bytes as differences, byte plane by byte plane: the high planes are
    nearly all zero and leave little for the shuffle after its compression."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return gaps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack_sorted(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, :width] = planes.T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Whole counts, exactly: a byte each below 255, after these two bytes for each that is not, and
    after those eight for each that does not fit two."""
    counts = np.asarray(counts, np.float64).astype("<u8")
    more = counts[counts >= 255]
    most = more[more >= 65535]
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + np.minimum(more, 65535).astype("<u2").tobytes() + most.tobytes()


def unpack_counts(raw: bytes, n: int | None = None) -> np.ndarray:
    """Counts of ``pack_counts``; ``n`` tells how many, where some may be over 254."""
    n = len(raw) if n is None else n
    counts = np.frombuffer(raw, np.uint8, n).astype(np.float64)
    large = np.flatnonzero(counts == 255)
    counts[large] = np.frombuffer(raw, "<u2", len(large), n)
    largest = large[counts[large] == 65535]
    counts[largest] = np.frombuffer(raw, "<u8", len(largest), n + 2 * len(large))
    return counts


def slices(batches, rows: int = 500, most: int = 4 << 20):
    """Arrow batches in pieces of a few rows and ``most`` bytes (a longer row is a piece of its own), so
    that Python objects of long texts stay few."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for c in batch.columns:
            if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
                sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        while at < batch.num_rows:
            stop = min(at + rows, max(at + 1, int(np.searchsorted(upto, upto[at] + most, "right")) - 1))
            yield batch.slice(at, stop - at)
            at = stop


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def finite_vectors(df: DataFrame, vec_col: str, *keep: Column) -> DataFrame:
    """``keep`` and ``vector`` (array<double>) of the rows whose vector is there and holds finite numbers only."""
    rows = df.select(*keep, F.col(vec_col).cast("array<double>").alias("vector"))
    return rows.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as the rows of a matrix of doubles; a shorter one ends in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    held = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (held == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), held)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(held) - held, held)] = flat
    return out


def scaled_floor(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as long; what lies beyond 2^62 counts as 2^62."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -float(1 << 62), float(1 << 62)).astype(np.int64)
