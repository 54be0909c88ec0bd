"""Op 4: scores of documents by the cross-entropy difference of two n-gram models.

The target model counts documents labelled good, the background model counts every document; both have
the words and word pairs of the whole corpus as one vocabulary, and the background's counts are matched
to the target's size. Counts are never gathered in one place: blocks of documents send each distinct
gram once to its bucket, buckets sum and answer, and each block scores its documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenfold.llm.common import mix64, pack_counts, pack_sorted, slices, unpack_counts, unpack_sorted, word_hashes
from screenfold.llm.mixing import word_count
from screenfold.plans.session import shuffle_width

#: Bits of a gram's hash. Of n distinct grams about n / 2**48 share theirs with another.
BITS = 48


@dataclass(frozen=True)
class Smoothing:
    """``unit`` is added to the count of a gram, ``mass`` to that of a context."""

    unit: float = 0.5
    mass: float = 50.0


@dataclass(frozen=True)
class Grams:
    """Hashes of the lower-cased words of whole texts and of their pairs of neighbours, and where each
    text's begin."""

    words: np.ndarray
    words_at: np.ndarray
    pairs: np.ndarray
    pairs_at: np.ndarray

    @property
    def flat(self) -> np.ndarray:
        return np.concatenate([self.words, self.pairs])

    def per_gram(self, of_texts: np.ndarray) -> np.ndarray:
        """A value of each text for each of ``flat``."""
        return np.concatenate([np.repeat(of_texts, np.diff(self.words_at)), np.repeat(of_texts, np.diff(self.pairs_at))])


def text_grams(texts: pa.Table) -> Grams:
    """Grams of the one column of ``texts``, hashed piece by piece."""
    words, pairs, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for part in slices(texts.combine_chunks().to_batches()):
        w, at = word_hashes(part.column(0))
        with np.errstate(over="ignore"):
            p = mix64(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + mix64(w[1:] + np.uint64(1)))
        inside = np.ones(len(p), bool)
        inside[at[(at > 0) & (at < len(w))] - 1] = False  # from one text to the next
        words.append(w >> np.uint64(64 - BITS))
        pairs.append(p[inside] >> np.uint64(64 - BITS))
        held.append(np.diff(at))
    n = np.concatenate(held)[1:]
    begins = lambda x: np.concatenate([[0], np.cumsum(x)])
    return Grams(np.concatenate(words), begins(n), np.concatenate(pairs), begins(np.maximum(n - 1, 0)))


def ratio(target: np.ndarray, background: np.ndarray, match: float, add: float) -> np.ndarray:
    return np.log((np.maximum(target, 0) + add) / (np.maximum(background, 0) * match + add))


def text_scores(grams: Grams, distinct: np.ndarray, at: np.ndarray, target: np.ndarray, background: np.ndarray, is_target: np.ndarray, match: float, smooth: Smoothing) -> np.ndarray:
    """For each text the mean over tokens of background loss minus target loss, its own counts left out.

    ``target`` and ``background`` count the ``distinct`` grams, ``at`` places ``grams.flat`` among them.
    A token's loss is the mean of its loss as a word and as the successor of the word before it; the
    first has only the former. A text without words scores 0.
    """
    texts = grams.per_gram(np.arange(len(is_target)))
    _, same, own = np.unique(texts * len(distinct) + at, return_inverse=True, return_counts=True)
    own = own[same]
    t, b = target[at] - own * is_target[texts], background[at] - own
    n = len(grams.words)
    loss = ratio(t[:n], b[:n], match, smooth.unit)
    held = np.diff(grams.words_at)
    later = np.ones(n, bool)
    later[grams.words_at[:-1][held > 0]] = False
    before = np.flatnonzero(later) - 1
    after = ratio(t[n:], b[n:], match, smooth.unit) - ratio(t[before], b[before], match, smooth.mass)
    loss[later] = (loss[later] + after) / 2
    out = np.zeros(len(held))
    if n:
        out[held > 0] = np.add.reduceat(loss, grams.words_at[:-1][held > 0]) / held[held > 0]
    return out


def score(docs: DataFrame, labels: DataFrame, smooth: Smoothing = Smoothing(), block_words: int = 400_000) -> DataFrame:
    """(doc_id, n_tokens, score, selected) of every row.

    ``score`` is in nats a token and positive where the target explains a text better than the
    background; ``selected`` says so. Null and empty texts have no tokens and score 0. Labels with a
    null id or quality are ignored, and of several for an id the lowest counts; without good labels
    every score is 0. Very long texts are hashed piece by piece. Repeated rows are documents of their own and get equal scores; other columns are
    not read; an empty table gives an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select(F.col("doc_id").cast(kind).alias("doc_id"))
    sizes = docs.select("doc_id", word_count().alias("n"))
    every = sizes.agg(F.sum("n").alias("words")).first()
    target = sizes.join(good, "doc_id", "left_semi").agg(F.sum("n").alias("words")).first()["words"] or 0
    match = target / every["words"] if every["words"] else 0.0
    blocks = max(16, (every["words"] or 0) // block_words)
    buckets = max(16, min(shuffle_width(docs.sparkSession), 64), 2 * (every["words"] or 0) // 8_000_000)
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")
    texts = docs.select("doc_id", "text", block)
    flags = good.select("doc_id", block)
    edges = ((np.arange(1, buckets, dtype=np.uint64) << np.uint64(32)) // np.uint64(buckets)) << np.uint64(BITS - 32)

    def ask(key, rows, flagged):
        held = text_grams(rows.select(["text"]))
        grams, at = np.unique(held.flat, return_inverse=True)
        good_ids = set(flagged.column("doc_id").to_pylist())
        chosen_texts = np.array([d in good_ids for d in rows.column("doc_id").to_pylist()], bool)
        total, chosen = np.bincount(at, minlength=len(grams)), np.bincount(at[held.per_gram(chosen_texts)], minlength=len(grams))
        cuts = np.searchsorted(grams, edges)
        parts = list(zip(np.split(grams, cuts), np.split(total, cuts), np.split(chosen, cuts)))
        keep = [i for i, p in enumerate(parts) if len(p[0])]
        binary = lambda k: pa.array([pack_counts(parts[i][k]) for i in keep], pa.binary())
        packed = pa.array([pack_sorted(parts[i][0], BITS // 8) for i in keep], pa.binary())
        return pa.table({"block": pa.array([key[0].as_py()] * len(keep), pa.int32()), "bucket": pa.array(keep, pa.int32()), "grams": packed, "total": binary(1), "chosen": binary(2)})

    def answer(key, rows):
        asked = [unpack_sorted(x, BITS // 8) for x in rows.column("grams").to_pylist()]
        grams, at = np.unique(np.concatenate(asked), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([unpack_counts(x, len(a)) for x, a in zip(rows.column(c).to_pylist(), asked)])) for c in ("total", "chosen")]
        where = [np.searchsorted(grams, a) for a in asked]
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "total": pa.array([pack_counts(sums[0][w]) for w in where], pa.binary()), "chosen": pa.array([pack_counts(sums[1][w]) for w in where], pa.binary())})

    def finish(key, rows, got):
        held = text_grams(rows.select(["text"]))
        grams, at = np.unique(held.flat, return_inverse=True)
        got = got.to_pylist()
        good_ids = {r["doc_id"] for r in got if r["bucket"] is None}
        parts = sorted((r for r in got if r["bucket"] is not None), key=lambda r: r["bucket"])
        counts_in = np.diff(np.searchsorted(grams, edges), prepend=0, append=len(grams))
        total, chosen = (np.concatenate([unpack_counts(r[c], counts_in[r["bucket"]]) for r in parts] or [np.zeros(0)]) for c in ("total", "chosen"))
        ids = rows.column("doc_id")
        is_target = np.array([d in good_ids for d in ids.to_pylist()], bool)
        scores = text_scores(held, grams, at, chosen, total, is_target, match, smooth)
        return pa.table({"doc_id": ids, "n_tokens": pa.array(np.diff(held.words_at), pa.int64()), "score": pa.array(scores, pa.float64())})

    asked = texts.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(ask, "block int, bucket int, grams binary, total binary, chosen binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "block int, bucket int, total binary, chosen binary")
    right = answers.withColumn("doc_id", F.lit(None).cast(kind)).unionByName(flags, allowMissingColumns=True)
    out = texts.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(finish, f"doc_id {kind}, n_tokens long, score double")
    return out.withColumn("selected", F.col("score") > 0)
