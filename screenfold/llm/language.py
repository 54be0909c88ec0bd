"""Op 5: language identification by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenfold.llm.common import slices

BITS = 15
_word = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a text has a letter; numerals such as superscripts are none."""
    return any(m[0].isalpha() for m in _word.finditer(text))


def buckets(text: str) -> np.ndarray:
    """Hashed 2-, 3- and 4-grams of the whole lower-cased text's bytes, as one array of bucket ids."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    out = []
    with np.errstate(over="ignore"):
        for n in (2, 3, 4):
            if len(raw) >= n:
                h = np.full(len(raw) - n + 1, n, dtype=np.uint32)
                for i in range(n):
                    h = (h ^ raw[i : len(raw) - n + 1 + i]) * np.uint32(0x01000193)
                    h ^= h >> np.uint32(15)
                out.append(h >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their share of the text's subwords."""
    counts = np.bincount(buckets(text), minlength=1)
    ids = np.flatnonzero(counts)
    return ids, counts[ids] / max(1, counts.sum())


@dataclass
class LanguageModel:
    """``table`` is the embeddings times the softmax weights: a document's logits are the average of
    its subwords' rows plus ``bias``. ``heat`` calibrates probabilities; below ``floor`` the calibrated
    score is rejected."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    heat: float
    floor: float

    def probabilities(self, text: str) -> np.ndarray:
        counts = np.bincount(buckets(text), minlength=1 << BITS)
        return softmax((counts @ self.table / max(1, counts.sum()) + self.bias)[None] / self.heat)[0]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], langs: list[str], dim: int = 16, epochs: int = 12, rate: float = 0.6, precision: float = 0.99, seed: int = 11) -> LanguageModel:
    """Stochastic gradient descent over mini-batches of averaged embeddings.

    A fifth is held back to set the temperature (least log loss) and the rejection floor: the lowest
    calibrated score from which on predictions are right at least at the rate ``precision``.
    """
    names = sorted(set(langs))
    y = np.array([names.index(v) for v in langs])
    bags = [bag(t) for t in texts]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, seen = (order[: len(y) // 5], order[len(y) // 5 :]) if len(y) >= 25 else (order, order)
    emb = rng.normal(0, 0.1, (1 << BITS, dim))
    out, bias = rng.normal(0, 0.1, (dim, len(names))), np.zeros(len(names))
    batch = 16
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        rng.shuffle(seen)
        for at in range(0, len(seen), batch):
            rows = seen[at : at + batch]
            mean = np.stack([w @ emb[i] for i, w in (bags[r] for r in rows)])
            g = softmax(mean @ out + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            back = g @ out.T
            out -= step * 4 * (mean.T @ g)
            bias -= step * g.sum(0)
            for r, b in zip(rows, back):
                i, w = bags[r]
                # averaged embeddings have small gradients: scale by the bag's width
                emb[i] -= step * 40 * w[:, None] * b[None]
    table = emb @ out
    z = np.stack([w @ table[i] for i, w in (bags[r] for r in held)]) + bias
    losses = [(-np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean(), t) for t in np.geomspace(0.05, 5, 40)]
    heat = min(losses)[1]
    p = softmax(z / heat)
    score, right = p.max(1), p.argmax(1) == y[held]
    falling = np.argsort(-score, kind="stable")
    rates = np.cumsum(right[falling]) / np.arange(1, len(held) + 1)
    good = np.flatnonzero(rates >= precision)
    floor = float(score[falling][good[-1]]) if len(good) else 1.0
    return LanguageModel(names, table, bias, float(heat), floor)


def fold(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


#: Parts into which a language's rows are dealt where its rate is joined to them.
SALTS = 16


def training_sample(docs: DataFrame, sample: int) -> DataFrame:
    """(doc_id, lang, hash, n) of about ``sample`` labelled rows at most, as many of each language as there
    are, by hash of id; ``hash`` and ``n`` are a hash of the text and its length.

    Counts of languages come first and are joined back to rows without their texts; a row is in if its
    hash falls below its language's share, so no language's rows meet in one task and no language is
    left out.
    """
    ok = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(fold(), F.lit(1)) != 1))
    counts = ok.groupBy("lang").agg(F.count("*").alias("held"))
    every = counts.agg(F.count("*").alias("langs"))
    rates = counts.crossJoin(F.broadcast(every)).select("lang", F.least(F.lit(1.0), F.lit(float(sample)) / F.col("langs") / F.col("held")).alias("rate"))
    rates = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    light = ok.select("doc_id", "lang", F.xxhash64("text").alias("hash"), F.length("text").alias("n"))
    light = light.withColumn("salt", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(SALTS)).cast("int"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return light.join(rates, ["lang", "salt"]).where(place < F.col("rate")).select("doc_id", "lang", "hash", "n")


def fit(docs: DataFrame, sample: int = 3000, longest: int = 20_000_000) -> LanguageModel | None:
    """Train on the whole texts of a bounded sample of rows outside the held-out fold.

    Bounds: ``sample`` rows in expectation and twice that at most, of which each language has its share
    of ``longest`` characters: rows in hash order, those of over a sixteenth of the share last, as long as
    their lengths together are within it, and its first row in any case unless that alone is longer than
    ``longest``. So a very long text takes no other's place. Lengths choose the rows; only texts within
    the bounds are fetched.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("lang"), F.col("hash")]
    first = training_sample(docs, sample).dropDuplicates(["doc_id", "lang", "hash"]).orderBy(*order).limit(2 * sample)
    share = F.lit(float(longest)) / F.size(F.collect_set("lang").over(Window.partitionBy()))
    own = Window.partitionBy("lang").orderBy(F.col("n") > F.col("share") / 16, *order)  # over at most 2 * sample rows
    chosen = first.withColumn("share", share).withColumn("so_far", F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("k", F.row_number().over(own))
    chosen = chosen.where((F.col("so_far") <= F.col("share")) | (F.col("k") == 1) & (F.col("n") <= longest))
    chosen = chosen.select("doc_id", "lang", "hash", F.row_number().over(Window.orderBy(*order)).alias("at"))
    rows = docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("hash"))
    got = rows.join(F.broadcast(chosen), ["doc_id", "lang", "hash"]).select("text", "lang", "at").toPandas().drop_duplicates("at").sort_values("at")
    return train(got["text"].tolist(), got["lang"].tolist()) if len(got) else None


def identify(docs: DataFrame, sample: int = 3000, model: LanguageModel | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row.

    A null text, or one without a letter, is ``und`` with score 0; so is everything when no row can be
    learned from. ``rejected`` marks predictions below the calibrated floor. Only text decides:
    repeated rows and equal texts get equal predictions, ties of probability the first language in order,
    very long texts are read whole; other columns are not read, an empty table gives an empty one.
    """
    learned = model or fit(docs, sample)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(learned)  # 2**BITS rows of a few numbers at most

    def run(batches):
        m = shared.value
        for b in slices(batches):
            langs, scores, rejected = [], [], []
            for t in b.column(2).to_pylist():
                if m is None or not t or not has_letter(t):
                    langs.append("und"), scores.append(0.0), rejected.append(True)
                    continue
                p = m.probabilities(t)
                at = int(p.argmax())
                langs.append(m.langs[at]), scores.append(min(1.0, float(p[at]))), rejected.append(bool(p[at] < m.floor))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, type=pa.string()), pa.array(scores, type=pa.float64()), pa.array(rejected, type=pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
