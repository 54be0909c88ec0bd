"""Op 10: quality rules as boosted trees over document statistics."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenfold.llm import trees
from screenfold.llm.common import WordHashes, ngram_hashes, slices, words_of

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Statistics that the model sees, and the direction in which each may move the verdict (0: free).
FEATURES = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "distinct_share": 0,
    "upper_share": -1,
    "digit_share": 0,
    "mark_share": 0,
    "bare_bar_share": -1,
    "top_word_share": -1,
    "words_per_line": 0,
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_upper = re.compile(r"[A-ZÀ-ÖØ-Þ]").findall
_digit = re.compile(r"[0-9]").findall
_mark = re.compile(r"[.,;:!?]").findall


def statistics(text: str | None, hashes: WordHashes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The base counts of a whole text and the model's features; a null text is an empty one."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    h = hashes.of(words)
    repeats = 0
    if n >= 3:
        _, back, times = np.unique(ngram_hashes(h, 3), return_inverse=True, return_counts=True)
        first = np.concatenate([times[back] > 1, [False, False]])
        hit = first.copy()
        hit[1:] |= first[:-1]
        hit[2:] |= first[:-2]
        repeats = int(hit.sum())
    if n:
        distinct, counts = np.unique(h, return_counts=True)
        features = (
            np.log1p(n),
            chars / n,
            symbols / chars,
            dup_lines / len(lines),
            repeats / n,
            len(distinct) / n,
            len(_upper(text)) / chars,
            len(_digit(text)) / chars,
            len(_mark(text)) / n,
            words.count(b"|") / n,
            (counts.max() - 1) / n,
            n / len(lines),
        )
    else:
        features = (0.0,) * len(FEATURES)
    return (n, chars, symbols, dup_lines, repeats), features


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_features: bool = True, model: trees.Forest | None = None) -> DataFrame:
    """(id, base counts[, features][, score]) of every row in one pass, without a shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in BASE)
    schema += ", " + ", ".join(f"{c} double" for c in FEATURES) if with_features else ""
    schema += ", score double" if model is not None else ""

    def run(batches):
        hashes = WordHashes()
        for b in slices(batches):
            got = [statistics(t, hashes) for t in b.column(1).to_pylist()]
            base = np.array([g[0] for g in got], dtype=np.int64).reshape(len(got), len(BASE))
            x = np.array([g[1] for g in got], dtype=np.float64).reshape(len(got), len(FEATURES))
            columns = {"id": b.column(0)} | {c: pa.array(base[:, i]) for i, c in enumerate(BASE)}
            if with_features:
                columns |= {c: pa.array(x[:, i]) for i, c in enumerate(FEATURES)}
            if model is not None:
                columns["score"] = pa.array(model.predict(x))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, keep_rate: float = 0.998) -> tuple[trees.Forest, float]:
    """Fit on at most ``sample`` labelled documents (the first by a hash of their id; each fits in a
    few hundred bytes of statistics), and set the threshold so that at least ``keep_rate`` of the good
    documents of the held-out quarter pass, and never above one half.

    Labels with a null id or quality are left out. Without labels of both kinds everything passes.
    """
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` rows of 16 bytes
    found = docs.select("doc_id", "text").join(F.broadcast(rows.select(F.col("doc_id").alias("doc_id"))), "doc_id", "left_semi")
    first = F.min(F.struct(*FEATURES)).alias("x")  # a repeated id counts once, with its least statistics
    got = document_statistics(found).groupBy("doc_id").agg(first).join(F.broadcast(rows), "doc_id").select("doc_id", "x.*", "quality").toPandas()
    got = got.sort_values("doc_id")
    x, y = got[list(FEATURES)].to_numpy(np.float64), got["quality"].to_numpy(np.float64)
    if len(set(y)) < 2:
        return trees.fit(np.zeros((0, len(FEATURES))), np.ones(0), list(FEATURES.values()), trees=0), 0.0
    order = np.random.default_rng(7).permutation(len(x))
    held, seen = order[: len(x) // 4], order[len(x) // 4 :]
    model = trees.fit(x[seen], y[seen], list(FEATURES.values()))
    good = np.sort(model.predict(x[held][y[held] == 1]))
    cut = good[int((1 - keep_rate) * len(good))] if len(good) else 0.5
    return model, float(min(0.5, cut))


def judge(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """(doc_id, base counts, base_failed, score, kept) of every document.

    A null or empty text has no words and fails; repeated rows get the same verdict; very long texts
    are read whole; other columns are not read; an empty table gives an empty one.
    """
    model, threshold = train(docs, labels, sample)
    out = document_statistics(docs, with_features=False, model=model).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """Rows of ``docs`` that ``judge`` keeps, with all their columns, in one pass without a join.

    Null and empty texts go, as they fail; repeated rows and null ids go or stay with their text; a
    very long text is read whole; ties cannot arise, as a row's own text decides. An empty table gives an empty one.
    """
    model, threshold = train(docs, labels, sample)
    at = docs.columns.index("text")

    def run(batches):
        hashes = WordHashes()
        for b in slices(batches):
            got = [statistics(t, hashes) for t in b.column(at).to_pylist()]
            x = np.array([g[1] for g in got], dtype=np.float64).reshape(len(got), len(FEATURES))
            base = np.array([g[0] for g in got], dtype=np.int64).reshape(len(got), len(BASE))
            ok = (base[:, 0] >= 50) & (100 * base[:, 4] <= 50 * base[:, 0]) & (model.predict(x) >= threshold)
            yield b.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)
