"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from screenfold.llm import jaccard, language, lm_scores, mixing, negatives, packing, pages, pieces, quality, secrets, token_counts, vectors, whitening
from screenfold.llm.common import table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: the first with the base rules alone, the second with all, which scans only what its ledger lacks."""
    docs = table(spark, sf_dir, "documents")
    _, ledger = secrets.scan_versions(docs, rules=tuple(r for r in secrets.RULES if r.base))
    findings, _ = secrets.scan_versions(docs, ledger)
    return secrets.report(findings)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_classes(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_TOKENIZER)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"
    return negatives.mine(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_pieces, op2_pages, op3_token_counts, op4_lm_scores, op5_language, op6_vectors, op7_secrets, op8_mixing, op9_jaccard, op10_quality, op11_whitening, op12_packing, op13_negatives)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": mixing.SQL, "op13_negatives": negatives.SQL}
