"""Running counts of tags while lanes arrive, as a streaming aggregate.

Counts are sums over reads, so lanes may come in any order and in any pieces; each trigger's result is
what a batch over the reads so far would give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenfold.operators.reads import PREFIX


def running_counts(reads: DataFrame, index: DataFrame, tags: DataFrame, offset: int) -> DataFrame:
    """(sample_id, gene, n) of a stream (lane, seq) with indexes of one length and exact tags.

    ``index`` is (lane, index_seq, sample_id), ``tags`` (tag, gene) without a tag that starts another:
    both are static tables, so each trigger is two joins on equal keys and one update of counts.
    """
    n = index.agg(F.max(F.length("index_seq")).alias("n")).first()["n"] or 0
    sheet = index.select("lane", F.col("index_seq").alias("i"), "sample_id")
    known = tags.select("tag", "gene", F.substring("tag", 1, PREFIX).alias("k"))
    rows = reads.withColumn("i", F.substring("seq", 1, n)).join(sheet, ["lane", "i"]).withColumn("rest", F.expr(f"substr(seq, {offset + 1})")).withColumn("k", F.substring("rest", 1, PREFIX))
    return rows.join(known, "k").where(F.col("rest").startswith(F.col("tag"))).groupBy("sample_id", "gene").agg(F.count("*").alias("n"))
