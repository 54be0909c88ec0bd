"""Gene lists from effects in many strains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenfold.operators.scan import numbered


def effects(scores: DataFrame, score: str, least: float, fdr: str | None = None, alpha: float = 0.05) -> DataFrame:
    """Adds deleterious, beneficial and any_effect; missing scores and rates are no effect."""
    ok = F.col(fdr) < alpha if fdr else F.lit(True)
    down = F.coalesce(ok & (F.col(score) <= -least), F.lit(False))
    up = F.coalesce(ok & (F.col(score) >= least), F.lit(False))
    return scores.withColumns({"deleterious": down, "beneficial": up, "any_effect": down | up})


def strain_counts(e: DataFrame) -> DataFrame:
    return e.groupBy("gene").agg(F.count_if(F.col("deleterious")).alias("n_del"), F.count_if(F.col("beneficial")).alias("n_ben"))


def common(e: DataFrame, effect: str, least: int) -> DataFrame:
    """Genes with the effect in at least so many strains."""
    return e.groupBy("gene").agg(F.count_if(F.col(effect)).alias("n_strains")).where(F.col("n_strains") >= least)


def specific(e: DataFrame, effect: str, max_others: int, rule: str = "same") -> DataFrame:
    """Genes with the effect in a strain and in few others; ``any`` counts either effect there."""
    other = F.col(effect if rule == "same" else "any_effect")
    others = F.count_if(other).over(Window.partitionBy("gene")) - other.cast("int")
    return e.withColumn("others", others).where(F.col(effect) & (F.col("others") <= max_others))


def beneficial_cluster(e: DataFrame, least: int, lab: Column) -> DataFrame:
    got = e.groupBy("gene").agg(F.count_if(F.col("beneficial")).alias("n_strains"), F.bool_or(F.col("beneficial") & lab).alias("in_lab"))
    return got.where((F.col("n_strains") >= least) & ~F.col("in_lab")).select("gene", "n_strains")


def ragged(rows: DataFrame, gene: str, strain: str, strains: list) -> DataFrame:
    """One column of genes for each strain, filled from the top; repeated rows take a place each."""
    k = numbered(rows.select(strain, gene), [F.col(gene)], "rn", [strain])
    return k.groupBy("rn").pivot(strain, strains).agg(F.max(gene))


def measured_at_start(values: DataFrame, gene: str, strain: str, gen: str, value: str, above: float) -> DataFrame:
    """Genes above the level in every start replicate of at least one strain."""
    per = values.where(F.col(gen) == 0).groupBy(gene, strain).agg(F.every(F.col(value) > above).alias("ok"))
    return per.groupBy(gene).agg(F.bool_or("ok").alias("ok")).where("ok").select(gene)


def backgrounds(e: DataFrame, common_genes: DataFrame) -> DataFrame:
    """(background, strain, gene): genes with any effect but not common (strain -1), and per strain
    those measured without effect."""
    some = e.where("any_effect").select("gene").distinct().join(common_genes, "gene", "left_anti")
    none = e.where("fc is not null and not any_effect")
    return some.select(F.lit("any_minus_common").alias("background"), F.lit(-1).alias("strain"), "gene").unionByName(none.select(F.lit("no_effect").alias("background"), "strain", "gene"))


def outer_provenance(ours: DataFrame, theirs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, ours, theirs, source): both tables side by side, and which of them has the key."""
    a, b = ours.select(F.col(key), F.col(value).alias("ours"), F.lit(True).alias("_a")), theirs.select(F.col(key), F.col(value).alias("theirs"), F.lit(True).alias("_b"))
    both = a.join(b, key, "full_outer")
    return both.select(key, "ours", "theirs", F.when(F.col("_b").isNull(), "ours").when(F.col("_a").isNull(), "theirs").otherwise("both").alias("source"))


def jaccard(prov: DataFrame) -> DataFrame:
    shared = F.count_if(F.col("source") == "both")
    return prov.agg(F.count_if(F.col("source") != "theirs").alias("n_ours"), F.count_if(F.col("source") != "ours").alias("n_theirs"), shared.alias("shared"), F.round(F.try_divide(shared.cast("double"), F.count("*")), 6).alias("jaccard"))
