"""Counting of tags in sequencing reads.

A tag table is (ord, gene, tag) in file order, a read table (lane, read_no, seq), a sheet
(sample_id, lane, index_seq). Tags are found by an equi-join on their first bases, so a prefix test
never becomes a nested loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenfold.operators import tagindex

PREFIX = 10
BASES = ("G", "C", "A", "T", "N")


def exact_tags(decode: DataFrame) -> DataFrame:
    """(tag, gene): of equal tags the last in the file counts."""
    return decode.groupBy("tag").agg(F.max_by("gene", "ord").alias("gene"))


def variants(decode: DataFrame) -> DataFrame:
    """(variant, ord, gene): every tag with one base substituted, the tag itself among them."""
    at = decode.withColumn("p", F.explode(F.sequence(F.lit(1), F.length("tag")))).withColumn("b", F.explode(F.array(*map(F.lit, BASES))))
    return at.select("ord", "gene", F.expr("concat(substr(tag, 1, p - 1), b, substr(tag, p + 1))").alias("variant")).distinct()


def fuzzy_tags(decode: DataFrame, strict: bool = False) -> DataFrame:
    """(variant, gene): of equal variants the first in the file counts; ``strict`` drops those of
    several genes."""
    v = variants(decode)
    got = v.groupBy("variant").agg(F.min_by("gene", "ord").alias("gene"), F.countDistinct("gene").alias("genes"))
    return (got.where("genes = 1") if strict else got).select("variant", "gene")


def collisions(decode: DataFrame) -> DataFrame:
    """(sequence, genes): variants that more than one gene reaches."""
    got = variants(decode).groupBy("variant").agg(F.array_sort(F.collect_set("gene")).alias("g"))
    return got.where(F.size("g") > 1).select(F.col("variant").alias("sequence"), F.array_join(F.transform("g", lambda x: x.cast("string")), ",").alias("genes"))


def demultiplex(reads: DataFrame, sheet: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds sample_id: the sample of the lane whose index is the longest that starts the read.

    One equi-join for each index length. An empty index takes every read of a lane that has no other.
    """
    keyed = sheet.withColumn("k", F.length("index_seq"))
    found = None
    for n in sorted(lengths, reverse=True):
        part = keyed.where(F.col("k") == n).select(F.col("lane").alias("l"), F.col("index_seq").alias("i"), F.col("sample_id").alias(f"s{n}"))
        base = reads if found is None else found
        found = base.join(part, (F.col("lane") == F.col("l")) & (F.substring("seq", 1, n) == F.col("i")), "left").drop("l", "i")
    alone = keyed.groupBy("lane").agg(F.max("k").alias("m"), F.max("sample_id").alias("s0")).where("m = 0").select(F.col("lane").alias("l"), "s0")
    found = found.join(alone, F.col("lane") == F.col("l"), "left").drop("l")
    names = [f"s{n}" for n in sorted(lengths, reverse=True)] + ["s0"]
    return found.withColumn("sample_id", F.coalesce(*names)).drop(*names)


def longest(tags: DataFrame, column: str = "tag") -> int:
    """Bases of the longest tag: what has to be carried of a read from an offset on."""
    return tags.agg(F.max(F.length(column))).first()[0] or 0


def exact_match(reads: DataFrame, tags: DataFrame, offset: int) -> DataFrame:
    """(lane, read_no, gene) of reads with a tag at the offset; of several the shortest."""
    t = tags.select("tag", "gene", F.substring("tag", 1, PREFIX).alias("k"))
    rest = reads.select("lane", "read_no", F.expr(f"substr(seq, {offset + 1}, {longest(tags)})").alias("rest")).withColumn("k", F.substring("rest", 1, PREFIX))
    hit = rest.join(t, "k").where(F.col("rest").startswith(F.col("tag")))
    return hit.groupBy("lane", "read_no").agg(F.min_by("gene", F.length("tag")).alias("gene"))


def fuzzy_match(reads: DataFrame, fuzzy: DataFrame, offset: int, before: int = 3, after: int = 2) -> DataFrame:
    """(lane, read_no, gene): the first offset of the window with a variant, there the shortest."""
    low, high = max(0, offset - before), max(0, offset + after)
    t = fuzzy.select(F.col("variant").alias("tag"), "gene", F.substring("variant", 1, PREFIX).alias("k"))
    rest = reads.select("lane", "read_no", "seq", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("off"))
    rest = rest.select("lane", "read_no", "off", F.expr(f"substr(seq, off + 1, {longest(fuzzy, 'variant')})").alias("rest")).withColumn("k", F.substring("rest", 1, PREFIX))
    hit = rest.join(t, "k").where(F.col("rest").startswith(F.col("tag")))
    best = F.min(F.struct("off", F.length("tag").alias("n"), "gene"))
    return hit.groupBy("lane", "read_no").agg(best.alias("b")).select("lane", "read_no", F.col("b.gene").alias("gene"))


def match_reads(reads: DataFrame, sheet: DataFrame, lengths: list[int], decode: DataFrame, offset: int, strict: bool = False, before: int = 3, after: int = 2) -> DataFrame:
    """(lane, read_no, sample_id, gene, kind) of every read: exact, fuzzy, unmatched, or no_index.

    A read's best hit is an exact one, there the shortest, else that of the first offset of the window, there the
    shortest. Reads meet plain tags block by block where they are (``tagindex``), no variant is written out;
    other tags, and all if ``strict``, are joined with their variants by the first ten bases.
    """
    low, high = max(0, offset - before), max(0, offset + after)
    tags = decode.where("tag IS NOT NULL")
    plain = F.lit(False) if strict else F.expr(tagindex.PLAIN)
    known = tags.agg(F.max(F.length("tag")).alias("longest"), F.count_if(~plain).alias("others"), F.count_if(plain).alias("plain")).first()
    width = max(high, offset) - low + max(known["longest"] or 0, tagindex.LONGEST)
    named = demultiplex(reads, sheet, lengths).select("lane", "read_no", "sample_id", F.when(F.col("sample_id").isNotNull(), F.expr(f"substr(seq, {low + 1}, {width})")).alias("rest"))
    kinds, parts = dict(decode.dtypes), []
    if known["plain"]:
        own = tags.where(plain).groupBy("tag").agg(F.min("ord").alias("o"), F.min_by("gene", "ord").alias("first"), F.max_by("gene", "ord").alias("last"))
        for block in tagindex.blocks(tagindex.packed(own, "o", "first", "last")):
            parts.append(tagindex.best_hits(named, block, offset - low, high - low + 1, kinds["ord"], kinds["gene"], every=not parts))
    if known["others"]:
        parts.append(_joined_hits(named, tags.where(~plain), offset, low, high, known["longest"], strict))
    if not known["plain"]:
        parts.append(named.select("lane", "read_no", "sample_id", F.lit(None).cast("long").alias("code"), F.lit(None).cast(kinds["ord"]).alias("o"), F.lit(None).cast(kinds["gene"]).alias("gene")))
    hit = parts[0]
    for part in parts[1:]:
        hit = hit.unionByName(part)
    best = F.min(F.when(F.col("code").isNotNull(), F.struct("code", "o", "gene")))
    got = hit.repartition("lane", "read_no").groupBy("lane", "read_no").agg(F.max("sample_id").alias("sample_id"), best.alias("b"))
    exact = F.col("b.code") < tagindex.coded(1, 0, 0)
    kind = F.when(F.col("sample_id").isNull(), "no_index").when(exact, "exact").when(F.col("b").isNotNull(), "fuzzy").otherwise("unmatched")
    return got.select("lane", "read_no", "sample_id", F.col("b.gene").alias("gene"), kind.alias("kind"))


def _joined_hits(named: DataFrame, tags: DataFrame, offset: int, low: int, high: int, longest: int, strict: bool) -> DataFrame:
    """(lane, read_no, sample_id, code, o, gene) of (..., rest), which begins at ``low``: hits by a join of tags and variants."""
    fuzzy = variants(tags).groupBy("variant").agg(F.min_by("gene", "ord").alias("gene"), F.min("ord").alias("o"), F.countDistinct("gene").alias("genes"))
    fuzzy = (fuzzy.where("genes = 1") if strict else fuzzy).select(F.col("variant").alias("tag"), "o", "gene", F.lit(1).alias("rank"))
    exact = tags.groupBy("tag").agg(F.min("ord").alias("o"), F.max_by("gene", "ord").alias("gene")).withColumn("rank", F.lit(0))
    every = exact.unionByName(fuzzy).withColumn("k", F.substring("tag", 1, PREFIX))
    at = named.where("sample_id IS NOT NULL").withColumn("off", F.explode(F.array(*map(F.lit, sorted({*range(low, high + 1), offset})))))
    at = at.select("lane", "read_no", "sample_id", "off", F.expr(f"substr(rest, off - {low} + 1, {longest})").alias("rest")).withColumn("k", F.substring("rest", 1, PREFIX))
    there = ((F.col("rank") == 0) & (F.col("off") == offset)) | ((F.col("rank") == 1) & F.col("off").between(low, high))
    hit = at.join(every, "k").where(F.col("rest").startswith(F.col("tag")) & there)
    code = F.shiftleft(F.col("rank").cast("long"), 40) + F.shiftleft((F.col("off") - low).cast("long"), 20) + F.length("tag")
    return hit.select("lane", "read_no", "sample_id", code.alias("code"), "o", "gene")


def count_genes(matched: DataFrame) -> DataFrame:
    return matched.where("gene is not null").groupBy("sample_id", "gene", "kind").agg(F.count("*").alias("n"))


def quality_counters(matched: DataFrame, by: tuple[str, ...] = ("lane",)) -> DataFrame:
    kind = lambda k: F.count_if(F.col("kind") == k)
    return matched.groupBy(*by).agg(F.count("*").alias("total_reads"), kind("no_index").alias("no_index_match"), F.count_if(F.col("kind") != "no_index").alias("index_matched"), kind("exact").alias("exact_hits"), kind("fuzzy").alias("fuzzy_hits"), kind("unmatched").alias("unmatched"))


def offset_scan(reads: DataFrame, tags: DataFrame, max_offset: int = 45) -> DataFrame:
    """(offset, hits): reads in which some tag starts at the offset.

    A tag that another starts adds nothing. Of the plain tags that are left one at most starts at a place, so
    their blocks' counts add up (``tagindex``), and no read is sent anywhere. Other tags are joined by
    their first ten bases.
    """
    every, parts = tags.where("tag IS NOT NULL").select("tag").distinct(), []
    known = every.agg(F.max(F.length("tag")).alias("longest"), F.count_if(~F.expr(tagindex.PLAIN)).alias("others")).first()
    alone = tagindex.unstarted(every)
    for block in tagindex.blocks(tagindex.packed(alone)):
        parts.append(tagindex.count_starts(reads, block, max_offset + 1))
    if known["others"] or not parts:
        own = every.where(~F.expr(tagindex.PLAIN)).groupBy(F.substring("tag", 1, PREFIX).alias("k")).agg(F.collect_list("tag").alias("tags"))
        own = own.join(alone.groupBy(F.substring("tag", 1, PREFIX).alias("k")).agg(F.collect_list("tag").alias("plain")), "k", "left")
        at = reads.select("seq", F.explode(F.sequence(F.lit(0), F.lit(max_offset))).alias("offset"))
        at = at.select("offset", F.expr(f"substr(seq, offset + 1, {known['longest'] or 0})").alias("rest")).withColumn("k", F.substring("rest", 1, PREFIX))
        starts = lambda c: F.exists(c, lambda x: F.col("rest").startswith(x))
        parts.append(at.join(own, "k").where(starts("tags") & ~F.coalesce(starts("plain"), F.lit(False))).groupBy("offset").agg(F.count("*").alias("hits")))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    return hits.groupBy("offset").agg(F.sum("hits").alias("hits")).where("hits > 0")


def best_offset(scan: DataFrame) -> DataFrame:
    return scan.orderBy(F.desc("hits"), "offset").limit(1)
