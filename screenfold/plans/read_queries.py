"""Queries that count tags in reads made from keys of the shared tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from screenfold.operators import reads as R
from screenfold.plans.bindings import table
from screenfold.plans.registry import query
from screenfold.plans.session import stash

OFFSET, LENGTHS = 28, [6, 8, 10]


def dna(x: str) -> str:
    return f"translate(md5(CAST({x} AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


_KEY = "CASE WHEN {p} % 50 = 1 THEN {p} + 1 ELSE {p} END"
_K = _KEY.format(p="p_partkey")
#: One tag in fifty starts another, one in fifty is the same as the next part's.
TAG = f"CASE WHEN p_partkey % 50 = 0 THEN substr({dna('p_partkey + 2')}, 1, 10) ELSE substr({dna(_K)}, 1, CAST(10 + ({_K}) % 13 AS INT)) END"
_INDEX = f"CASE WHEN l_orderkey % 23 = 0 THEN 'NNNNNNNNNN' ELSE substr({dna('10 + l_linenumber % 3')}, 1, 10) END"
_CONST = f"substr({dna('l_orderkey')}, 1, CASE WHEN l_orderkey % 13 = 0 THEN 16 ELSE 18 END)"
_MUTATED = "CASE WHEN l_orderkey % 17 = 0 THEN concat(substr(tag, 1, 4), 'N', substr(tag, 6)) ELSE tag END"
SEQ = f"concat({_INDEX}, {_CONST}, {_MUTATED}, {dna('l_orderkey * 8 + l_linenumber')})"

TAGS = f"decode AS (SELECT p_partkey AS ord, p_partkey AS gene, {TAG} AS tag FROM part)"
READS = f"{TAGS}, reads AS (SELECT DISTINCT l_returnflag AS lane, ((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 8 + l_linenumber AS read_no, {SEQ} AS seq FROM lineitem JOIN decode ON l_partkey = gene)"
SHEET = f"sheet AS (SELECT lane || '_' || k AS sample_id, lane, substr({dna('10 + k')}, 1, CAST(10 - 2 * k AS INT)) AS index_seq FROM (SELECT DISTINCT l_returnflag AS lane, l_linenumber % 3 AS k FROM lineitem))"
EXACT = "xt AS (SELECT tag, arg_max(gene, ord) AS gene FROM decode GROUP BY tag)"
VARS = "vr AS (SELECT DISTINCT ord, gene, concat(substr(tag, 1, p - 1), b, substr(tag, p + 1)) AS variant FROM (SELECT *, unnest(generate_series(1, length(tag))) AS p FROM decode) CROSS JOIN (SELECT unnest(['G', 'C', 'A', 'T', 'N']) AS b)), fz AS (SELECT variant, arg_min(gene, ord) AS gene, count(DISTINCT gene) AS genes FROM vr GROUP BY variant)"
DEMUX = f"{READS}, {SHEET}, dm AS (SELECT r.lane, r.read_no, any_value(r.seq) AS seq, arg_max(s.sample_id, length(s.index_seq)) AS sample_id FROM reads r LEFT JOIN sheet s ON r.lane = s.lane AND starts_with(r.seq, s.index_seq) GROUP BY r.lane, r.read_no)"
MATCH = f"""{DEMUX}, {EXACT}, {VARS},
em AS (SELECT lane, read_no, arg_min(gene, length(tag)) AS gene FROM dm JOIN xt ON substr(seq, {OFFSET + 1}, 10) = substr(tag, 1, 10) AND starts_with(substr(seq, {OFFSET + 1}), tag) WHERE sample_id IS NOT NULL GROUP BY ALL),
lf AS (SELECT *, unnest(generate_series({OFFSET - 3}, {OFFSET + 2})) AS off FROM dm ANTI JOIN em ON dm.lane = em.lane AND dm.read_no = em.read_no WHERE sample_id IS NOT NULL),
fm AS (SELECT lane, read_no, min(struct_pack(o := off, n := length(variant), g := gene)).g AS gene FROM lf JOIN fz ON substr(seq, off + 1, 10) = substr(variant, 1, 10) AND starts_with(substr(seq, off + 1), variant) GROUP BY ALL),
mt AS (SELECT dm.lane, dm.read_no, dm.sample_id, coalesce(em.gene, fm.gene) AS gene, CASE WHEN sample_id IS NULL THEN 'no_index' WHEN em.gene IS NOT NULL THEN 'exact' WHEN fm.gene IS NOT NULL THEN 'fuzzy' ELSE 'unmatched' END AS kind
  FROM dm LEFT JOIN em ON dm.lane = em.lane AND dm.read_no = em.read_no LEFT JOIN fm ON dm.lane = fm.lane AND dm.read_no = fm.read_no)"""


def decode(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("gene"), F.expr(TAG).alias("tag"))


def drawn(spark, sf):
    """(lane, read_no, seq) of every row, and what the sequence is made of."""
    rows = table(spark, sf, "lineitem").join(decode(spark, sf), F.col("l_partkey") == F.col("gene"))
    rows = rows.select(F.col("l_returnflag").alias("lane"), F.expr("((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 8 + l_linenumber").alias("read_no"), "l_orderkey", "l_linenumber", F.expr(_MUTATED).alias("mutated"))
    return rows, F.expr(SEQ.replace(_MUTATED, "mutated")).alias("seq")


def reads(spark, sf):
    """Distinct by what a sequence is made of, which is a third of its length."""
    rows, seq = drawn(spark, sf)
    return rows.distinct().select("lane", "read_no", seq)


def sheet(spark, sf):
    lanes = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("lane"), (F.col("l_linenumber") % 3).alias("k")).distinct()
    return lanes.select(F.expr("concat(lane, '_', k)").alias("sample_id"), "lane", F.expr(f"substr({dna('10 + k')}, 1, CAST(10 - 2 * k AS INT))").alias("index_seq"))


def matched(spark, sf):
    rows, seq = drawn(spark, sf)  # match_reads has one row a read, whatever comes twice
    return R.match_reads(rows.select("lane", "read_no", seq), stash(sheet(spark, sf), "sheet"), LENGTHS, decode(spark, sf), OFFSET)


@query("c01_exact_tags", f"WITH {TAGS}, {EXACT} SELECT tag, gene FROM xt")
def c01(spark, sf):
    return R.exact_tags(decode(spark, sf))


@query("c02_fuzzy_tags", f"WITH {TAGS}, {VARS} SELECT variant, gene FROM fz")
def c02(spark, sf):
    return R.fuzzy_tags(decode(spark, sf))


@query("c03_collisions", f"WITH {TAGS}, {VARS} SELECT variant AS sequence, array_to_string(list_sort(list(DISTINCT gene)), ',') AS genes FROM vr GROUP BY variant HAVING count(DISTINCT gene) > 1")
def c03(spark, sf):
    return R.collisions(decode(spark, sf))


@query("c04_strict", f"WITH {TAGS}, {VARS} SELECT variant, gene FROM fz WHERE genes = 1")
def c04(spark, sf):
    return R.fuzzy_tags(decode(spark, sf), strict=True)


@query("c05_prefix_index", f"WITH {TAGS} SELECT substr(tag, 1, 10) AS prefix, CAST(count(*) AS BIGINT) AS tags, array_to_string(list_sort(list(DISTINCT length(tag))), ',') AS lengths FROM decode GROUP BY ALL")
def c05(spark, sf):
    got = decode(spark, sf).groupBy(F.substring("tag", 1, 10).alias("prefix")).agg(F.count("*").alias("tags"), F.array_sort(F.collect_set(F.length("tag"))).alias("l"))
    return got.select("prefix", "tags", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("lengths"))


@query("c06_demux", f"WITH {DEMUX} SELECT lane, read_no, sample_id FROM dm")
def c06(spark, sf):
    return R.demultiplex(reads(spark, sf), sheet(spark, sf), LENGTHS).select("lane", "read_no", "sample_id")


@query("c07_exact_match", f"WITH {MATCH} SELECT lane, read_no, gene FROM em")
def c07(spark, sf):
    named = R.demultiplex(reads(spark, sf), sheet(spark, sf), LENGTHS).where("sample_id is not null")
    return R.exact_match(named, R.exact_tags(decode(spark, sf)), OFFSET)


@query("c08_fuzzy_match", f"WITH {MATCH} SELECT lane, read_no, gene FROM fm")
def c08(spark, sf):
    return matched(spark, sf).where("kind = 'fuzzy'").select("lane", "read_no", "gene")


@query("c10_counts", f"WITH {MATCH} SELECT sample_id, gene, kind, CAST(count(*) AS BIGINT) AS n FROM mt WHERE gene IS NOT NULL GROUP BY ALL")
def c10(spark, sf):
    return R.count_genes(matched(spark, sf))


_QC = "CAST(count(*) AS BIGINT) AS total_reads, CAST(count(*) FILTER (kind = 'no_index') AS BIGINT) AS no_index_match, CAST(count(*) FILTER (kind <> 'no_index') AS BIGINT) AS index_matched, CAST(count(*) FILTER (kind = 'exact') AS BIGINT) AS exact_hits, CAST(count(*) FILTER (kind = 'fuzzy') AS BIGINT) AS fuzzy_hits, CAST(count(*) FILTER (kind = 'unmatched') AS BIGINT) AS unmatched"


@query("c11_qc", f"WITH {MATCH} SELECT lane, {_QC} FROM mt GROUP BY lane")
def c11(spark, sf):
    return R.quality_counters(matched(spark, sf))


@query("c13_qc_all_lanes", f"WITH {MATCH} SELECT {_QC} FROM mt")
def c13(spark, sf):
    return R.quality_counters(matched(spark, sf), ())


@query("c15_merged", f"WITH {MATCH} SELECT sample_id, gene, CAST(count(*) AS BIGINT) AS n FROM mt WHERE gene IS NOT NULL GROUP BY ALL")
def c15(spark, sf):
    return R.count_genes(matched(spark, sf)).groupBy("sample_id", "gene").agg(F.sum("n").alias("n"))


SCAN = f"{READS}, tk AS (SELECT substr(tag, 1, 10) AS k, list(DISTINCT tag) AS ts FROM decode GROUP BY 1), sc AS (SELECT o AS \"offset\", CAST(count(*) AS BIGINT) AS hits FROM (SELECT seq, unnest(generate_series(0, 45)) AS o FROM reads) x JOIN tk ON substr(seq, o + 1, 10) = k WHERE len(list_filter(ts, lambda t: starts_with(substr(seq, o + 1), t))) > 0 GROUP BY 1)"


def scanned(spark, sf):
    return R.offset_scan(reads(spark, sf), decode(spark, sf))


@query("c17_offset_scan", f'WITH {SCAN} SELECT CAST("offset" AS INTEGER) AS "offset", hits FROM sc')
def c17(spark, sf):
    return scanned(spark, sf)


@query("c18_best_offset", f'WITH {SCAN} SELECT CAST("offset" AS INTEGER) AS "offset", hits FROM sc ORDER BY hits DESC, "offset" LIMIT 1')
def c18(spark, sf):
    return R.best_offset(scanned(spark, sf))


@query("c19_prefix_topk", f"""WITH {READS}, p AS (SELECT n, substr(seq, 1, n) AS prefix, CAST(count(*) AS BIGINT) AS hits FROM reads, (SELECT unnest([6, 8, 10, 12]) AS n) k WHERE length(seq) >= n GROUP BY ALL)
SELECT CAST(n AS INTEGER) AS n, prefix, hits FROM p QUALIFY row_number() OVER (PARTITION BY n ORDER BY hits DESC, prefix) <= 5""")
def c19(spark, sf):
    p = reads(spark, sf).withColumn("n", F.explode(F.array(*map(F.lit, (6, 8, 10, 12))))).where("length(seq) >= n").groupBy("n", F.expr("substr(seq, 1, n)").alias("prefix")).agg(F.count("*").alias("hits"))
    return p.withColumn("k", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("hits"), "prefix"))).where("k <= 5").select("n", "prefix", "hits")


@query("c20_read_length", f"WITH {READS} SELECT CAST(length(seq) AS INTEGER) AS len, CAST(count(*) AS BIGINT) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM reads GROUP BY length(seq) QUALIFY row_number() OVER (ORDER BY count(*) DESC, length(seq)) <= 5")
def c20(spark, sf):
    k = reads(spark, sf).groupBy(F.length("seq").alias("len")).agg(F.count("*").alias("n"))
    k = k.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
    return k.withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "len"))).where("k <= 5").drop("k")
