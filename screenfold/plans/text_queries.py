"""Queries of parsers and text functions over text made from the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenfold.functions import text as T
from screenfold.plans.bindings import table
from screenfold.plans.registry import query
from screenfold.sources import files as S

#: The three longest-written records of each document, as lines of a file a source.
LINES = """ln AS (SELECT source AS file, doc_id * 10 + p - 1 AS line_no, v[CAST(p AS INT)] AS value FROM
(SELECT doc_id, source, {arr} AS v, unnest(generate_series(1, {k})) AS p FROM documents))"""


def _lines(spark, sf, parts: list[str]):
    arr = "array(" + ", ".join(parts) + ")"
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("file"), F.posexplode(F.expr(arr)).alias("p", "value"))
    return d.select("file", (F.col("doc_id") * 10 + F.col("p")).cast("long").alias("line_no"), "value")


def _sql(parts: list[str]) -> str:
    return LINES.format(arr="[" + ", ".join(parts) + "]", k=len(parts))


W1, W2 = "translate(text, concat(chr(10), chr(13)), '  ')", "concat('source ', source)"
SOFT = ["concat('^SAMPLE = GSM', CAST(doc_id AS STRING))", f"concat('!Sample_title = ', {W1})", "concat('!Sample_lang = ', lang)", f"concat('!Sample_title = ', {W2})"]
BLK = "count(*) FILTER (starts_with(value, '{p}')) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("s10_soft", f"""WITH {_sql(SOFT)}, b AS (SELECT *, {BLK.format(p='^SAMPLE')} AS record FROM ln), n AS (SELECT *, max(CASE WHEN starts_with(value, '^') THEN regexp_extract(value, '= (.*)$', 1) END) OVER (PARTITION BY file, record) AS name, regexp_extract(value, '^!Sample_(\\S+) = ', 1) AS key FROM b)
SELECT file, CAST(record AS BIGINT) AS record, name, key, string_agg(regexp_extract(value, '^!\\S+ = (.*)$', 1), '; ' ORDER BY line_no) AS value FROM n WHERE key <> '' GROUP BY ALL""")
def s10(spark, sf):
    return S.soft_records(_lines(spark, sf, SOFT))


FASTA = ["concat('>sp|D', CAST(doc_id AS STRING), '|', lang, ' x')", "upper(substr(md5(CAST(doc_id AS STRING)), 1, 20))", "concat(upper(substr(md5(CAST(doc_id + 1 AS STRING)), 1, 9)), '*')"]


@query("s13_fasta", f"WITH {_sql(FASTA)}, b AS (SELECT *, {BLK.format(p='>')} AS record FROM ln) SELECT file, CAST(record AS BIGINT) AS record, max(CASE WHEN starts_with(value, '>') THEN regexp_extract(value, '^>(\\S+)', 1) END) AS name, regexp_replace(string_agg(CASE WHEN NOT starts_with(value, '>') THEN value END, '' ORDER BY line_no), '\\*+$', '') AS sequence FROM b GROUP BY file, record")
def s13(spark, sf):
    return S.fasta_records(_lines(spark, sf, FASTA))


@query("s15_accession", f"WITH {_sql(FASTA)} SELECT split_part(regexp_extract(value, '^>(\\S+)', 1), '|', 2) AS acc, CAST(count(*) AS BIGINT) AS n FROM ln WHERE starts_with(value, '>') GROUP BY 1")
def s15(spark, sf):
    return S.fasta_records(_lines(spark, sf, FASTA)).groupBy(S.accession(F.col("name")).alias("acc")).agg(F.count("*").alias("n"))


@query("a37_sequences", f"WITH {_sql(FASTA)}, s AS (SELECT regexp_extract(value, '^>sp\\|D([0-9])', 1) AS k FROM ln WHERE starts_with(value, '>')) SELECT k, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY k HAVING count(*) > 1")
def a37(spark, sf):
    got = S.fasta_records(_lines(spark, sf, FASTA)).select(F.regexp_extract("name", r"sp\|D([0-9])", 1).alias("k"))
    return got.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")


OBO = ["CASE WHEN doc_id % 4 = 0 THEN '[Typedef]' ELSE '[Term]' END", "concat('id: GO:', CAST(doc_id AS STRING))", f"concat('name: ', {W1})", f"concat('name: ', {W2})"]


@query("s12_obo", f"SELECT 'GO:' || CAST(doc_id AS VARCHAR) AS id, {W1} AS name FROM documents WHERE doc_id % 4 <> 0")
def s12(spark, sf):
    return S.obo_names(_lines(spark, sf, OBO))


_T = "chr(9)"
GAF = [f"CASE WHEN doc_id % 9 = 0 THEN '!comment' ELSE concat_ws({_T}, 'SGD', concat('S', CAST(doc_id AS STRING)), 'x', '', concat('GO:', CAST(doc_id % 50 AS STRING)), 'ref', CASE WHEN doc_id % 5 = 0 THEN 'ND' ELSE 'IDA' END, '', lang, 'n', concat('YAL', CAST(doc_id AS STRING), '|', source)) END", "'too short'"]


@query("s11_gaf", "SELECT 'S' || doc_id AS object_id, 'GO:' || (doc_id % 50) AS term, 'IDA' AS evidence, lang AS aspect, 'YAL' || doc_id || '|' || source AS synonyms FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 5 <> 0")
def s11(spark, sf):
    return S.gaf_rows(_lines(spark, sf, GAF))


PAIRS = [f"concat(source, {_T}, lang)", "concat('# ', lang)", f"concat(lang, {_T})"]


@query("s19_pairs", "SELECT source AS gene, 'cat:' || lang AS category, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY ALL")
def s19(spark, sf):
    return S.pair_rows(_lines(spark, sf, PAIRS), "cat:").groupBy("gene", "category").agg(F.count("*").alias("n"))


DEC = ["concat('Y', CAST(doc_id AS STRING), ' ', substr(md5(lang), 1, 10))", "concat('x Y', lang)", "concat('Y', lang)"]


@query("s06_decode", f"WITH {_sql(DEC)} SELECT line_no AS ord, split_part(value, ' ', 1) AS gene, split_part(value, ' ', 2) AS tag FROM ln WHERE starts_with(value, 'Y') AND contains(value, ' ')")
def s06(spark, sf):
    return S.decode_rows(_lines(spark, sf, DEC))


@query("s04_sheet_faults", "WITH s AS (SELECT source AS sample_id, CASE WHEN doc_id % 7 = 0 THEN 5 ELSE 10 END AS generation FROM documents) SELECT 'repeated sample_id' AS fault, sample_id AS value, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY sample_id HAVING count(*) > 1 UNION ALL SELECT 'generation not 0 or 10', CAST(generation AS VARCHAR), CAST(count(*) AS BIGINT) FROM s WHERE generation NOT IN (0, 10) GROUP BY generation")
def s04(spark, sf):
    return S.sheet_faults(table(spark, sf, "documents").select(F.col("source").alias("sample_id"), F.when(F.col("doc_id") % 7 == 0, 5).otherwise(10).alias("generation")))


@query("s24_numeric", "SELECT doc_id, try_cast(CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN CAST(n_chars AS VARCHAR) END AS DOUBLE) AS v FROM documents")
def s24(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, "NaN").otherwise(F.col("lang"))).when(F.col("doc_id") % 3 == 1, F.col("n_chars").cast("string")).alias("v"))
    return S.numeric(d, ["v"])


@query("s28_domain", "SELECT 'toxic' AS \"column\", CAST(count(*) FILTER (toxic * 2 NOT IN (0, 1)) AS BIGINT) AS n FROM labels HAVING count(*) FILTER (toxic * 2 NOT IN (0, 1)) > 0")
def s28(spark, sf):
    return S.domain_faults(table(spark, sf, "labels").select((F.col("toxic") * 2).alias("toxic"), "quality"), ["toxic", "quality"])


@query("x13_composition", "WITH s AS (SELECT doc_id, upper(md5(text)) AS q FROM documents) SELECT doc_id, CAST(length(q) AS INTEGER) AS length, round(100.0::DOUBLE * (length(q) - length(replace(q, 'A', ''))) / length(q), 6) AS pct_A, round(100.0::DOUBLE * (length(q) - length(replace(q, 'E', ''))) / length(q), 6) AS pct_E FROM s")
def x13(spark, sf):
    c = T.composition(F.col("q"))
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.upper(F.md5("text")), F.lit("*")).alias("q"))
    return d.select("doc_id", c["length"].alias("length"), F.round(c["pct_A"], 6).alias("pct_A"), F.round(c["pct_E"], 6).alias("pct_E"))


@query("x08_longest_sub", """WITH n AS (SELECT DISTINCT source AS v FROM documents), h AS (SELECT d.doc_id, arg_min(n.v, (-length(n.v), n.v)) AS found FROM documents d JOIN n ON contains(upper(d.source || d.lang), upper(n.v)) GROUP BY d.doc_id) SELECT d.doc_id, h.found FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id""")
def x08(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat("source", "lang").alias("t"), F.col("source").alias("v"))
    return T.longest_contained(d, "t", d.select("v").distinct(), "v", ["doc_id"])


_TITLE = "concat(lang, CASE doc_id % 6 WHEN 0 THEN ' gen 10 repA' WHEN 1 THEN '_T0_B' WHEN 2 THEN ' Generation0 replicate 2' WHEN 3 THEN ' final-3' WHEN 4 THEN ' baseline Rep C' ELSE ' none' END)"


@query("x09_case_regex", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 10 WHEN 2 THEN 0 WHEN 3 THEN 10 WHEN 4 THEN 0 END AS generation FROM documents")
def x09(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.generation(F.expr(_TITLE)).alias("generation"))


@query("x10_replicate", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN '2' WHEN 3 THEN '3' WHEN 4 THEN 'C' ELSE '' END AS replicate FROM documents")
def x10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.replicate(F.expr(_TITLE)).alias("replicate"))


@query("x11_clean_names", "SELECT doc_id, regexp_replace(source || 'A1-' || upper(lang), 'A1-[A-Z]+$', '') AS name FROM documents")
def x11(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.concat("source", F.lit("A1-"), F.upper("lang")), "A1-[A-Z]+$", "").alias("name"))


@query("x12_tokens", "SELECT doc_id, array_to_string(list_filter([lang, source, lang], lambda t: t IN ('en', 'de', 'src1')), ' ') AS tokens FROM documents")
def x12(spark, sf):
    vocabulary = F.array(*map(F.lit, ("en", "de", "src1")))
    return table(spark, sf, "documents").select("doc_id", T.known_tokens(F.concat("lang", F.lit("; "), "source", F.lit(" "), "lang"), vocabulary).alias("tokens"))


@query("x14_midpoint", "SELECT p_partkey, (least(CAST(p_size AS DOUBLE), p_retailprice) + greatest(CAST(p_size AS DOUBLE), p_retailprice)) / 2 AS mid FROM part")
def x14(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.midpoint(F.col("p_size"), F.col("p_retailprice")).alias("mid"))


@query("x15_suffix", "SELECT p_partkey, p_brand AS base FROM part")
def x15(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.clone_base(F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"))).otherwise(F.col("p_brand"))).alias("base"))


@query("x16_picker", "SELECT 'source' AS col, round(avg(CASE WHEN regexp_matches(source, '^src[0-9]+$') THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate FROM documents UNION ALL SELECT 'lang', round(avg(CASE WHEN regexp_matches(lang, '^src[0-9]+$') THEN 1.0::DOUBLE ELSE 0 END), 6) FROM documents")
def x16(spark, sf):
    d = table(spark, sf, "documents")
    return d.agg(*[F.round(F.avg(F.col(c).rlike("^src[0-9]+$").cast("double")), 6).alias(c) for c in ("source", "lang")]).unpivot([], ["source", "lang"], "col", "rate")


PICK = "h AS (SELECT * FROM documents ORDER BY doc_id LIMIT 500), r AS (SELECT unnest([1, 2, 3]) AS place, unnest(['lang', 'source', 'text']) AS col, unnest([(SELECT avg(CASE WHEN regexp_matches(lang, '^s[a-z]*[0-9]+$') THEN 1.0::DOUBLE ELSE 0 END) FROM h), (SELECT avg(CASE WHEN regexp_matches(source, '^s[a-z]*[0-9]+$') THEN 1.0::DOUBLE ELSE 0 END) FROM h), (SELECT avg(CASE WHEN regexp_matches(text, '^s[a-z]*[0-9]+$') THEN 1.0::DOUBLE ELSE 0 END) FROM h)]) AS rate)"


@query("x16_hit_rates", f"WITH {PICK} SELECT CAST(place AS BIGINT) AS place, col, round(rate, 6) AS rate FROM r")
def x16h(spark, sf):
    """How often the first 500 values of each column look like a name: the look at 500 rows is the feature."""
    return T.hit_rates(table(spark, sf, "documents"), "^s[a-z]*[0-9]+$", ["lang", "source", "text"], ["doc_id"]).select("place", "col", F.round("rate", 6).alias("rate"))


@query("x16_picked", f"WITH {PICK} SELECT col FROM (SELECT * FROM r ORDER BY rate DESC, place LIMIT 1) WHERE rate >= 0.5")
def x16k(spark, sf):
    return T.picked(T.hit_rates(table(spark, sf, "documents"), "^s[a-z]*[0-9]+$", ["lang", "source", "text"], ["doc_id"])).select("col")


@query("x17_list_build", "SELECT lang, string_agg(DISTINCT source, ';' ORDER BY source) AS sources FROM documents GROUP BY lang")
def x17(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ";").alias("sources"))


@query("x18_list_text", "WITH s AS (SELECT n_regionkey AS k, list_sort(list(n_name)) AS l FROM nation WHERE n_nationkey % (n_regionkey + 2) = 0 GROUP BY 1) SELECT k, CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' and ' || l[2] ELSE array_to_string(l[1:len(l) - 1], ', ') || ', and ' || l[len(l)] END AS txt FROM s")
def x18(spark, sf):
    s = table(spark, sf, "nation").where("n_nationkey % (n_regionkey + 2) = 0").groupBy(F.col("n_regionkey").alias("k")).agg(F.array_sort(F.collect_list("n_name")).alias("l"))
    return s.select("k", T.listed(F.col("l")).alias("txt"))


@query("x21_lookup_default", "SELECT n_nationkey, coalesce(r_name, 'Unknown') AS lineage FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 2")
def x21(spark, sf):
    r = table(spark, sf, "region").where("r_regionkey <> 2")
    return table(spark, sf, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", F.coalesce("r_name", F.lit("Unknown")).alias("lineage"))


@query("x22_trim_prefix", "SELECT doc_id, 'id:' || CAST(doc_id AS VARCHAR) || ':' || lang AS tag FROM documents")
def x22(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("id:"), F.col("doc_id").cast("string"), F.lit(":"), F.trim(F.concat(F.lit("  "), "lang", F.lit(" ")))).alias("tag"))


@query("x23_vocabulary", "SELECT DISTINCT v FROM (SELECT source AS v FROM documents UNION ALL SELECT unnest(['BY4743', 'Y12', 'src1']))")
def x23(spark, sf):
    fixed = table(spark, sf, "documents").limit(1).select(F.explode(F.array(*map(F.lit, ("BY4743", "Y12", "src1")))).alias("v"))
    return table(spark, sf, "documents").select(F.col("source").alias("v")).unionByName(fixed).distinct()


@query("x20_labels", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 40 THEN 'middle' ELSE 'large' END AS label FROM part")
def x20(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 40, "middle").otherwise("large").alias("label"))


@query("s07_tag_set", f"WITH {_sql(DEC)} SELECT DISTINCT split_part(value, ' ', 2) AS tag FROM ln WHERE starts_with(value, 'Y') AND contains(value, ' ')")
def s07(spark, sf):
    return S.decode_rows(_lines(spark, sf, DEC)).select("tag").distinct()


@query("s08_tag_limit", f"WITH {_sql(DEC)} SELECT line_no AS ord, split_part(value, ' ', 1) AS gene FROM ln WHERE starts_with(value, 'Y') AND contains(value, ' ') ORDER BY line_no LIMIT 20")
def s08(spark, sf):
    return S.decode_rows(_lines(spark, sf, DEC)).orderBy("ord").limit(20).select("ord", "gene")


@query("s18_columns_by_fragments", "SELECT lang AS a, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang")
def s18(spark, sf):
    wide = table(spark, sf, "documents").select(F.col("lang").alias("Systematic Name Interactor A"), F.col("source").alias("Systematic Name Interactor B"))
    return S.columns_by_fragments(wide, {"a": ["systematic", " a"], "b": ["systematic", " b"]}).groupBy("a").agg(F.count("*").alias("n"))


@query("s20_gene_cells", "SELECT DISTINCT v AS gene FROM (SELECT lang AS v FROM documents UNION ALL SELECT source FROM documents) WHERE regexp_matches(v, '^src') AND length(v) >= 5")
def s20(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return d.unpivot(["doc_id"], ["lang", "source"], "c", "gene").where("gene rlike '^src' and length(gene) >= 5").select("gene").distinct()


@query("s36_draft_sheet", f"""WITH n AS (SELECT DISTINCT source AS v FROM documents), h AS (SELECT d.doc_id AS k, arg_min(n.v, (-length(n.v), n.v)) AS found FROM documents d JOIN n ON contains(upper(d.source), upper(n.v)) GROUP BY d.doc_id)
SELECT d.doc_id AS record, replace(trim({_TITLE}), ' ', '_') AS sample_id, coalesce(found, '') AS strain, CASE d.doc_id % 6 WHEN 0 THEN 10 WHEN 2 THEN 0 WHEN 3 THEN 10 WHEN 4 THEN 0 END AS generation, CASE d.doc_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN '2' WHEN 3 THEN '3' WHEN 4 THEN 'C' ELSE '' END AS replicate, '' AS index_seq, '' AS fastq FROM documents d LEFT JOIN h ON d.doc_id = h.k""")
def s36(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("record"), F.expr(_TITLE).alias("title"), F.col("source").alias("source_name"))
    return S.draft_sheet(d, d.select(F.col("source_name").alias("strain")).distinct())


@query("r05_columns", "SELECT p_partkey AS partkey, p_size AS size FROM part")
def r05(spark, sf):
    p = table(spark, sf, "part")
    keep = [c for c in p.columns if c.endswith(("key", "size"))]
    return p.select(*keep).withColumnsRenamed({c: c.removeprefix("p_") for c in keep})
