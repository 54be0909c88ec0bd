"""Readers of the text formats around a screen. All give typed tables with null for missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from screenfold.functions import text as T
from screenfold.operators.scan import running

FEATURE_COLUMNS = tuple(f"c{i}" for i in range(16))
SHEET_SCHEMA = "sample_id string, strain string, generation int, replicate string, fastq string, index_seq string"


def read_table(spark: SparkSession, path: str, schema: str | None = None, sep: str = "\t") -> DataFrame:
    """A table with a header; gzip is read by its extension."""
    reader = spark.read.option("sep", sep).option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def sheet_faults(sheet: DataFrame) -> DataFrame:
    """(fault, value, n): repeated sample ids and generations other than 0 and 10; empty if sound."""
    dup = sheet.groupBy(F.col("sample_id").alias("value")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated sample_id").alias("fault"), "value", "n")
    gen = sheet.where("generation is null or generation not in (0, 10)").groupBy(F.col("generation").cast("string").alias("value")).agg(F.count("*").alias("n"))
    return dup.unionByName(gen.select(F.lit("generation not 0 or 10").alias("fault"), "value", "n"))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    sheet = read_table(spark, path, SHEET_SCHEMA).na.fill("")
    bad = sheet_faults(sheet).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['fault']}: {r['value']}" for r in bad))
    return sheet


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): the lines of files, numbered from 0 in each.

    Files are read in byte ranges. A line's place in its range comes from ids that rise as a range is read,
    and ranges are counted and added up, so a file of any size is many tasks.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range_at"), F.monotonically_increasing_id().alias("id"), "value")
    ends = rows.groupBy("file", "range_at").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("range_at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ends = ends.select("file", "range_at", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows.join(ends, ["file", "range_at"]).select("file", (F.col("id") - F.col("first") + F.col("before")).alias("line_no"), "value")


def with_records(lines: DataFrame, starts: Column, name: str = "record") -> DataFrame:
    """``lines`` with the number of starts up to each in its file, 0 before the first; no file is one task."""
    return running(lines, [F.col("line_no")], {name: ("sum", starts.cast("int"))}, ["file"])


def decode_rows(lines: DataFrame) -> DataFrame:
    """(ord, gene, tag) of lines that start with Y and have two fields at least."""
    got = lines.where(F.col("value").startswith("Y")).withColumn("f", F.split(F.trim("value"), r"\s+")).where(F.size("f") >= 2)
    return got.select(F.col("line_no").alias("ord"), F.col("f")[0].alias("gene"), F.col("f")[1].alias("tag"))


def soft_records(lines: DataFrame, kind: str = "SAMPLE") -> DataFrame:
    """(file, record, name, key, value): keys of each block, repeats joined by '; ' in order."""
    rows = with_records(lines, F.col("value").startswith("^" + kind)).where("record > 0")
    rows = rows.withColumn("key", F.regexp_extract("value", rf"^!{kind.title()}_(\S+) = ", 1)).withColumn("v", F.regexp_extract("value", r"^!\S+ = (.*)$", 1))
    name = F.max(F.when(F.col("value").startswith("^"), F.regexp_extract("value", r"= (.*)$", 1))).over(Window.partitionBy("file", "record"))
    rows = rows.withColumn("name", name).where("key <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "v"))), lambda s: s["v"]), "; ")
    return rows.groupBy("file", "record", "name", "key").agg(joined.alias("value"))


def fasta_records(lines: DataFrame) -> DataFrame:
    """(file, record, name, sequence): the header's first word, the body in one piece without a final *."""
    rows = with_records(lines.where("value <> ''"), F.col("value").startswith(">")).where("record > 0")
    head = F.max(F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>(\S+)", 1)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("value").startswith(">"), F.struct("line_no", F.trim("value").alias("v"))))), lambda s: s["v"]), "")
    return rows.groupBy("file", "record").agg(head.alias("name"), F.regexp_replace(body, r"\*+$", "").alias("sequence"))


def accession(name: Column) -> Column:
    """Of db|ACC|NAME the accession, else the name."""
    parts = F.split(name, r"\|")
    return F.when(F.size(parts) >= 3, parts[1]).otherwise(name)


def gaf_rows(lines: DataFrame) -> DataFrame:
    """(object_id, term, evidence, aspect, synonyms) without comments, short lines and evidence ND."""
    got = lines.where(~F.col("value").startswith("!")).withColumn("f", F.split("value", "\t")).where(F.size("f") >= 11)
    got = got.select(F.col("f")[1].alias("object_id"), F.col("f")[4].alias("term"), F.col("f")[6].alias("evidence"), F.col("f")[8].alias("aspect"), F.col("f")[10].alias("synonyms"))
    return got.where("evidence <> 'ND'")


def obo_names(lines: DataFrame) -> DataFrame:
    """(id, name) of [Term] blocks: the id and the first name of each."""
    rows = with_records(lines, F.col("value").startswith("["), "block")
    first = lambda p: F.min_by(F.when(F.col("value").startswith(p), F.expr(f"substr(value, {len(p) + 1})")), F.when(F.col("value").startswith(p), F.col("line_no")))
    got = rows.groupBy("file", "block").agg(F.bool_or(F.col("value") == "[Term]").alias("term"), first("id: ").alias("id"), first("name: ").alias("name"))
    return got.where("term and id is not null and name is not null").select("id", "name")


def pair_rows(lines: DataFrame, prefix: str = "") -> DataFrame:
    """(gene, category) of two tab-separated columns; comments and incomplete rows go."""
    f = F.split("value", "\t")
    got = lines.where(~F.col("value").startswith("#")).select(F.trim(f[0]).alias("gene"), F.trim(F.get(f, F.lit(1))).alias("c"))
    return got.where("gene <> '' and c <> '' and c is not null").select("gene", F.concat(F.lit(prefix), "c").alias("category"))


def read_features(spark: SparkSession, path: str, nulls: bool = False) -> DataFrame:
    """The headerless 16-column feature file, all strings; empty fields stay empty unless ``nulls``."""
    reader = spark.read.option("sep", "\t").option("mode", "DROPMALFORMED").option("emptyValue", "").schema(", ".join(f"{c} string" for c in FEATURE_COLUMNS))
    got = reader.csv(path)
    return got if nulls else got.na.fill("")


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles; what is no number, and NaN, is null."""
    value = lambda c: F.expr(f"try_cast(`{c}` as double)")
    return df.withColumns({c: F.when(~F.isnan(value(c)), value(c)) for c in columns})


def columns_by_fragments(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Columns found by fragments of their names, in any case, and renamed."""
    out = []
    for name, parts in wanted.items():
        hits = [c for c in df.columns if all(p.lower() in c.lower() for p in parts)]
        if not hits:
            raise ValueError(f"no column for {name}")
        out.append(F.col(f"`{hits[0]}`").alias(name))
    return df.select(*out)


def domain_faults(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n): cells other than 0, 1 and null."""
    bad = df.agg(*[F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(0, 1)).alias(c) for c in columns])
    return bad.unpivot([], columns, "column", "n").where("n > 0")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path, in whatever store the session reads, is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(gene): distinct non-empty names of the column ``gene``, else of the first; a missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "gene string")
    got = read_table(spark, path)
    column = "gene" if "gene" in got.columns else got.columns[0]
    return got.select(F.col(f"`{column}`").cast("string").alias("gene")).where("gene <> ''").distinct()


def read_lane_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A lane's count matrix, its columns without the well and index tag that end their names."""
    got = read_table(spark, path)
    return clean_lane_columns(got)


def clean_lane_columns(df: DataFrame) -> DataFrame:
    import re

    names = [re.sub(r"[A-H][0-9]{1,2}-[ACGT]+$", "", c) for c in df.columns]
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise ValueError(f"columns that are one without their tags: {sorted(twice)}")
    return df.toDF(*names)


def paired_tables(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables, if their keys are the same with repeats; else an error that names some that differ."""
    ka, kb = a.select(key), b.select(key)
    odd = ka.exceptAll(kb).withColumn("side", F.lit("left")).unionByName(kb.exceptAll(ka).withColumn("side", F.lit("right"))).limit(5).collect()
    if odd:
        raise ValueError("keys of one table only: " + ", ".join(f"{r[key]} ({r['side']})" for r in odd))
    return a, b


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(run, gene, split) of split tables, ``path`` a glob; a run is its file's folder. NA and the like stay text."""
    rows = spark.read.option("sep", "\t").option("header", True).option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    gene, split = rows.columns[:2]
    run = F.element_at(F.split("_metadata.file_path", "/"), -2)
    return rows.select(run.alias("run"), F.col(f"`{gene}`").alias("gene"), F.col(f"`{split}`").alias("split"))


def read_categories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Distinct (gene, category) of a headerless two-column file with # comments, and (category, genes)
    with the genes of each in order."""
    rows = spark.read.option("sep", "\t").option("comment", "#").schema("gene string, category string").csv(path)
    rows = rows.where("gene IS NOT NULL AND category IS NOT NULL").distinct()
    return rows, rows.groupBy("category").agg(F.array_sort(F.collect_list("gene")).alias("genes"))


def read_counts(spark: SparkSession, path: str, gene: str = "gene", sep: str = ",") -> DataFrame:
    """(gene, sample, n) of a raw count matrix: a row a gene, a column a sample; what is no number is null."""
    wide = read_table(spark, path, sep=sep)
    first, *samples = wide.columns
    wide = wide.withColumnRenamed(first, gene)
    return numeric(wide, samples).unpivot([gene], samples, "sample", "n").withColumn("n", F.col("n").cast("long"))


def read_split_frames(spark: SparkSession, path: str, column: str = "Split", names: tuple[str, ...] = ("train", "val", "test")) -> dict[str, DataFrame]:
    """The rows of each split of one table, by name; a name that the table lacks has no rows."""
    rows = read_table(spark, path)
    return {n: rows.where(F.col(column) == n).drop(column) for n in names}


def read_id_map(spark: SparkSession, path: str, old: str, new: str) -> DataFrame:
    """Distinct (old, new) of a table with a header, gzip or plain; rows without either go."""
    rows = read_table(spark, path).select(F.trim(F.col(f"`{old}`")).alias(old), F.trim(F.col(f"`{new}`")).alias(new))
    return rows.where((F.col(old) != "") & (F.col(new) != "")).distinct()


def read_annotations(spark: SparkSession, categories: str, features: str) -> tuple[DataFrame, DataFrame]:
    """(gene, category) and (gene, feature, value); each table is empty if its file is missing."""
    cats, long = spark.createDataFrame([], "gene string, category string"), spark.createDataFrame([], "gene string, feature string, value double")
    if exists(spark, categories):
        cats = spark.read.option("sep", "\t").schema("gene string, category string").csv(categories)
    if exists(spark, features):
        wide = read_table(spark, features)
        names = [c for c in wide.columns if c != "gene"]
        long = numeric(wide, names).unpivot(["gene"], names, "feature", "value") if names else long
    return cats, long


def draft_sheet(records: DataFrame, strains: DataFrame, name: str = "strain") -> DataFrame:
    """A draft sample sheet of (record, title, hints...) rows: strain and generation guessed from all text
    fields, the replicate from the title; what no field tells is empty."""
    hints = [c for c in records.columns if c != "record"]
    rows = records.withColumn("_text", F.concat_ws(" ; ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in hints]))
    found = T.longest_contained(rows, "_text", strains, name, ["record"]).withColumnRenamed("found", "strain")
    sheet = rows.select("record", F.replace(F.trim("title"), F.lit(" "), F.lit("_")).alias("sample_id"), T.generation(F.col("_text")).alias("generation"), T.replicate(F.trim("title")).alias("replicate"))
    return sheet.join(found, "record", "left").select("record", "sample_id", F.coalesce("strain", F.lit("")).alias("strain"), "generation", F.coalesce("replicate", F.lit("")).alias("replicate"), F.lit("").alias("index_seq"), F.lit("").alias("fastq"))


def coverage(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """(source, file, status): loaded or missing, of named input files."""
    return spark.createDataFrame([(k, p, "loaded" if exists(spark, p) else "missing") for k, p in sources.items()], "source string, file string, status string")
