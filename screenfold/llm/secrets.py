"""Op 7: secret scans with an incremental ledger of blobs and rule versions. DataFrame functions only.

Every version of a file is addressed by the hash of its content. The ledger is a table of the pairs of
blob and rule version that have been scanned, with what was found; a run scans only pairs that it
lacks, so that a new version of one rule looks for that rule alone, reads each distinct blob once, and
joins findings back to every path that ever held the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenfold.plans.session import stash


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost without overlaps; a match counts if its group ``group`` (0: all
    of it) has at least ``least`` characters. ``mark`` must occur in a text that can match at all."""

    kind: str
    pattern: str
    group: int
    least: int
    mark: str
    base: bool = True
    version: str = "1"


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"[:=]"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "-----BEGIN ", base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, r"eyJ", base=False),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 36, r"gh[pousr]_", base=False),
)
EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # of no bytes
PLACES = "array<struct<start:bigint,end:bigint>>"
SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
#: Parts into which the rows of a blob are dealt where findings are joined back to them.
SALTS = 16


def places_of(text: Column, rule: Rule) -> Column:
    """Spans of one rule in code points, end exclusive, in order.

    Texts between matches and matches themselves come from one pattern, so running sums of their
    lengths place every match.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    lengths = F.transform(F.arrays_zip(between.alias("b"), found.alias("m"), group.alias("g")), lambda z: F.struct(F.length(z["b"]).cast("bigint").alias("b"), F.coalesce(F.length(z["m"]), F.lit(0)).cast("bigint").alias("m"), F.coalesce(F.length(z["g"]), F.lit(-1)).alias("g")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(PLACES).alias("out"))

    def step(acc: Column, z: Column) -> Column:
        begin = acc["at"] + z["b"]
        end = begin + z["m"]
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(z["g"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    placed = F.aggregate(lengths, start, step)["out"]
    return F.when(text.rlike(rule.mark), placed).otherwise(F.array().cast(PLACES))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows (blob, rule, rule_version, spans) of rows (blob, text, done), where ``done`` lists the
    ``rule@version`` that need no scan."""
    todo = lambda r: ~F.array_contains("done", f"{r.kind}@{r.version}")
    each = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version"), F.when(todo(r), places_of(F.col("text"), r)).alias("spans")) for r in rules])
    return blobs.select("blob", F.inline(each)).where("spans is not null")


def blob_spans(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of the blobs in which the current versions of ``rules`` found anything, spans of all
    rules by start and then rule order."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(f"{r.kind}@{r.version}"), F.lit(i))])[F.concat_ws("@", "rule", "rule_version")]
    rows = ledger.where(F.size("spans") > 0).withColumn("rank", rank).where("rank is not null").select("blob", "rule", "rank", F.inline("spans"))
    span = F.struct("start", "rank", F.col("rule").alias("kind"), "end")
    return rows.distinct().groupBy("blob").agg(F.array_sort(F.collect_list(span)).cast(SPANS).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def content_address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scan every version (path, text); returns (findings, new ledger rows).

    findings: (path, blob, spans) for each input row; ledger rows: (blob, rule, rule_version, spans) of
    the pairs that ``ledger`` lacks, written once below the checkpoint folder. Append them to the ledger
    to make the next run incremental. A null text is the empty blob. Copies of a text are one blob,
    scanned once, however many rows hold it: the row to scan is picked by its smallest path, so no
    copies meet in one task. Very long texts are scanned whole. Paths may repeat or be null; an empty
    table gives empty results.
    """
    rows = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", content_address(F.col("text")))
    light = rows.select("path", "blob")
    chosen = light.groupBy("blob").agg(F.min("path").alias("first"))
    none = F.array().cast("array<string>")
    if ledger is None:
        chosen = chosen.withColumn("done", none)
    else:
        names = [f"{r.kind}@{r.version}" for r in rules]
        done = ledger.withColumn("pair", F.concat_ws("@", "rule", "rule_version")).where(F.col("pair").isin(*names)).groupBy("blob").agg(F.collect_set("pair").alias("done"))
        chosen = chosen.join(done, "blob", "left").withColumn("done", F.coalesce("done", none)).where(F.size("done") < len(names))
    # equal on blob and path: a blob of many rows is spread by its paths
    unseen = rows.alias("r").join(chosen.alias("c"), (F.col("r.blob") == F.col("c.blob")) & F.col("r.path").eqNullSafe(F.col("c.first"))).select("r.blob", "r.text", "c.done")
    new = stash(scan_blobs(unseen, rules), "ledger")
    found = blob_spans(new if ledger is None else new.unionByName(ledger), rules)
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = light.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    back = salted.join(found, ["blob", "salt"], "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
    return back.withColumnRenamed("path", path), new


def report(findings: DataFrame, path: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, n_assign, n_access, n_hex, base_sha256, spans) of each finding row."""
    base = [r.kind for r in rules if r.base]
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    of_base = written(F.filter("spans", lambda s: s["kind"].isin(*base)))
    return findings.select(path, *[count(k) for k in base], F.sha2(of_base.cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every span, overlapping ones as one, replaced by ``mask``."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.lit(2147483647))))


def redact_documents(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """Every row of ``docs`` with the spans of its text masked and n_chars, if there, set anew."""
    _, ledger = scan_versions(docs)
    found = blob_spans(ledger).where(F.size("spans") > 0).select(F.col("blob").alias("found_blob"), F.col("spans").alias("found_spans"))
    found = found.withColumn("found_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = docs.withColumn("own_blob", content_address(F.col("text")))
    # a blob of many rows is spread by their ids
    rows = rows.withColumn("own_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    rows = rows.join(found, (F.col("own_blob") == F.col("found_blob")) & (F.col("own_salt") == F.col("found_salt")), "left")
    clean = F.when(F.col("found_spans").isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col("found_spans")))
    rows = rows.withColumn("text", clean)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("found_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*docs.columns)
