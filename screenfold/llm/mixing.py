"""Op 8: mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hash prefixes by which the documents of a source are summed before any are put in order.
CELLS = 4096


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources in code-point order, null last, take the weights in turn. In the order of cap / weight the
    first sources fill up; with their caps set aside, the rest share what is left by weight. The level
    is the first at which the next source would stay below its cap, which is what resharing the excess
    again and again ends at. One window over the sources, of which there are few.
    """
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (place + 1).cast("int"))
    rows = sizes.select("source", F.col("source_size").cast("long").alias("source_size")).withColumn("w", w).withColumn("cap", F.col("source_size") * max_epochs)
    by_cap = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    rows = rows.withColumn("spare", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("left_w", F.sum("w").over(after))
    rows = rows.withColumn("below", F.col("cap") * F.col("left_w") > F.col("spare") * F.col("w"))
    level = Window.partitionBy()
    rows = rows.withColumn("at", F.min(F.when(F.col("below"), F.struct((F.col("cap") / F.col("w")).alias("k"), "spare", "left_w"))).over(level))
    share = F.col("w") * F.col("at.spare") / F.col("at.left_w")
    target = F.when(F.col("at").isNull() | (F.col("cap") * F.col("at.left_w") <= F.col("at.spare") * F.col("w")), F.col("cap").cast("double")).otherwise(share.cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row, and the columns of ``carry``.

    Each document is taken whole floor(target / source_size) times. The rest of the target is met by
    the source's documents in the order of a seeded hash of their id, each once more as long as the
    running size does not go beyond the rest by more than half of the document that crosses it. The
    order is only ever taken within one cell of hash prefixes, the one in which the rest runs out;
    whole cells before it are summed. Null texts and empty sources have size 0 and take 0; rows with
    equal ids and sizes are interchangeable; a null source is a source of its own.
    """
    own = [F.col(c).alias(f"carried_{c}") for c in carry]
    rows = docs.select("doc_id", "source", word_count().alias("size"), *own)
    rows = rows.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = rows.withColumn("cell", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    targets = water_fill(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, max_epochs)
    so_far = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    plan = cells.withColumn("before", F.coalesce(F.sum("cell_size").over(so_far), F.lit(0)))
    plan = plan.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    whole = F.when(F.col("t.source_size") > 0, F.floor(F.col("t.target") / F.col("t.source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.select("p.source", "cell", "cell_size", "before", "t.source_size", "t.target", whole.alias("whole"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = plan.withColumn("split", (F.col("before") < F.col("rest")) & (F.col("before") + F.col("cell_size") > F.col("rest")))
    # a row for each source and hash prefix, small beside the documents and of known width
    joined = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.cell") == F.col("p.cell")))
    joined = joined.select("r.doc_id", "r.source", "r.size", "r.cell", "r.h", "source_size", "target", "whole", "rest", "before", "split", *[f"carried_{c}" for c in carry])
    inside = Window.partitionBy("source", "cell").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    tail = joined.where("split").withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    tail = tail.withColumn("once", F.col("at") + F.col("size") / 2 <= F.col("rest"))
    rest = joined.where("not split").withColumn("once", F.col("before") < F.col("rest"))
    both = tail.drop("at").unionByName(rest)
    taken = F.col("size") * (F.col("whole") + F.when(F.col("once") & (F.col("size") > 0), 1).otherwise(0))
    return both.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *[F.col(f"carried_{c}").alias(c) for c in carry])


def repeat(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns.

    Rows that the mix does not take, null and empty texts among them, are not in it; what ``mix`` says of
    ties, repeated rows and null sources holds here. Very long texts are counted whole.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    kept = {c: f"own {c}" for c in others}
    renamed = docs.select("doc_id", "source", F.col("text").alias("text"), *[F.col(c).alias(v) for c, v in kept.items()])
    taken = mix(renamed, carry=tuple(kept.values()), **options).where("taken > 0")
    times = taken.withColumn("time", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))))
    return times.select(*[F.col(f"`{kept[c]}`").alias(c) if c in kept else F.col(c) for c in docs.columns])


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 3 AS cap, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s),
o AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spare,
             CAST(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS left_w FROM w),
l AS (SELECT spare AS s0, left_w AS w0 FROM o WHERE cap * left_w > spare * w ORDER BY cap / w, spare LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN w0 IS NULL OR cap * w0 <= s0 * w THEN CAST(cap AS DOUBLE) ELSE CAST(w * s0 AS DOUBLE) / w0 END AS target
      FROM o LEFT JOIN l ON true),
p AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN size > 0 AND bef + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""
