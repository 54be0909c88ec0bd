"""Joins that plain equality does not express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenfold.operators.scan import running
from screenfold.plans.session import shuffle_width


def nearest_gap(rows: DataFrame, marks: DataFrame, row_id: str, key: str, at: str) -> DataFrame:
    """(row_id, gap): distance of each row to the nearest mark of its key, null without one.

    Rows and marks are merged in order of position, so each row sees the last mark before it and the
    first after it; nothing is paired with every mark of its key, and no key is one task. Rows without
    a key are left out.
    """
    both = rows.select(F.col(row_id).alias("id"), F.col(key).alias("k"), F.col(at).alias("at"), F.lit(None).cast("long").alias("m")).unionAll(marks.select(F.lit(None), F.col(key), F.col(at), F.col(at).cast("long")))
    at_first = [F.col("m").isNull(), F.col("id")]  # marks before the rows at their place
    both = running(both.where("k is not null"), [F.col("at"), *at_first], {"before": ("last", F.col("m"))}, ["k"])
    both = running(both, [F.desc("at"), *at_first], {"after": ("last", F.col("m"))}, ["k"])
    gap = F.least(F.col("at") - F.col("before"), F.col("after") - F.col("at"))
    return both.withColumn("gap", gap).where("id is not null").select(F.col("id").alias(row_id), "gap")


def pairs_within(rows: DataFrame, key: str, order: str, value: str, most: int = 1024) -> DataFrame:
    """(key, id_1, id_2, v, w), id_1 < id_2 in ``order``: all pairs of rows of a key, with v and w, the values of the two, in any order.

    A key's rows are dealt into blocks of about ``most``, and two blocks meet in a unit, so a task holds two
    blocks and a key of any size is many units. Each pair is made once.
    """
    rows = rows.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(F.col(key).alias("_key"), F.col(order).alias("_id"), F.col(value).alias("_value"))
    sizes = rows.groupBy("_key").agg(F.ceil(F.count("*") / most).cast("int").alias("_of"))
    dealt = rows.join(sizes, "_key").withColumn("_own", F.pmod(F.xxhash64("_id"), F.col("_of")).cast("int"))
    width = shuffle_width(rows.sparkSession)
    a = dealt.select("_key", F.col("_own").alias("_i"), F.explode(F.sequence(F.col("_own"), F.col("_of") - 1)).alias("_j"), "_id", "_value")
    b = dealt.select("_key", F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_i"), F.col("_own").alias("_j"), F.col("_id").alias("_other"), F.col("_value").alias("_w"))
    units = a.repartition(width, "_key", "_i", "_j").join(b.repartition(width, "_key", "_i", "_j"), ["_key", "_i", "_j"])
    met = units.where((F.col("_i") < F.col("_j")) | (F.col("_id") < F.col("_other")))  # equal ids are in one block
    return met.select(F.col("_key").alias(key), F.least("_id", "_other").alias("id_1"), F.greatest("_id", "_other").alias("id_2"), F.col("_value").alias("v"), F.col("_w").alias("w"))
