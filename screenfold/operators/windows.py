"""Ordered calculations that a window expresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenfold.operators.scan import numbered, running, step_up

#: Neighbouring rows that one window goes over, besides those of a moving mean's half width on either side.
STRETCH = 65_536


def with_fdr(tests: DataFrame, p: str = "pvalue", family: Sequence[str] = (), out: str = "fdr") -> DataFrame:
    """Adds the step-up FDR; rows without a p-value get none and do not count.

    Equal p-values are one row until the rates are joined back, and the scans over them go slice by
    slice, so neither a family nor a frequent p-value is one task.
    """
    return step_up(tests, list(family), p, out)


def moving_mean(rows: DataFrame, part: Sequence[str], order: Sequence[str], value: str, half: int, out: str) -> DataFrame:
    """Centred moving mean, cut short at both ends.

    Rows get their place by a scan and are cut into stretches; those near an end also go to the stretch
    beside it, so no window goes over more than a stretch and its margins, however large a part is.
    ``order`` should tell rows apart; equal rows are in any sequence.
    """
    size = max(STRETCH, half)
    of = lambda at: F.floor(at / F.lit(size)).cast("long")
    at = F.col("place in part")
    near = numbered(rows, [F.col(c) for c in order], "place in part", list(part), start=0)
    near = near.withColumn("stretch", F.explode(F.array_distinct(F.array(of(at - half), of(at), of(at + half)))))
    own = Window.partitionBy(*part, "stretch").orderBy("place in part").rowsBetween(-half, half)
    return near.withColumn(out, F.avg(value).over(own)).where(F.col("stretch") == of(at)).drop("stretch", "place in part")


def reverse_cumulative(rows: DataFrame, part: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Sum of the values from the highest of ``order`` down to the row's own, null until the first value."""
    return running(rows, [F.desc(order)], {out: ("sum", F.col(value))}, list(part))


def top_n(rows: DataFrame, part: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col(out) <= n)
