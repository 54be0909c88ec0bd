"""Ordered scans over whole tables in two passes.

Rows are cut into slices by ranges of their order; each slice is scanned by itself, a row for each slice
sums it up, and what comes before a slice is joined back. No window ever spans more than one slice,
or the list of slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenfold.plans.session import shuffle_width, stash


def in_slices(rows: DataFrame, order: list[Column], name: str = "slice") -> DataFrame:
    """``rows`` with the number of their range of ``order``, written once so that numbers stay.

    ``order`` must tell rows apart where many are equal, or equal rows share a slice.
    """
    cut = rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).withColumn(name, F.spark_partition_id())
    return stash(cut, "slices")


#: What a running value starts from in a slice, and how it is joined with what comes before.
_SUMS = {
    "count": (lambda c: F.count(c), lambda before, own: F.coalesce(before, F.lit(0)) + own, lambda c: F.sum(c)),
    "sum": (lambda c: F.sum(c), lambda before, own: F.when(before.isNull(), own).when(own.isNull(), before).otherwise(before + own), lambda c: F.sum(c)),
    "min": (lambda c: F.min(c), lambda before, own: F.least(before, own), lambda c: F.min(c)),
    "max": (lambda c: F.max(c), lambda before, own: F.greatest(before, own), lambda c: F.max(c)),
    "last": (lambda c: F.last(c, True), lambda before, own: F.coalesce(own, before), lambda c: F.last(c, True)),
}


def running(rows: DataFrame, order: list[Column], values: dict[str, tuple[str, Column]], by: list[str] = (), slice_: str = "slice") -> DataFrame:
    """``rows`` with running values from the first row of each group of ``by`` to the present one.

    ``values`` names each with its kind (count, sum, min, max, last that is not null) and what it is
    of. Rows equal in ``order`` are in any sequence, so end ``order`` with a key where that matters.
    """
    by = list(by)
    held = in_slices(rows, [*(F.col(b) for b in by), *order], slice_)
    own = Window.partitionBy(slice_, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    scanned = held.withColumns({f"own {n}": _SUMS[kind][0](c).over(own) for n, (kind, c) in values.items()} | {"own place": F.row_number().over(own)})
    # a slice ends with its last row, which holds what the slice sums to
    ends = scanned.groupBy(slice_, *by).agg(*(F.max_by(F.col(f"own {n}"), F.col("own place")).alias(n) for n in values))
    earlier = Window.partitionBy(*by).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    before = ends.select(slice_, *by, *(_SUMS[kind][2](F.col(n)).over(earlier).alias(f"before {n}") for n, (kind, _) in values.items()))
    both = with_group(scanned, before, by, [slice_])
    out = [_SUMS[kind][1](F.col(f"before {n}"), F.col(f"own {n}")).alias(n) for n, (kind, _) in values.items()]
    return both.select(*(F.col(f"`{c}`") for c in rows.columns), *out)


def with_group(rows: DataFrame, groups: DataFrame, by: list[str], also: list[str] = (), how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their group, null being a group as well; ``also`` are keys of which null is none."""
    match = F.lit(True)
    for k in [*by, *also]:
        a, b = F.col(f"a.`{k}`"), F.col(f"b.`{k}`")
        match = match & (a.eqNullSafe(b) if k in by else a == b)
    keys = [*by, *also]
    return rows.alias("a").join(groups.alias("b"), match, how).select("a.*", *(F.col(f"b.`{c}`") for c in groups.columns if c not in keys))


def numbered(rows: DataFrame, order: list[Column], name: str, by: list[str] = (), start: int = 1) -> DataFrame:
    """``rows`` with their place in ``order``, from ``start`` in each group of ``by``."""
    got = running(rows, order, {name: ("count", F.lit(1))}, by)
    return got.withColumn(name, (F.col(name) - 1 + start).cast("int"))


def ranked_values(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, ties, upto): each distinct value, its rows and the rows up to it in its group."""
    ties = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("ties"))
    return running(ties, [F.col(value)], {"upto": ("sum", F.col("ties"))}, by)


def mean_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the average rank of their value in its group; equal values are one row until the join."""
    return mean_ranks_of(rows, by, {name: value})


def mean_ranks_of(rows: DataFrame, by: list[str], values: dict[str, str]) -> DataFrame:
    """``mean_ranks`` of several values, name by name, each ranked from ``rows`` as given; write ``rows`` first if costly."""
    out = rows
    for name, value in values.items():
        places = ranked_values(rows, by, value).withColumn(name, F.col("upto") - (F.col("ties") - 1) / 2.0).drop("ties", "upto")
        out = with_group(out, places, by, [value], "left")
    return out


def exact_quantiles(rows: DataFrame, by: list[str], value: str, at: list[float], name: str = "q") -> DataFrame:
    """(by, name): quantiles of each group's values by linear interpolation, as an array in the order of ``at``.

    The value of a rank is the least with as many rows up to it, so a group's values never meet in one
    buffer: equal ones are counted first and a scan in slices adds the counts up. Missing values do
    not count; a group of missing values alone has no row.
    """
    places = ranked_values(rows, by, value)
    places = with_group(places, places.groupBy(*by).agg(F.max("upto").alias("of all")), by) if by else places.crossJoin(places.agg(F.max("upto").alias("of all")))
    rank = lambda p, up: (F.ceil if up else F.floor)((F.col("of all") - 1) * F.lit(float(p))) + 1
    of_rank = lambda r: F.min(F.when(F.col("upto") >= r, F.col(value).cast("double")))
    ends = [of_rank(rank(p, up)).alias(f"{k} {up}") for k, p in enumerate(at) for up in (0, 1)]
    got = places.groupBy(*by).agg(F.max("of all").alias("of all"), *ends)
    part = lambda p: (F.col("of all") - 1) * F.lit(float(p)) - F.floor((F.col("of all") - 1) * F.lit(float(p)))
    between = [F.col(f"{k} 0") + part(p) * (F.col(f"{k} 1") - F.col(f"{k} 0")) for k, p in enumerate(at)]
    return got.select(*by, F.array(*between).alias(name))


def step_up(rows: DataFrame, by: list[str], p: str, name: str) -> DataFrame:
    """``rows`` with false discovery rates of the p-values ``p`` in each group; null where p is.

    The rate of a p-value is the least of p * n / (rows up to it) over the values from it on.
    """
    places = ranked_values(rows, by, p)
    total = rows.where(F.col(p).isNotNull()).groupBy(*by).agg(F.count("*").alias("of all")) if by else rows.agg(F.count(p).alias("of all"))
    places = with_group(places, total, by) if by else places.crossJoin(total)
    places = places.withColumn("rate", F.least(F.lit(1.0), F.col(p) * F.col("of all") / F.col("upto")))
    places = running(places.drop("ties", "upto", "of all"), [F.desc(p)], {name: ("min", F.col("rate"))}, by).drop("rate")
    return with_group(rows, places, by, [p], "left")
