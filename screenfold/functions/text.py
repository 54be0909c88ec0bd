"""Scalar functions on names and free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The one-letter codes of amino acids.
AMINO = "ACDEFGHIKLMNPQRSTVWY"


def composition(seq: Column) -> dict[str, Column]:
    """Length and percentage of each residue, a final * not counted; an empty sequence has nulls."""
    clean = F.regexp_replace(seq, r"\*+$", "")
    n = F.length(clean)
    share = lambda a: F.try_divide(100.0 * (n - F.length(F.regexp_replace(clean, a, ""))), n)
    return {"length": n} | {f"pct_{a}": share(a) for a in AMINO}


def longest_contained(rows: DataFrame, text: str, names: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """(keys, found): the longest name that the upper-cased text holds, the first in order on a tie.

    Names are a vocabulary: few, and gathered into one array that each row filters.
    """
    sheet = names.where(F.col(name).isNotNull() & (F.col(name) != "")).agg(F.array_sort(F.collect_set(F.struct((-F.length(name)).alias("k"), F.col(name).alias("v")))).alias("sheet"))
    hit = F.filter("sheet", lambda s: F.contains(F.upper(F.col(text)), F.upper(s["v"])))
    return rows.crossJoin(sheet).select(*keys, F.get(hit, F.lit(0))["v"].alias("found"))


def generation(text: Column) -> Column:
    """10 or 0 named in free text, 10 first; null if neither."""
    t = F.lower(text)
    ten = r"gen(eration)?[ _-]*10\b|\bg10\b|\bt10\b|\bend\b|final"
    zero = r"gen(eration)?[ _-]*0\b|\bg0\b|\bt0\b|\bstart\b|initial|baseline"
    return F.when(t.rlike(ten), 10).when(t.rlike(zero), 0)


def replicate(text: Column) -> Column:
    """The label after rep or replicate, else a final letter, else a final number; else empty."""
    pick = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.coalesce(pick(r"(?i)rep(?:licate)?[ _-]*([A-Za-z0-9])\b"), pick(r"[ _-]([A-C])$"), pick(r"[ _-]([0-9])$"), F.lit(""))


def clone_base(name: Column) -> Column:
    return F.regexp_replace(name, r"-\d+$", "")


def known_tokens(text: Column, vocabulary: Column) -> Column:
    """Tokens between semicolons or spaces that are in the vocabulary, rejoined by spaces."""
    return F.array_join(F.filter(F.split(text, r"[;\s]+"), lambda t: F.array_contains(vocabulary, t)), " ")


def listed(items: Column) -> Column:
    """'a', 'a and b' or 'a, b, and c'."""
    n = F.size(items)
    return F.when(n == 0, "").when(n == 1, items[0]).when(n == 2, F.concat(items[0], F.lit(" and "), items[1])).otherwise(F.concat(F.array_join(F.slice(items, 1, n - 1), ", "), F.lit(", and "), F.element_at(items, -1)))


def midpoint(a: Column, b: Column) -> Column:
    x, y = a.cast("double"), b.cast("double")
    return (F.least(x, y) + F.greatest(x, y)) / 2


#: Rows that ``hit_rates`` looks at, and the least rate of a column that is picked.
LOOK, LEAST_RATE = 500, 0.5


def hit_rates(rows: DataFrame, pattern: str, columns: list[str] | None = None, order: list | None = None, look: int = LOOK) -> DataFrame:
    """(place, col, rate): how many of the first ``look`` values of each column match, in the order of
    columns; missing values do not. Without ``order`` the first rows are those that a scan gives first."""
    columns = columns or rows.columns
    first = (rows.orderBy(*order) if order else rows).limit(look)
    rate = lambda c: F.avg(F.coalesce(F.col(f"`{c}`").cast("string").rlike(pattern), F.lit(False)).cast("double"))
    got = first.agg(*[rate(c).alias(c) for c in columns]).unpivot([], [f"`{c}`" for c in columns], "col", "rate")
    return got.withColumn("place", F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("col"))).select("place", "col", "rate")


def picked(rates: DataFrame, least: float = LEAST_RATE) -> DataFrame:
    """The row of the best column, the first of equals; none below ``least``."""
    return rates.orderBy(F.desc("rate"), "place").limit(1).where(F.col("rate") >= least)


def pick_column(rows: DataFrame, pattern: str, **options) -> str:
    """Name of the column that holds values of the pattern; an error if none does often enough."""
    got = picked(hit_rates(rows, pattern, **options)).collect()
    if not got:
        raise ValueError("no column holds the pattern often enough")
    return got[0]["col"]
