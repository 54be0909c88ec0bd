"""Writers of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, sep: str = "\t", header: bool = True, compression: str = "none") -> None:
    df.write.option("sep", sep).option("header", header).option("compression", compression).option("nullValue", "").csv(path, mode="overwrite")


def write_lists(lists: DataFrame, path: str, scores: DataFrame | None = None) -> None:
    """(list_id, gene) with scores beside, one folder a list."""
    out = lists if scores is None else lists.join(scores, "gene", "left")
    out.write.partitionBy("list_id").parquet(path, mode="overwrite")


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Distinct non-empty (gene, category) pairs without a header."""
    write_table(pairs.where("gene <> '' and category <> ''").dropDuplicates(["gene", "category"]), path, header=False)


def write_by(df: DataFrame, column: str, path: str) -> None:
    """One folder for each value: a strain, a split."""
    df.write.partitionBy(column).parquet(path, mode="overwrite")


def stats_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def verified_write(df: DataFrame, path: str) -> DataFrame:
    """Write, read back, and fail unless both are equal."""
    df.write.parquet(path, mode="overwrite")
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    if not back.exceptAll(df).unionAll(df.exceptAll(back)).isEmpty():
        raise ValueError(f"{path} differs from what was written")
    return back


def write_list(genes: DataFrame, path: str, scores: DataFrame | None = None) -> None:
    """One list with its scores beside; an empty list is a file with its header."""
    out = genes.select("gene").distinct()
    write_table(out if scores is None else out.join(scores, "gene", "left"), path)


def write_linkage(merges: DataFrame, path: str) -> None:
    """The merges of a clustering in order; few rows, so one file."""
    merges.coalesce(1).sortWithinPartitions("step").write.parquet(path, mode="overwrite")


def write_split_map(rows: DataFrame, path: str, gene: str = "gene", split: str = "split") -> None:
    """Distinct (gene, split) pairs."""
    write_table(rows.select(gene, split).distinct(), path)


def write_nonzero(pairs: DataFrame, path: str, value: str) -> None:
    """Gzip table of the rows whose value is neither null nor zero."""
    write_table(pairs.where(F.col(value) != 0), path, compression="gzip")
