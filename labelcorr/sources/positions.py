"""Rows numbered by where they stand in files, and tables joined row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelcorr.session import broadcast_if_small

MAX_BROADCAST_FILES = 100_000


def read_numbered(spark: SparkSession, path: str, id_col: str = "id") -> DataFrame:
    """The rows of a Parquet table with their number: files by name, rows as they stand.

    A row's number is its place in its file plus the rows of the files before
    it. Nothing is sorted or moved; only a count per file is gathered, which
    the footers hold. A table that is written again may number rows anew.
    """
    rows = spark.read.parquet(path)
    file = F.col("_metadata.file_path").alias("_file")
    sizes = rows.groupBy(file).agg(F.count("*").alias("_n"))
    # One row per file, so the window without a partition key is small.
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = rows.select("*", file, F.col("_metadata.row_index").alias("_at"))
    joined = placed.join(broadcast_if_small(offsets, MAX_BROADCAST_FILES), "_file")
    names = [c for c in rows.columns if c != id_col]
    return joined.select((F.col("_before") + F.col("_at")).alias(id_col), *[f"`{c}`" for c in names])


def join_by_position(spark: SparkSession, left: str, right: str, id_col: str = "id") -> DataFrame:
    """``(id, ...)``: the rows of two Parquet tables side by side, by their numbers.

    For predictions written in the order of their texts. Tables of different
    lengths raise, as do columns of the same name: both would pair the wrong values.
    """
    sizes = [spark.read.parquet(path).count() for path in (left, right)]
    if sizes[0] != sizes[1]:
        raise ValueError(f"{left} has {sizes[0]} rows, {right} has {sizes[1]}")
    sides = [read_numbered(spark, path, id_col) for path in (left, right)]
    both = sorted((set(sides[0].columns) & set(sides[1].columns)) - {id_col})
    if both:
        raise ValueError(f"both tables have {', '.join(both)}")
    return sides[0].join(sides[1], id_col)
