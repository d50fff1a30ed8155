"""Row filters, projections and row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelcorr.functions import labels as L
from labelcorr.functions.parse import unpacked
from labelcorr.session import broadcast_if_small, checkpointed

# The fields of a post.
POST_SCHEMA = T.StructType().add("content", "string").add("account_category", "string")

MAX_BROADCAST_PARTITIONS = 100_000
POSITION_BITS = 33


def project(df: DataFrame, text_col: str, label_col: str, *keep: str) -> DataFrame:
    """One text and one label column, plus the columns to keep."""
    return df.select(
        *keep, F.col(text_col).alias("content"), F.col(label_col).alias("label")
    )


def drop_non_text(df: DataFrame, text_col: str = "content") -> DataFrame:
    """Drop whole rows without a text, so texts and labels stay aligned."""
    return df.filter(F.col(text_col).isNotNull())


def parse_json(
    df: DataFrame, schema: T.StructType | str = POST_SCHEMA, value_col: str = "value", *keep: str
) -> DataFrame:
    """Expand a JSON text column into the fields of ``schema``, plus the columns to keep."""
    return df.select(*keep, unpacked(F.from_json(value_col, schema)))


def fill_missing(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.withColumn(column, L.fill_missing(F.col(column), value))


def rows_in_fold(
    df: DataFrame, fold: int, train: bool = False, fold_col: str = "fold"
) -> DataFrame:
    """The test rows of a fold, or its train rows."""
    in_fold = F.col(fold_col) == fold
    return df.filter(~in_fold if train else in_fold)


def add_row_id(
    df: DataFrame,
    order_by: list[str | Column],
    unique: bool = True,
    id_col: str = "id",
) -> DataFrame:
    """Number the rows 0..n-1 in the given order.

    The rows are range-partitioned and sorted, then checkpointed with their
    partition number and position, so a lost executor cannot renumber them.
    The id is the position plus the row count of the earlier partitions: no
    task ever holds more than its own range.

    ``unique=False`` allows ties in ``order_by``. The input position then
    breaks them, fixed by a checkpoint of its own, and lets the range
    partitioning split a value that many rows share.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    if not unique:
        df = checkpointed(df.withColumn("_tie", F.monotonically_increasing_id()))
        order.append(F.col("_tie"))
    position = F.monotonically_increasing_id().bitwiseAND((1 << POSITION_BITS) - 1)
    placed = checkpointed(
        df.orderBy(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", position)
        .drop("_tie")
    )
    # One row per partition, so the window without a partition key is small.
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return (
        placed.join(broadcast_if_small(offsets, MAX_BROADCAST_PARTITIONS), "_part")
        .withColumn(id_col, F.col("_offset") + F.col("_pos"))
        .select(id_col, *[c for c in df.columns if c != "_tie"])
    )
