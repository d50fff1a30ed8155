"""Class counts and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelcorr.functions.labels import POLITICAL_BIAS, LabelAxis


def class_counts(df: DataFrame, label: str | Column, order: Sequence) -> DataFrame:
    """``(position, label, n, total)`` for each class in the given order, 0 if absent.

    One global aggregate with a counter per class: every task sends one row,
    whatever the skew of the labels. ``total`` counts all rows, also those
    outside ``order``.
    """
    label = F.col(label) if isinstance(label, str) else label
    counters = [F.count_if(label == F.lit(c)).alias(f"n{i}") for i, c in enumerate(order)]
    one_row = df.agg(F.count("*").alias("total"), *counters)
    cells = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("label"),
            F.col(f"n{i}").alias("n"),
            F.col("total"),
        )
        for i, c in enumerate(order)
    ]
    return one_row.select(F.inline(F.array(*cells)))


def category_counts(df: DataFrame, category: str, key: str) -> DataFrame:
    """``(category, n, first)``: count and smallest key of every distinct value."""
    return df.groupBy(F.col(category).alias("category")).agg(
        F.count("*").alias("n"), F.min(key).alias("first")
    )


def distinct_categories(df: DataFrame, category: str, key: str) -> DataFrame:
    """The distinct values in the order they first appear."""
    return category_counts(df, category, key).orderBy("first").select("category")


def merged_counts(
    df: DataFrame, category: str, axis: LabelAxis = POLITICAL_BIAS, other: int = 1
) -> DataFrame:
    """``(name, n)`` of the merged classes; unknown categories count as ``other``."""
    code = axis.encode(F.col(category), default=other)
    counts = class_counts(df, code, axis.classes)
    return counts.select(axis.decode(F.col("label")).alias("name"), "n")


def class_weights(
    df: DataFrame, label: str, classes: Sequence[int], strict: bool = False
) -> DataFrame:
    """``(label, n, weight)`` with weight ``N / n``.

    A class without rows has a NULL weight, or raises when ``strict``.
    """
    weight = F.try_divide(F.col("total").cast("double"), F.col("n"))
    if strict:
        absent = F.concat(F.lit("no rows of class "), F.col("label").cast("string"))
        weight = F.when(F.col("n") == 0, F.raise_error(absent).cast("double")).otherwise(weight)
    return class_counts(df, label, classes).select("label", "n", weight.alias("weight"))


def weights_of_counts(counts: DataFrame, label: str, classes: Sequence[int]) -> DataFrame:
    """``class_weights`` from a small table of counts ``n``, without another look at the rows."""
    of_class = [
        F.sum(F.when(F.col(label) == F.lit(c), F.col("n"))).alias(f"n{i}")
        for i, c in enumerate(classes)
    ]
    cells = [
        F.struct(
            F.lit(c).alias("label"),
            F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("n"),
            F.try_divide(F.col("total").cast("double"), F.col(f"n{i}")).alias("weight"),
        )
        for i, c in enumerate(classes)
    ]
    return counts.agg(F.sum("n").alias("total"), *of_class).select(F.inline(F.array(*cells)))


def weight_list(
    df: DataFrame, label: str, classes: Sequence[int], strict: bool = True
) -> list[float]:
    """The weights on the driver, one number per class."""
    rows = class_weights(df, label, classes, strict).collect()
    found = {r["label"]: r["weight"] for r in rows}
    return [float("nan") if found[c] is None else found[c] for c in classes]


def example_and_batch_counts(df: DataFrame, batch_size: int = 8) -> DataFrame:
    """``(examples, steps)`` of one pass over the rows."""
    return df.agg(F.count("*").alias("examples")).select(
        "examples", F.ceil(F.col("examples") / F.lit(batch_size)).alias("steps")
    )
