"""Functions of a logit array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(logits: Column) -> Column:
    """0-based position of the largest value, the first one on ties; NaN is largest."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def cross_entropy(logits: Column, label: Column) -> Column:
    """``-log softmax(logits)[label]``, shifted by the maximum against overflow."""
    top = F.array_max(logits).cast("double")
    total = F.aggregate(
        logits, F.lit(0.0), lambda acc, z: acc + F.exp(z.cast("double") - top)
    )
    return F.log(total) + top - F.get(logits, label).cast("double")


def class_weight(weights: list[float], label: Column) -> Column:
    """The weight of a 0-based label."""
    return F.get(F.array(*[F.lit(float(w)) for w in weights]), label)
