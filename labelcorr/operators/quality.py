"""Accuracy, F1 and loss of scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelcorr.functions.scores import argmax, class_weight, cross_entropy
from labelcorr.operators.matrix import confusion_counts

# Class weights: a list by class, a table (label, weight), or none for equal weights.
Weights = Sequence[float] | DataFrame | None


def prediction_table(scored: DataFrame, key: str, logits: str = "logits") -> DataFrame:
    """``(ids, pred)``: the class with the largest logit of each row."""
    return scored.select(F.col(key).alias("ids"), argmax(F.col(logits)).alias("pred"))


def order_by_id(predictions: DataFrame, key: str = "ids") -> DataFrame:
    return predictions.orderBy(key)


def attach_truth(predictions: DataFrame, labels: DataFrame, key: str, truth: str) -> DataFrame:
    """Predictions with their true label, by key."""
    wanted = labels.select(F.col(key).alias("ids"), F.col(truth).alias("truth"))
    return predictions.join(wanted, "ids")


def accuracy(counts: DataFrame) -> DataFrame:
    """``(accuracy)`` from confusion counts."""
    return counts.agg(_accuracy().alias("accuracy"))


def micro_f1(counts: DataFrame) -> DataFrame:
    """``(micro_f1)`` from confusion counts."""
    return counts.agg(_micro_f1().alias("micro_f1"))


def score_counts(
    scored: DataFrame, truth: str = "truth", logits: str = "logits"
) -> DataFrame:
    """``(given, pred, n, nll)``: what every metric and matrix needs, in one pass.

    One row per pair of classes, so weights, loss, F1 and distributions all
    follow from this small table without another look at the rows.
    """
    rows = scored.select(
        F.col(truth).alias("truth"),
        argmax(F.col(logits)).alias("pred"),
        cross_entropy(F.col(logits), F.col(truth)).alias("nll"),
    )
    return confusion_counts(rows, "truth", "pred", F.sum("nll").alias("nll"))


def weighted_cross_entropy(counts: DataFrame, weights: Weights = None) -> DataFrame:
    """``(loss)`` from score counts: sum of weight x loss over sum of weights."""
    return _weighted(counts, weights).agg(_loss().alias("loss"))


def evaluate(
    counts: DataFrame, weights: Weights = None, *by: str, sums: Sequence[Column] = ()
) -> DataFrame:
    """``(examples, loss, micro_f1, accuracy)`` from score counts, per ``by`` if given.

    ``sums`` are further aggregates. Rows whose ``n`` is NULL count in these alone.
    """
    return _weighted(counts, weights).groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("examples"),
        _loss().alias("loss"),
        _micro_f1().alias("micro_f1"),
        _accuracy().alias("accuracy"),
        *sums,
    )


def mean_batch_loss(
    scored: DataFrame,
    batch: str,
    weights: Sequence[float],
    truth: str = "truth",
    logits: str = "logits",
) -> DataFrame:
    """``(loss, steps)``: the plain mean of the weighted loss of each batch."""
    weight = class_weight(list(weights), F.col(truth))
    per_batch = scored.groupBy(batch).agg(
        F.try_divide(
            F.sum(weight * cross_entropy(F.col(logits), F.col(truth))), F.sum(weight)
        ).alias("_loss")
    )
    return per_batch.agg(F.avg("_loss").alias("loss"), F.count("*").alias("steps"))


def _right() -> Column:
    return F.sum(F.when(F.col("given") == F.col("pred"), F.col("n")).otherwise(0))


def _accuracy() -> Column:
    return F.try_divide(_right().cast("double"), F.sum("n"))


def _micro_f1() -> Column:
    # Each wrong row is a false positive of one class and a false negative of another.
    wrong = F.sum("n") - _right()
    return F.try_divide(2.0 * _right(), 2 * _right() + 2 * wrong)


def _weighted(counts: DataFrame, weights: Weights) -> DataFrame:
    """Attach the weight of the given class to score counts, not to the rows.

    A class that occurs but has no weight is an error, whether weights are a
    list or a table.
    """
    if weights is None:
        return counts.withColumn("weight", F.lit(1.0))
    if isinstance(weights, DataFrame):
        # One row per class of the axis, as class_weights returns it.
        by_class = weights.select(F.col("label").alias("_label"), "weight")
        joined = counts.join(
            F.broadcast(by_class), F.col("given").eqNullSafe(F.col("_label")), "left"
        ).drop("_label")
    else:
        joined = counts.withColumn("weight", class_weight(list(weights), F.col("given")))
    refused = F.raise_error(
        F.concat(F.lit("no weight for class "), F.coalesce(F.col("given").cast("string"), F.lit("NULL")))
    )
    weight = F.when(F.col("weight").isNull() & (F.col("n") > 0), refused.cast("double")).otherwise(F.col("weight"))
    return joined.withColumn("weight", weight)


def _loss() -> Column:
    return F.try_divide(
        F.sum(F.col("weight") * F.col("nll")), F.sum(F.col("weight") * F.col("n"))
    )
