"""The batch jobs, from posts to scores and matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelcorr.functions.labels import LabelAxis
from labelcorr.functions.scores import argmax
from labelcorr.functions.text import normalize_text
from labelcorr.operators.matrix import distribution_matrix, name_matrix
from labelcorr.operators.rows import drop_non_text
from labelcorr.plans.classify import Choice, Settings, predict, select_best


def prepare(
    posts: DataFrame,
    axis: LabelAxis,
    text: str = "content",
    category: str = "account_category",
    default: int | None = None,
    normalize: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(content, label)`` ready for training or scoring, plus the columns to keep."""
    return drop_non_text(posts, text).select(
        *keep,
        normalize_text(F.col(text), normalize).alias("content"),
        axis.encode(F.col(category), default).alias("label"),
    )


def train_and_evaluate(
    train: DataFrame,
    test: DataFrame,
    axis: LabelAxis,
    candidates: Sequence[Settings] = (Settings(),),
) -> Choice:
    """Choose a classifier on prepared posts by its scores on ``test``."""
    return select_best(train, test, axis.classes, candidates)


def predicted_matrix(
    posts: DataFrame,
    model: PipelineModel,
    given: str,
    given_axis: LabelAxis,
    pred_axis: LabelAxis,
    text: str = "content",
) -> DataFrame:
    """P(predicted label | given label) with names, for every pair of classes.

    ``given`` is an encoded column of ``posts``. It is carried through scoring,
    so predictions and labels need no join. With a model of another data set
    this relates the labels of two sources.
    """
    scored = predict(posts.select(F.col(text).alias("content"), given), model)
    rows = scored.select(given, argmax(F.col("logits")).alias("pred"))
    matrix = distribution_matrix(rows, given, "pred", given_axis.classes, pred_axis.classes)
    return name_matrix(matrix, given_axis, pred_axis)
