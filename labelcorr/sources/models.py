"""Saving and loading fitted models with what is known about them."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META_SCHEMA = "axis string, fold int, candidate int, f1 double, loss double, accuracy double"


def model_name(axis: str, fold: int, candidate: int) -> str:
    """Folder of a model; its scores are stored with it, not in the name."""
    return f"{axis}-fold-{fold}-candidate-{candidate}"


def save_model(
    spark: SparkSession,
    model: PipelineModel,
    directory: str,
    axis: str,
    fold: int = 0,
    candidate: int = 0,
    f1: float = 0.0,
    loss: float | None = None,
    accuracy: float | None = None,
) -> str:
    """Save the model and one row about it; returns the path."""
    path = f"{directory.rstrip('/')}/{model_name(axis, fold, candidate)}"
    model.write().overwrite().save(f"{path}/model")
    values = (axis, fold, candidate, f1, loss, accuracy)
    spark.createDataFrame([values], META_SCHEMA).write.mode("overwrite").json(f"{path}/about")
    return path


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """The model and what was stored about it."""
    about = spark.read.schema(META_SCHEMA).json(f"{path}/about").first()
    return PipelineModel.load(f"{path}/model"), about.asDict()


def list_models(spark: SparkSession, directory: str) -> DataFrame:
    """The stored rows of all models of a folder, best F1 first."""
    about = spark.read.schema(META_SCHEMA).json(f"{directory.rstrip('/')}/*/about")
    path = F.regexp_extract(F.input_file_name(), r"^(.*)/about/[^/]*$", 1)
    return about.withColumn("path", path).orderBy(F.col("f1").desc(), "path")
