"""Posts with several labels each: one model per label over shared text features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelcorr.functions.parse import unpacked
from labelcorr.plans.classify import Settings, classifier, fitted_on, hashed, tfidf_features
from labelcorr.session import kept


@dataclass(frozen=True)
class MultiLabelModel:
    """Text features, then for each label its binary model, or the one answer it always has."""

    features: PipelineModel
    labels: tuple[object, ...]


def train_multi_label(
    df: DataFrame,
    n_labels: int,
    settings: Settings = Settings(),
    text: str = "content",
    labels: str = "labels",
) -> MultiLabelModel:
    """Fit one model per label 0 to ``n_labels - 1`` from arrays of labels.

    Texts are cut into words once and their TF-IDF is kept for all models; each
    weighs rows so that those with and without its label count the same. A NULL
    array holds no label; labels outside the range raise. A label that all rows
    or none have needs no model.
    """
    stages = tfidf_features(settings, text)
    with kept(hashed(df, stages, labels)) as counts:
        refuse_outside(counts, labels, n_labels)
        idf = stages[2].fit(counts)
        has = [_has(labels, k) for k in range(n_labels)]
        totals = counts.agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"_{k}") for k, c in enumerate(has)])
        n, *own = totals.first()
        with kept(idf.transform(counts).select("_features", labels)) as rows:
            fitted = [
                bool(n) and own[k] == n if own[k] in (0, n) else _fitted(rows, has[k], own[k] / n, settings)
                for k in range(n_labels)
            ]
    return MultiLabelModel(PipelineModel([*stages[:2], idf]), tuple(fitted))


def _fitted(rows: DataFrame, has: Column, share: float, settings: Settings):
    weight = F.when(has, 0.5 / share).otherwise(0.5 / (1 - share))
    told = rows.withColumns({"label": has.cast("double"), "_weight": weight})
    return fitted_on(told, classifier(settings).setFamily("binomial"))


def predict_multi_label(
    df: DataFrame, model: MultiLabelModel, text: str = "content", predicted: str = "predicted"
) -> DataFrame:
    """Add the sorted array of the labels that are likelier than not; a NULL text is an empty one."""
    rows = model.features.transform(df.withColumn(text, F.coalesce(text, F.lit(""))))
    votes = []
    for k, one in enumerate(model.labels):
        if isinstance(one, bool):
            votes.append(F.when(F.lit(one), F.lit(k)))
            continue
        one = one.copy()
        one.setRawPredictionCol(f"_raw{k}").setProbabilityCol(f"_p{k}").setPredictionCol(f"_is{k}")
        rows = one.transform(rows)
        votes.append(F.when(vector_to_array(f"_p{k}")[1] > 0.5, F.lit(k)))
    found = F.array_compact(F.array(*votes)).cast("array<int>")
    # Out of a generator: the models run once per row, whatever is asked of the labels.
    told = F.struct(found.alias(predicted))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], unpacked(told))


def label_counters(
    df: DataFrame, n_labels: int, truth: str = "labels", predicted: str = "predicted"
) -> DataFrame:
    """``(label, both, only_predicted, only_true)`` for every label, in one aggregate.

    Counters per label leave each task as one row; no array is exploded. Repeated
    labels of an array count once, NULL arrays hold none.
    """
    sums, rows = [], []
    for k in range(n_labels):
        real, said = _has(truth, k), _has(predicted, k)
        for name, hit in (("both", real & said), ("only_predicted", said & ~real), ("only_true", real & ~said)):
            sums.append(F.count_if(hit).alias(f"{name}{k}"))
        names = ("both", "only_predicted", "only_true")
        rows.append(F.struct(F.lit(k).alias("label"), *[F.col(f"{c}{k}").alias(c) for c in names]))
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def multi_label_scores(counters: DataFrame) -> DataFrame:
    """``(precision, recall, micro_f1)`` over all labels together."""
    both, said, real = (F.sum(c) for c in ("both", "only_predicted", "only_true"))
    return counters.agg(
        F.try_divide(both.cast("double"), both + said).alias("precision"),
        F.try_divide(both.cast("double"), both + real).alias("recall"),
        F.try_divide(2.0 * both, 2 * both + said + real).alias("micro_f1"),
    )


def refuse_outside(df: DataFrame, labels: str, n_labels: int) -> None:
    """Raise if an array holds a label that is not 0 to ``n_labels - 1``, or NULL."""
    outside = F.exists(labels, lambda x: x.isNull() | (x < 0) | (x >= n_labels))
    found = df.filter(outside).select(labels).limit(1).collect()
    if found:
        raise ValueError(f"labels outside 0 to {n_labels - 1}: {found[0][0]}")


def _has(labels: str, k: int) -> Column:
    return F.coalesce(F.array_contains(labels, k), F.lit(False))


def label_sets(codes: Sequence[Column]) -> Column:
    """An array of the codes that are not NULL, each once."""
    return reduce(F.array_union, [F.array_compact(F.array(c)) for c in codes])
