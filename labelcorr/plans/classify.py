"""Training, choosing and applying a classifier."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelcorr.functions.parse import unpacked
from labelcorr.functions.scores import class_weight
from labelcorr.functions.tokens import WORD_GAPS
from labelcorr.operators.counts import weight_list
from labelcorr.operators.quality import evaluate, score_counts
from labelcorr.session import kept, remove, scratch_path


@dataclass(frozen=True)
class Settings:
    """What one candidate classifier is trained with."""

    features: int = 1 << 16
    max_iter: int = 30
    reg: float = 0.01
    tree_depth: int = 2


# A task of a step of the optimizer works on so many partitions at most, once there is one for each core.
PARTS_A_TASK = 16


@dataclass
class Choice:
    """The chosen model, its place among the candidates and its held-out scores."""

    model: PipelineModel
    candidate: int
    examples: int
    f1: float
    loss: float
    accuracy: float
    weights: list[float]
    tried: list[dict] = field(default_factory=list)

    def scores(self, spark: SparkSession) -> DataFrame:
        """``(candidate, examples, loss, micro_f1, accuracy)``, one row per candidate."""
        rows = [(t["candidate"], t["examples"], t["loss"], t["f1"], t["accuracy"]) for t in self.tried]
        schema = "candidate int, examples bigint, loss double, micro_f1 double, accuracy double"
        return spark.createDataFrame(rows, schema)


def tfidf_features(settings: Settings = Settings(), text: str = "content") -> list:
    """Stages from text to a TF-IDF vector; hashing keeps no vocabulary anywhere."""
    return [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=WORD_GAPS),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=settings.features),
        IDF(inputCol="_tf", outputCol="_features"),
    ]


def classifier(settings: Settings, label: str = "label") -> LogisticRegression:
    return LogisticRegression(
        featuresCol="_features",
        labelCol=label,
        weightCol="_weight",
        family="multinomial",
        maxIter=settings.max_iter,
        regParam=settings.reg,
        aggregationDepth=settings.tree_depth,
        rawPredictionCol="_raw",
        probabilityCol="_probability",
        predictionCol="_prediction",
    )


def fitted_on(rows: DataFrame, estimator: LogisticRegression) -> LogisticRegressionModel:
    """The fitted model as a saved one is loaded, without its training summary.

    The summary of a model of two classes holds the session, which would travel
    with every task that scores; whether it can be serialised depends on what
    the session did before.
    """
    model = estimator.fit(in_few_parts(rows))
    if model.numClasses > 2:
        return model
    path = scratch_path(rows.sparkSession, "fitted")
    model.save(path)
    try:
        return LogisticRegressionModel.load(path)
    finally:
        remove(rows.sparkSession, path)


def in_few_parts(rows: DataFrame) -> DataFrame:
    """Kept rows in about as many partitions as there are cores, where they are.

    Each step of the optimizer sends a gradient, a number per feature and class,
    from every partition. With a partition per few MB of text these cost more
    than the rows.
    """
    parts = rows.rdd.getNumPartitions()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(max(cores, -(-parts // PARTS_A_TASK)))


def hashed(df: DataFrame, stages: list, *columns: str) -> DataFrame:
    """Term counts of the texts, the form in which a training set is kept."""
    tokenizer, counter, _ = stages
    return counter.transform(tokenizer.transform(df)).select("_tf", *columns)


def weighted(df: DataFrame, label: str, weights: Sequence[float]) -> DataFrame:
    return df.withColumn("_weight", class_weight(list(weights), F.col(label)))


def train_classifier(
    df: DataFrame,
    classes: Sequence[int],
    settings: Settings = Settings(),
    text: str = "content",
    label: str = "label",
) -> PipelineModel:
    """Fit a class-weighted multinomial classifier of ``text``.

    The texts are read and cut into words once; the weights, the IDF and the
    optimizer work on the kept term counts.
    """
    stages = tfidf_features(settings, text)
    with kept(hashed(df, stages, label)) as counts:
        idf = stages[2].fit(counts)
        rows = weighted(idf.transform(counts), label, weight_list(counts, label, classes))
        fitted = fitted_on(rows, classifier(settings, label))
    return PipelineModel([*stages[:2], idf, fitted])


def select_best(
    train: DataFrame,
    holdout: DataFrame,
    classes: Sequence[int],
    candidates: Sequence[Settings],
    text: str = "content",
    label: str = "label",
    parallelism: int = 2,
) -> Choice:
    """Train each candidate and keep the one with the highest micro F1 on ``holdout``.

    The first one wins ties. Candidates with the same feature size share the
    kept term counts of both sets; ``parallelism`` of them are fitted at a time.
    A candidate is scored by one aggregate.
    """
    best, tried, weights = None, [], None
    for size in dict.fromkeys(s.features for s in candidates):
        same = [(i, s) for i, s in enumerate(candidates) if s.features == size]
        stages = tfidf_features(same[0][1], text)
        with (
            kept(hashed(train, stages, label)) as train_counts,
            kept(hashed(holdout, stages, label)) as holdout_counts,
            ThreadPool(max(1, min(parallelism, len(same)))) as pool,
        ):
            idf = stages[2].fit(train_counts)
            weights = weights or weight_list(train_counts, label, classes)
            rows = weighted(idf.transform(train_counts), label, weights)
            checked = idf.transform(holdout_counts)
            holdout_counts.count()  # kept before several read it at once

            @inheritable_thread_target(train.sparkSession)
            def score(settings: Settings, rows: DataFrame = rows, checked: DataFrame = checked):
                fitted = fitted_on(rows, classifier(settings, label))
                scored = with_logits(fitted.transform(checked), len(classes))
                return fitted, evaluate(score_counts(scored, label), weights).first()

            for (i, _), (fitted, found) in zip(same, pool.map(score, [s for _, s in same])):
                scores = {
                    "candidate": i,
                    "examples": found["examples"],
                    "f1": found["micro_f1"] or 0.0,
                    "loss": found["loss"],
                    "accuracy": found["accuracy"],
                }
                tried.append(scores)
                if best is None or (-scores["f1"], i) < (-best.f1, best.candidate):
                    model = PipelineModel([*stages[:2], idf, fitted])
                    best = Choice(model, weights=weights, **scores)
    best.tried = sorted(tried, key=lambda s: s["candidate"])
    return best


def cross_validate(
    df: DataFrame,
    classes: Sequence[int],
    regs: Sequence[float],
    folds: int = 5,
    settings: Settings = Settings(),
    text: str = "content",
    label: str = "label",
    fold_col: str = "fold",
    parallelism: int = 2,
) -> tuple[PipelineModel, list[float]]:
    """Choose ``reg`` over the given folds by accuracy, which is micro F1 here.

    Returns the model fitted on all rows and the mean score of each ``reg``; the
    first one wins ties. The IDF of a fold is shared by its models, of which
    ``parallelism`` are fitted at a time; no row leaves the JVM.
    """
    stages = tfidf_features(settings, text)
    fold = F.col(fold_col)
    with kept(hashed(df, stages, label, fold_col)) as counts:
        refuse_folds(counts, fold_col, folds)
        rows = weighted(counts, label, weight_list(counts, label, classes))
        found: list[list[float]] = []
        with ThreadPool(max(1, min(parallelism, len(regs)))) as pool:
            for i in range(folds):
                train, held = rows.filter(fold != i), rows.filter(fold == i)
                idf = stages[2].fit(train)
                told, checked = idf.transform(train), idf.transform(held)

                @inheritable_thread_target(df.sparkSession)
                def score(reg: float, told: DataFrame = told, checked: DataFrame = checked) -> float:
                    fitted = fitted_on(told, classifier(replace(settings, reg=reg), label))
                    right = F.avg((F.col("_prediction") == F.col(label)).cast("double"))
                    return fitted.transform(checked).agg(right).first()[0]

                found.append(pool.map(score, regs))
        means = [sum(of_reg) / folds for of_reg in zip(*found)]
        idf = stages[2].fit(rows)
        best = replace(settings, reg=regs[means.index(max(means))])
        fitted = fitted_on(idf.transform(rows), classifier(best, label))
    return PipelineModel([*stages[:2], idf, fitted]), means


def refuse_folds(df: DataFrame, fold_col: str, folds: int) -> None:
    """Raise if a row is in none of the folds 0 to ``folds - 1``, or a fold has no rows or all."""
    sizes = [F.count_if(F.col(fold_col) == i).alias(f"_{i}") for i in range(folds)]
    total, *of_fold = df.agg(F.count("*"), *sizes).first()
    if sum(of_fold) != total:
        raise ValueError(f"{total - sum(of_fold)} rows are in no fold from 0 to {folds - 1}")
    for i, n in enumerate(of_fold):
        if n in (0, total):
            raise ValueError(f"fold {i} holds {n} of {total} rows")


def with_logits(scored: DataFrame, n_classes: int | None = None) -> DataFrame:
    """The raw scores of a fitted classifier as a ``logits`` array.

    Classes above the largest one in training have no score; they get a
    logit of minus infinity.
    """
    logits = vector_to_array("_raw")
    if n_classes is not None:
        missing = F.greatest(F.lit(n_classes) - F.size(logits), F.lit(0))
        logits = F.concat(logits, F.array_repeat(F.lit(float("-inf")), missing))
    rest = [c for c in scored.columns if not c.startswith("_")]
    return scored.select(*rest, _scored_once(logits))


def _scored_once(logits: Column) -> Column:
    """As a generator's output, so no later filter runs the model a second time."""
    return unpacked(F.struct(logits.alias("logits")))


def predict(df: DataFrame, model: PipelineModel, n_classes: int | None = None) -> DataFrame:
    """Add ``logits`` to every row of ``df``, batch or stream; no shuffle."""
    return with_logits(model.transform(df), n_classes)


def predict_with(
    df: DataFrame,
    make_scorer: Callable,
    inputs: Sequence[str],
    batch_size: int = 1024,
    input_shapes: list | None = None,
) -> DataFrame:
    """Add ``logits`` from any scorer over NumPy batches.

    ``make_scorer`` runs once per Python worker, so a model is loaded there
    once, and returns a function from input arrays to an array of logits.
    """
    score = predict_batch_udf(
        make_scorer,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=input_shapes,
    )
    return df.select("*", _scored_once(score(*inputs)))
