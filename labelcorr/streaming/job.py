"""Scoring a stream of posts and correlating labels per micro-batch.

Parsing, cleaning, encoding, splitting and scoring are stateless and run on
the stream itself. Only the small result table of a batch is made in
``foreachBatch``.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from labelcorr.functions.labels import LENIENT_BIAS_DEFAULT, POLITICAL_BIAS, LabelAxis
from labelcorr.functions.parse import unpacked
from labelcorr.functions.scores import argmax, class_weight, cross_entropy
from labelcorr.functions.text import normalize_text
from labelcorr.operators.matrix import conditional_distribution, confusion_counts, dense_matrix
from labelcorr.operators.quality import Weights, evaluate, prediction_table
from labelcorr.operators.rows import POST_SCHEMA
from labelcorr.operators.splits import mark_split
from labelcorr.plans.classify import predict
from labelcorr.session import kept
from labelcorr.sources.sinks import (
    compact_batches,
    read_batches,
    read_latest,
    refuse_foreign_results,
    write_batch,
    write_latest,
    write_predictions,
)

CORRUPT = "_corrupt_line"
COUNTS = "given int, pred int, n bigint, nll double, corrupt bigint, no_text bigint"
OBSERVED = "examples bigint, right bigint, weight double, weighted double, corrupt bigint, no_text bigint"


@dataclass(frozen=True)
class StreamSettings:
    """Label axis, text cleaning and test share of a streaming job.

    With ``distinct_within``, a time such as ``1 hour``, a test post counts once
    although copies of it arrive, in the same or later batches, until that time
    after the first: the test rows are a set difference. Keys are forgotten
    after it, so the state stays bounded.
    """

    axis: LabelAxis = POLITICAL_BIAS
    default: int | None = LENIENT_BIAS_DEFAULT
    normalize: bool = True
    train_fraction: float = 0.8
    seed: int = 42
    schema: T.StructType = POST_SCHEMA
    distinct_within: str | None = None


def stream_parse(lines: DataFrame, schema: T.StructType = POST_SCHEMA) -> DataFrame:
    """The fields of each JSON line, ``corrupt`` if it is no JSON of them, ``no_text`` if it
    could be read but holds no text."""
    fields = schema.fieldNames()
    whole = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = lines.select(unpacked(F.from_json("value", whole, options)))
    corrupt = F.col(CORRUPT).isNotNull()
    return parsed.select(
        *fields, corrupt.alias("corrupt"), (~corrupt & F.col("content").isNull()).alias("no_text")
    )


def stream_posts(lines: DataFrame, settings: StreamSettings = StreamSettings()) -> DataFrame:
    """``(content, label, in_train, corrupt, no_text)``: parsed, split, cleaned and encoded.

    Lines that cannot be read or hold no text stay, to be counted.
    """
    parsed = stream_parse(lines, settings.schema)
    keys = settings.schema.fieldNames()
    split = mark_split(parsed, *keys, fraction=settings.train_fraction, seed=settings.seed)
    label = settings.axis.encode(F.col("account_category"), settings.default)
    row = F.sha2(F.to_json(F.struct(*keys)), 256)
    return split.select(
        normalize_text(F.col("content"), settings.normalize).alias("content"),
        F.when(_is_post(), label).alias("label"),
        "in_train",
        "corrupt",
        "no_text",
        *([row.alias("_row")] if settings.distinct_within else []),
    )


def _is_post() -> Column:
    return ~(F.col("corrupt") | F.col("no_text"))


def stream_predict(posts: DataFrame, model: PipelineModel, n_classes: int) -> DataFrame:
    """Add ``logits``; lines without a post are passed as an empty text."""
    texts = posts.withColumn("content", F.coalesce("content", F.lit("")))
    return predict(texts, model, n_classes)


def tested(posts: DataFrame) -> DataFrame:
    """The test posts of a stream, and its lines without a post."""
    return posts.filter(~_is_post() | ~F.col("in_train"))


def without_copies(posts: DataFrame, within: str) -> DataFrame:
    """One of each post of a stream (by ``_row``, the digest of its fields) in a time.

    A keyed state holds the digests, spread by key, and drops each of them when
    ``within`` has gone by since the post arrived. Lines without a post all stay.
    """
    arrived = posts.withColumn("_arrived", F.current_timestamp())
    own = F.when(_is_post(), F.col("_row")).otherwise(F.expr("uuid()"))
    keyed = arrived.withColumn("_row", own)
    once = keyed.withWatermark("_arrived", within).dropDuplicatesWithinWatermark(["_row"])
    return once.drop("_arrived", "_row")


def _scored(lines: DataFrame, score: Callable, settings: StreamSettings) -> DataFrame:
    posts = tested(stream_posts(lines, settings))
    if settings.distinct_within:
        posts = without_copies(posts, settings.distinct_within)
    return score(posts)


def batch_counts(scored: DataFrame) -> DataFrame:
    """``(given, pred, n, nll, corrupt, no_text)`` over the scored test posts of a batch.

    Lines without a post appear as one row without labels, with their numbers in
    ``corrupt`` and ``no_text``.
    """
    rows = scored.select(
        F.when(_is_post(), F.col("label")).alias("label"),
        F.when(_is_post(), argmax(F.col("logits"))).alias("pred"),
        F.when(_is_post(), cross_entropy(F.col("logits"), F.col("label"))).alias("nll"),
        "corrupt",
        "no_text",
    )
    return confusion_counts(
        rows,
        "label",
        "pred",
        F.sum("nll").alias("nll"),
        F.count_if("corrupt").alias("corrupt"),
        F.count_if("no_text").alias("no_text"),
    )


def run_stream(
    lines: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    result_path: str,
    checkpoint: str,
    settings: StreamSettings = StreamSettings(),
    predictions_path: str | None = None,
    trigger: dict | None = None,
    name: str | None = None,
    metrics: BatchMetrics | None = None,
) -> StreamingQuery:
    """Start the job: each micro-batch writes its counts, and its predictions if asked.

    ``score`` adds ``logits`` to the test posts and runs on the stream, so a
    model is loaded once. Results go to one folder per batch; a batch that is run
    again after a failure replaces its folder. A result folder that another
    checkpoint has filled is refused. ``ids`` of predictions are unique within
    their batch. ``trigger`` holds the arguments of
    ``DataStreamWriter.trigger``. ``metrics`` gets the scores of each batch while
    it is written, without another pass.
    """
    spark = lines.sparkSession
    refuse_foreign_results(spark, result_path, checkpoint)
    scored = _scored(lines, score, settings)
    if metrics is not None:
        scored = metrics.observed(scored)

    def write_counts(batch: DataFrame, batch_id: int) -> None:
        # A row per pair of classes: one file is enough.
        write_batch(batch_counts(batch).coalesce(1), result_path, batch_id)

    def write(batch: DataFrame, batch_id: int) -> None:
        if predictions_path is None:
            write_counts(batch, batch_id)
            return
        with kept(batch) as rows:
            write_counts(rows, batch_id)
            numbered = rows.withColumn("ids", F.monotonically_increasing_id())
            write_predictions(
                prediction_table(numbered.filter(_is_post()), "ids"),
                f"{predictions_path.rstrip('/')}/batch_id={batch_id}",
                settings.axis.name,
            )

    writer = scored.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()


class BatchMetrics(StreamingQueryListener):
    """Scores of each micro-batch, observed as the batch runs and stored by a listener.

    ``observed`` adds the aggregates to the scored stream and ``stored`` reads
    what the listener wrote, a small table per batch that a repeated batch
    replaces. Listeners hear of a batch after it has ended: ``wait`` returns
    when that holds for all batches of a query that has stopped. Sums observed
    by a task that is run again after its result was lost may count twice; the
    counts of ``run_stream`` do not.
    """

    def __init__(self, spark: SparkSession, path: str, weights: Sequence[float] | None = None):
        self.spark, self.path, self.weights = spark, path, weights
        self.name = f"posts-{uuid.uuid4().hex}"
        self._ended: set[str] = set()
        self._change = threading.Condition()
        spark.streams.addListener(self)

    def observed(self, scored: DataFrame) -> DataFrame:
        post, label = _is_post(), F.col("label")
        weight = F.lit(1.0) if self.weights is None else class_weight(list(self.weights), label)
        loss = weight * cross_entropy(F.col("logits"), label)
        sums = [
            F.count_if(post).alias("examples"),
            F.count_if(post & (argmax(F.col("logits")) == label)).alias("right"),
            F.sum(F.when(post, weight)).alias("weight"),
            F.sum(F.when(post, loss)).alias("weighted"),
            F.count_if("corrupt").alias("corrupt"),
            F.count_if("no_text").alias("no_text"),
        ]
        return scored.observe(self.name, *sums)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        sums = (event.progress.observedMetrics or {}).get(self.name)
        if sums is not None and event.progress.numInputRows:
            row = self.spark.createDataFrame([tuple(sums)], OBSERVED)
            write_batch(row.coalesce(1), self.path, event.progress.batchId)

    def onQueryTerminated(self, event) -> None:
        with self._change:
            self._ended.add(str(event.runId))
            self._change.notify_all()

    def wait(self, query: StreamingQuery, timeout: float = 60.0) -> None:
        """Until the batches of a stopped query are stored; the listener is then removed."""
        with self._change:
            if not self._change.wait_for(lambda: str(query.runId) in self._ended, timeout):
                raise TimeoutError("the listener has not heard of the end of the query")
        self.spark.streams.removeListener(self)

    @staticmethod
    def stored(spark: SparkSession, path: str) -> DataFrame:
        """``(batch_id, examples, loss, micro_f1, accuracy, corrupt, no_text)`` of each batch."""
        rows = read_batches(spark, path, OBSERVED)
        share = F.try_divide(F.col("right").cast("double"), F.col("examples"))
        return rows.select(
            "batch_id",
            "examples",
            F.try_divide("weighted", "weight").alias("loss"),
            share.alias("micro_f1"),
            share.alias("accuracy"),
            "corrupt",
            "no_text",
        )


def run_matrix(
    lines: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    result_path: str,
    checkpoint: str,
    settings: StreamSettings = StreamSettings(),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the matrix of all batches so far in the state store of the stream.

    One stateful aggregate, a row per pair of classes. After each batch the whole
    of it replaces what was stored, so results do not grow with the batches;
    ``running_matrix`` reads it. Only posts are counted. A state of posts seen
    before (``distinct_within``) cannot stand below this one.
    """
    if settings.distinct_within:
        raise ValueError("a running matrix cannot be of distinct posts: use run_stream")
    spark = lines.sparkSession
    refuse_foreign_results(spark, result_path, checkpoint)
    posts = _scored(lines, score, settings).filter(_is_post())
    counts = batch_counts(posts)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_latest(batch.coalesce(1), result_path, batch_id)

    writer = counts.writeStream.outputMode("complete").foreachBatch(write)
    writer = writer.option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()


def running_counts(spark: SparkSession, result_path: str) -> DataFrame:
    """The counts that ``run_matrix`` stored last, a row per pair of classes."""
    return read_latest(spark, result_path, COUNTS)


def running_matrix(
    spark: SparkSession, result_path: str, given_classes: Sequence[int], pred_classes: Sequence[int]
) -> DataFrame:
    """The distribution matrix that ``run_matrix`` stored last; zeros before the first batch."""
    counts = running_counts(spark, result_path)
    return conditional_distribution(dense_matrix(counts, given_classes, pred_classes))


def stream_matrix(
    spark: SparkSession,
    result_path: str,
    given_classes: Sequence[int],
    pred_classes: Sequence[int],
    batch_id: int | None = None,
) -> DataFrame:
    """The distribution matrix of all batches so far, or of one of them; zeros before the first."""
    counts = stream_counts(spark, result_path).filter(F.col("given").isNotNull())
    if batch_id is not None:
        counts = counts.filter(F.col("batch_id") == batch_id)
    return conditional_distribution(dense_matrix(counts, given_classes, pred_classes))


def stream_metrics(spark: SparkSession, result_path: str, weights: Weights = None) -> DataFrame:
    """``(batch_id, examples, loss, micro_f1, accuracy)`` of each batch."""
    counts = stream_counts(spark, result_path).filter(F.col("given").isNotNull())
    return evaluate(counts, weights, "batch_id")


def stream_total(spark: SparkSession, result_path: str, weights: Weights = None) -> DataFrame:
    """``(examples, loss, micro_f1, accuracy, corrupt, no_text)`` over all batches, one row."""
    counts = stream_counts(spark, result_path)
    # Rows without labels have no part in the scores, only in the last two sums.
    posts = F.col("given").isNotNull()
    counts = counts.withColumn("n", F.when(posts, F.col("n")))
    return evaluate(counts, weights, sums=_left_out())


def stream_corrupt(spark: SparkSession, result_path: str) -> DataFrame:
    """``(batch_id, corrupt, no_text)``: lines without a post in each batch."""
    return stream_counts(spark, result_path).groupBy("batch_id").agg(*_left_out())


def stream_counts(spark: SparkSession, result_path: str) -> DataFrame:
    """The stored counts of all batches, a row per pair of classes and batch."""
    return read_batches(spark, result_path, COUNTS)


def compact_stream(spark: SparkSession, result_path: str) -> int | None:
    """Put the counts of finished batches into one file; see ``compact_batches``."""
    return compact_batches(spark, result_path, COUNTS)


def _left_out() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("corrupt", "no_text")]
