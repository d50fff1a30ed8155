"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learnt from the labelled rows, in whatever languages they are:
words and beginnings of words whose documents are toxic far more often than others.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelcorr.llm.common import arrow_rows, training_rows, utf8, written
from labelcorr.llm.text_stats import LEARNT, NAMES, statistics, terms, words_of

MAX_TRAINING_ROWS = 20_000
CALIBRATION_SHARE = 3  # every third training row calibrates, the others fit the trees
FEATURES = (
    "log_words", "upper", "shouted", "stops", "exclaims", "symbols", "symbol_runs", "insults",
    "log_insults", "distinct_insults", "second_person", "insults_near_you", "obfuscated",
    "spelled_out", *LEARNT,
)
PARTS = 4  # a training row is described by a lexicon that the other three parts gave
MAX_TERMS = 2_000
MIN_DOCUMENTS = 6  # toxic documents that hold a term of the lexicon
MIN_ODDS = 1.0  # the logarithm of how much likelier a toxic document is to hold it
MIN_SIGMAS = 4.5  # how sure that is: the root of the likelihood ratio statistic
HELD = 300_000  # terms a task counts before it hands them on


@dataclass(frozen=True)
class ToxicityModel:
    """Trees and calibration, or the base rate where there was nothing to learn from."""

    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    base_rate: float = 0.0
    lexicon: dict[bytes, float] = field(default_factory=dict)

    def statistics(self, docs: DataFrame, id_col: str, text_col: str, *also: str) -> DataFrame:
        return statistics(docs, id_col, text_col, *also, lexicons=[self.lexicon])

    def score(self, stats: DataFrame) -> DataFrame:
        """Add ``score``, 0 to 1, to rows with the statistics of their texts."""
        if self.trees is None:
            return stats.withColumn("score", F.lit(self.base_rate))
        raw = self.trees.transform(_vectors(stats)).withColumn("_raw", _raw())
        scored = self.calibration.transform(raw).withColumn("score", F.col("_calibrated"))
        return scored.select(*stats.columns, "score")


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "toxic",
    max_rows: int = MAX_TRAINING_ROWS,
    trees: int = 20,
    depth: int = 4,
) -> ToxicityModel:
    """Learn from the labelled rows that may be learnt from, at most about ``max_rows``.

    The lexicon comes from all of them, but each row is described by one that
    its own quarter had no part in. Two thirds, by a hash of the id, grow the
    trees, the rest gives the isotonic map from their output to a probability.
    With no rows, or with one class only, the model is the share of label 1 (0
    without rows). Null texts count as empty; rows with the same id and text
    count each.
    """
    some = training_rows(docs.select(id_col, text_col), labels, label, max_rows, id_col)
    some = written(some, "toxicity-texts")
    lexicons = learnt_lexicons(some, id_col, text_col)
    stats = statistics(
        some, id_col, text_col, "_label", lexicons=lexicons, which=_part(id_col) + 1
    )
    rows = written(stats, "toxicity-rows")
    part = F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(CALIBRATION_SHARE)) == 0
    rows = _vectors(rows).withColumn("_label", F.col("_label").cast("double"))
    fit, check = rows.filter(~part), rows.filter(part)
    kinds = rows.agg(F.avg("_label").alias("rate")).first()
    counts = fit.groupBy("_label").count().count(), check.groupBy("_label").count().count()
    if counts[0] < 2 or counts[1] < 1:
        return ToxicityModel(None, None, kinds["rate"] or 0.0, lexicons[0])
    grown = GBTClassifier(
        featuresCol="_features", labelCol="_label", maxIter=trees, maxDepth=depth, stepSize=0.2,
        minInstancesPerNode=5, seed=7,
    ).fit(fit)
    raw = grown.transform(check).withColumn("_raw", _raw())
    calibration = IsotonicRegression(
        featuresCol="_raw", labelCol="_label", predictionCol="_calibrated"
    ).fit(raw.select("_raw", "_label"))
    return ToxicityModel(grown, calibration, lexicon=lexicons[0])


def learnt_lexicons(rows: DataFrame, id_col: str, text_col: str) -> list[dict[bytes, float]]:
    """The lexicon of all ``rows`` with ``_label``, then one per part, learnt without it.

    A term's weight is the smoothed logarithm of how much likelier a toxic
    document is to hold it than another; terms with enough documents, weight and
    certainty are kept, the ``MAX_TERMS`` surest of each lexicon. Documents that
    hold a term are counted by label and part in one aggregate.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: defaultdict[int, Counter] = defaultdict(Counter)
        for batch in batches:
            for text, at in zip(batch.column(0), batch.column(1).to_pylist()):
                words = set(words_of(text.as_py()))
                seen[at].update({t for w in words for t in terms(w)})
                if sum(map(len, seen.values())) >= HELD:
                    yield _counted(seen)
                    seen.clear()
        yield _counted(seen)

    group = (2 * _part(id_col) + F.col("_label")).cast("int")
    told = rows.select(utf8(text_col).alias("text"), group.alias("_at"))
    groups = range(2 * PARTS)
    sizes = {r["_at"]: r["n"] for r in told.groupBy("_at").agg(F.count("*").alias("n")).collect()}
    counts = arrow_rows(told, count, "term binary, at int, n long").groupBy("term").agg(
        *[F.sum(F.when(F.col("at") == g, F.col("n")).otherwise(0)).alias(f"_{g}") for g in groups]
    )
    # Most terms are in few toxic documents.
    counts = counts.filter(sum(F.col(f"_{g}") for g in groups if g % 2) >= MIN_DOCUMENTS)
    counts = written(counts, "terms")
    return [_lexicon(counts, sizes, left_out) for left_out in (None, *range(PARTS))]


def _part(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.lit("lexicon")), F.lit(PARTS))


def _counted(seen: dict[int, Counter]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(chain.from_iterable(seen.values()), pa.binary()),
            pa.array(np.repeat(np.array([*seen], np.int32), [len(own) for own in seen.values()])),
            pa.array(chain.from_iterable(own.values() for own in seen.values()), pa.int64()),
        ],
        ["term", "at", "n"],
    )


def _lexicon(counts: DataFrame, sizes: dict[int, int], left_out: int | None) -> dict[bytes, float]:
    groups = [g for g in range(2 * PARTS) if g // 2 != left_out]
    holds, of = [], []
    for toxic in (1, 0):
        own = [g for g in groups if g % 2 == toxic]
        holds.append(sum((F.col(f"_{g}") for g in own), F.lit(0)))
        of.append(sum(sizes.get(g, 0) for g in own))
    odds = [F.log((n + 0.5) / (size + 1.0)) for n, size in zip(holds, of)]
    odds = odds[0] - odds[1]
    # Twice the logarithm of the likelihood ratio of two shares against a common one.
    common = (holds[0] + holds[1]) / max(1, sum(of))
    ratio = F.lit(0.0)
    for n, size in zip(holds, of):
        for seen, share in ((n, common), (size - n, 1 - common)):
            ratio += F.when((seen > 0) & (share > 0), 2 * seen * F.log(seen / (size * share))).otherwise(0.0)
    sigmas = F.sqrt(F.greatest(ratio, F.lit(0.0)))
    sure = counts.select("term", odds.alias("odds"), sigmas.alias("sigmas")).filter(
        (holds[0] >= MIN_DOCUMENTS) & (odds >= MIN_ODDS) & (sigmas >= MIN_SIGMAS)
    )
    best = sure.orderBy(F.desc("sigmas"), "term").limit(MAX_TERMS).collect()
    return {bytes(r["term"]): r["odds"] for r in best}


def toxicity_scores(
    docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, score)`` of every row by its whole text.

    A null text counts as empty and is scored like one; rows with the same text
    have the same score; other columns are not looked at. Nulls in the id stay;
    an empty table gives an empty result.
    """
    return model.score(model.statistics(docs, id_col, text_col)).select("id", "score")


def without_toxic(
    docs: DataFrame,
    model: ToxicityModel,
    bar: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that score below ``bar``, with all their columns, in one pass.

    Nulls, empty texts, repeated rows and empty tables are as in ``toxicity_scores``.
    """
    whole = docs.select(
        F.col(id_col).alias("_id"),
        F.col(text_col).alias("_text"),
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_doc"),
    )
    scored = model.score(model.statistics(whole, "_id", "_text", "_doc"))
    return scored.filter(F.col("score") < bar).select("_doc.*")


def _vectors(stats: DataFrame) -> DataFrame:
    assert set(FEATURES) <= {*NAMES, *LEARNT}
    return stats.withColumn("_features", array_to_vector(F.array(*FEATURES)))


def _raw():
    return vector_to_array("probability")[1]
