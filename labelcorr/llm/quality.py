"""Quality: a sparse ensemble of rules taken from trees, as one column expression."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelcorr.llm.common import training_rows, written
from labelcorr.llm.text_stats import statistics

MAX_TRAINING_ROWS = 20_000
FEATURES = (
    "log_words", "mean_word", "distinct_words", "upper", "shouted", "digits", "stops",
    "exclaims", "symbols", "symbol_runs", "pipes", "repeated_lines", "log_lines", "spaces",
)

# A rule is a set of (feature, is at most, threshold), all of which must hold.
Rule = frozenset[tuple[str, bool, float]]


@dataclass(frozen=True)
class RuleEnsemble:
    """A logistic model on few rules: ``bias`` and a weight per rule."""

    bias: float
    rules: tuple[tuple[Rule, float], ...] = ()

    def score(self) -> Column:
        """Probability of label 1 as an expression over the statistics."""
        total = reduce(
            lambda a, b: a + b,
            [F.when(holds(rule), weight).otherwise(0.0) for rule, weight in self.rules],
            F.lit(self.bias),
        )
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule) -> Column:
    terms = [
        F.col(name) <= bound if at_most else F.col(name) > bound
        for name, at_most, bound in sorted(rule)
    ]
    return reduce(and_, terms)


def fit_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "quality",
    max_rows: int = MAX_TRAINING_ROWS,
    trees: int = 24,
    depth: int = 3,
    penalty: float = 0.002,
) -> RuleEnsemble:
    """Grow shallow trees, take their paths as rules, keep the few a lasso gives weight.

    Learns from at most about ``max_rows`` labelled rows. Without rows, or with
    one class only, the ensemble has no rules and scores the share of label 1
    (one half without rows).
    """
    some = training_rows(docs.select(id_col, text_col), labels, label, max_rows, id_col)
    rows = written(statistics(some, id_col, text_col, "_label"), "quality-rows")
    rows = rows.withColumn("_label", F.col("_label").cast("double"))
    rate = rows.agg(F.avg("_label").alias("rate")).first()["rate"]
    if rate is None or rate in (0.0, 1.0):
        rate = 0.5 if rate is None else min(max(rate, 0.001), 0.999)
        return RuleEnsemble(math.log(rate / (1 - rate)))
    grown = RandomForestClassifier(
        featuresCol="_features", labelCol="_label", numTrees=trees, maxDepth=depth,
        featureSubsetStrategy="onethird", minInstancesPerNode=10, seed=11,
    ).fit(rows.withColumn("_features", array_to_vector(F.array(*FEATURES))))
    rules = sorted({r for tree in grown.trees for r in paths(tree)}, key=sorted)
    if not rules:
        return RuleEnsemble(math.log(rate / (1 - rate)))
    matrix = rows.select(
        "_label",
        array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("_rules"),
    )
    lasso = LogisticRegression(
        featuresCol="_rules", labelCol="_label", elasticNetParam=1.0, regParam=penalty, maxIter=60
    ).fit(matrix)
    weights = [float(w) for w in lasso.coefficients.toArray()]
    return RuleEnsemble(
        float(lasso.intercept), tuple((r, w) for r, w in zip(rules, weights) if w != 0.0)
    )


def paths(tree) -> set[Rule]:
    """The conjunctions from the root of a tree to each of its nodes."""
    found: set[Rule] = set()

    def walk(node, so_far: Rule) -> None:
        if so_far:
            found.add(so_far)
        if node.numDescendants() == 0:
            return
        split = node.split()
        name, bound = FEATURES[split.featureIndex()], float(split.threshold())
        walk(node.leftChild(), so_far | {(name, True, bound)})
        walk(node.rightChild(), so_far | {(name, False, bound)})

    walk(tree._call_java("rootNode"), frozenset())
    return found


def quality_scores(
    docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, score)`` of every row by its whole text.

    A null text counts as empty, which has all statistics zero; equal texts have
    equal scores; other columns are not looked at.
    """
    return statistics(docs, id_col, text_col).select("id", model.score().alias("score"))
