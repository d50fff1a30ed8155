"""From raw documents to token ids: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelcorr.llm.common import table
from labelcorr.llm.exact_dedup import without_duplicates
from labelcorr.llm.mixing import domain_labels, mixed
from labelcorr.llm.near_dedup import without_near_duplicates
from labelcorr.llm.pieces import round_trips
from labelcorr.llm.queries import TARGET
from labelcorr.llm.toxicity import fit_toxicity, without_toxic
from labelcorr.session import remove, scratch, scratch_path

# The stages learn from labels, compare sketches and encode: no SQL for the whole.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go."""
    return without_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the one with the largest id."""
    return without_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return without_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``copies`` says how often a document is to be seen; no document is lost."""
    return mixed(docs, domain_labels(table(spark, sf_dir, "labels")), TARGET)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, copies, ids, n_tokens, decoded_sha256, round_trip)``: each document is
    encoded once, whatever its copies."""
    return round_trips(docs, also=("copies",)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing", mixing),
    ("SentencePiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, in order.

    Each stage's result is a table in the shared folder, which goes when the next
    stage has been written; what a stage writes for itself goes with its end. The
    last stage is not yet run when this returns: it reads the table before it.
    Null and empty texts, repeated rows and empty tables pass through as the
    stages say; a null id is a document of its own to all of them.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
