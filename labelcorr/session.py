"""Session helpers: where durable intermediates go, and size-checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = 4 * 1024 * 1024  # an executor holds several of a batch's size per task

_SCOPE: ContextVar[str] = ContextVar("_SCOPE", default="")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    It is the folder the session names in ``spark.checkpoint.dir``, or the one
    set on its context. All executors must reach it, so none is made up here.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named
    if current:
        return current
    raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table, in the shared folder."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/labelcorr"
    return f"{root}/{_SCOPE.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """What jobs inside this block write to the shared folder is removed at its end.

    Results have to be consumed inside the block. Yields the folder.
    """
    own = f"job-{uuid.uuid4().hex}/"
    folder = f"{checkpoint_dir(spark).rstrip('/')}/labelcorr/{own.rstrip('/')}"
    token = _SCOPE.set(own)
    try:
        yield folder
    finally:
        _SCOPE.reset(token)
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark reaches; nothing if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, so later passes and retries read it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches bounded in bytes, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so later stages and retries read fixed rows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` persisted for several passes; what a lost executor held is computed again."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def few_rows(df: DataFrame, max_rows: int) -> list[Row] | None:
    """The rows of ``df`` if there are at most ``max_rows``, else None.

    Fetches at most ``max_rows + 1`` rows.
    """
    head = df.limit(max_rows + 1).collect()
    return head if len(head) <= max_rows else None


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` when it has at most ``max_rows`` rows, else return it as it is.

    The rows fetched for the check become the broadcast side, so ``df`` is not
    computed twice. A larger ``df`` stays distributed and its join shuffles.
    """
    few = few_rows(df, max_rows)
    if few is None:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(few, df.schema))
