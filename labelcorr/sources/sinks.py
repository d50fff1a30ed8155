"""Writing predictions, folds and per-batch results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCHES, COMPACTED = "batches", "compacted"


def write_predictions(
    predictions: DataFrame, path: str, label_name: str = "political_bias"
) -> None:
    """CSV ``ids,<label_name>`` with a header. Keep ``path`` out of the input folder."""
    table = predictions.select("ids", F.col("pred").alias(label_name))
    write_csv(table, path)


def write_folds(df: DataFrame, path: str, fold_col: str = "fold") -> None:
    """One folder per fold with its test rows, all columns.

    Many tasks write each folder, so a fold is not gathered anywhere.
    """
    write_csv(df, path, fold_col)


def write_csv(df: DataFrame, path: str, *partition_by: str) -> None:
    """CSV that ``read_posts`` reads back unchanged: quotes, line breaks, outer blanks."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False)
    writer = writer.option("ignoreTrailingWhiteSpace", False)
    writer.partitionBy(*partition_by).csv(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write the result of a micro-batch to a folder of its own.

    A batch that is run again replaces its folder, so nothing is counted twice.
    """
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{BATCHES}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batch results with their ``batch_id``; no rows before the first batch.

    The last compacted table counts for the batches up to its number, the
    folders of the later batches for themselves.
    """
    path, parts = path.rstrip("/"), []
    upto = _compacted(spark, path)
    with_id = f"{schema}, batch_id bigint"
    if upto is not None:
        parts.append(spark.read.schema(with_id).parquet(f"{path}/{COMPACTED}/upto={upto}"))
    later = [b for b in _numbers(spark, f"{path}/{BATCHES}", "batch_id=") if upto is None or b > upto]
    if later:
        folders = [f"{path}/{BATCHES}/batch_id={b}" for b in later]
        parts.append(
            spark.read.schema(with_id).option("basePath", f"{path}/{BATCHES}").parquet(*folders)
        )
    empty = spark.createDataFrame([], with_id)
    return reduce(DataFrame.unionByName, parts) if parts else empty


def compact_batches(spark: SparkSession, path: str, schema: str) -> int | None:
    """Put all batch results into one file and remove the folders it replaces.

    The table counts from the moment Spark has marked it as complete; a run that
    is lost earlier or later leaves results as they were. Returns the last batch
    in it. The stream must not be writing an earlier batch again meanwhile.
    """
    path = path.rstrip("/")
    old = _numbers(spark, f"{path}/{BATCHES}", "batch_id=")
    before = _compacted(spark, path)
    new = [b for b in old if before is None or b > before]
    if not new:
        return before
    rows = read_batches(spark, path, schema).filter(F.col("batch_id") <= max(new))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/{COMPACTED}/upto={max(new)}")
    for b in old:
        _remove(spark, f"{path}/{BATCHES}/batch_id={b}")
    for n in _numbers(spark, f"{path}/{COMPACTED}", "upto="):
        if n < max(new):
            _remove(spark, f"{path}/{COMPACTED}/upto={n}")
    return max(new)


def write_latest(df: DataFrame, path: str, batch_id: int) -> None:
    """Write the whole result as of a micro-batch; it replaces the results before it.

    The one before stays until the next is complete, so readers always find one.
    """
    write_batch(df, path, batch_id)
    for b in _whole_batches(df.sparkSession, path):
        if b < batch_id:
            _remove(df.sparkSession, f"{path.rstrip('/')}/{BATCHES}/batch_id={b}")


def read_latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The result that ``write_latest`` wrote last; no rows before the first."""
    whole = _whole_batches(spark, path)
    if not whole:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{BATCHES}/batch_id={max(whole)}")


def _whole_batches(spark: SparkSession, path: str) -> list[int]:
    folder = f"{path.rstrip('/')}/{BATCHES}"
    return [
        b
        for b in _numbers(spark, folder, "batch_id=")
        if "_SUCCESS" in _children(spark, f"{folder}/batch_id={b}")
    ]


def refuse_foreign_results(spark: SparkSession, path: str, checkpoint: str) -> None:
    """Raise if ``path`` holds results but ``checkpoint`` is new: batch numbers would start anew."""
    if not _children(spark, checkpoint) and _children(spark, path.rstrip("/")):
        raise ValueError(f"{path} holds the results of another checkpoint than {checkpoint}")


def _compacted(spark: SparkSession, path: str) -> int | None:
    whole = [
        n
        for n in _numbers(spark, f"{path}/{COMPACTED}", "upto=")
        if "_SUCCESS" in _children(spark, f"{path}/{COMPACTED}/upto={n}")
    ]
    return max(whole, default=None)


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    names = [n for n in _children(spark, path) if n.startswith(prefix)]
    return sorted(int(n.removeprefix(prefix)) for n in names)


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system Spark knows; none if there is no folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
