"""What several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelcorr.session import bounded_batches, written  # noqa: F401

BITS_PER_MAP = 32_768


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_rows(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, whatever the length of the texts.

    What Arrow keeps of a task's batches goes back when the task ends: workers
    stay, also while later stages run without them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def utf8(text: str) -> Column:
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: str) -> Column:
    """True for the rows whose labels must not be learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    max_rows: int,
    id_col: str = "doc_id",
    classes: Iterable[int] = (0, 1),
) -> DataFrame:
    """``docs`` with ``_label``, of documents whose labels may be learnt from.

    About ``max_rows`` rows at most, chosen by a hash of the id, and at most one
    label per document (the largest). Rows without id or label are left out.
    """
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label"))
    marks = marks.filter(~held_out("_id") & F.col("_label").isin(*classes) & F.col("_id").isNotNull())
    share = min(1.0, max_rows / max(1, marks.count()))
    marks = marks.filter(
        F.pmod(F.xxhash64("_id", F.lit("rows")), F.lit(1 << 30)) < int(share * (1 << 30))
    )
    marks = marks.groupBy("_id").agg(F.max("_label").alias("_label"))
    marks = F.broadcast(marks)  # about max_rows rows at most
    return docs.join(marks, docs[id_col] == marks["_id"]).drop("_id")


def slot(*cols: str, maps: int) -> Column:
    """The bit of a row in a bitmap of ``maps`` x 32,768 bits."""
    return F.pmod(F.xxhash64(*cols), F.lit(maps * BITS_PER_MAP))


def bit_maps(keys: DataFrame, *cols: str, maps: int) -> DataFrame:
    """``(_map, _bits)``: the keys as a bitmap of fixed size, at most ``maps`` rows of 4 KB."""
    at = slot(*cols, maps=maps)
    return (
        keys.select(at.alias("_slot"))
        .groupBy(F.expr(f"_slot div {BITS_PER_MAP}").alias("_map"))
        .agg(F.bitmap_construct_agg(F.col("_slot") % BITS_PER_MAP).alias("_bits"))
    )


def collected_bits(maps_df: DataFrame, maps: int) -> np.ndarray:
    """The bitmap as one array of bytes; its size is fixed by ``maps``."""
    found = np.zeros(maps * BITS_PER_MAP // 8, dtype=np.uint8)
    for row in maps_df.collect():
        part = np.frombuffer(bytes(row["_bits"]), dtype=np.uint8)
        at = row["_map"] * BITS_PER_MAP // 8
        found[at : at + len(part)] = part
    return found
