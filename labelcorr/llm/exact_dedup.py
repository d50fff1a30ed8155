"""Exact duplicates by progressive refinement: length, hash of the start, hash of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelcorr.llm.common import BITS_PER_MAP, bit_maps, lower_ascii, slot, written

PREFIX_CHARS = 64
LENGTH_MAPS = 64  # 256 KB
START_MAPS = 1024  # 4 MB


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **carried: Column
) -> DataFrame:
    """``(_row, id, keep_id, group_size, kept)`` per row, and the ``carried`` expressions.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Of equal texts the row with the largest id is kept. ``_row`` numbers the rows
    of the input; of rows that repeat id and text only the last one is kept, so
    every group keeps exactly one row; ``docs`` has to give its rows in the same
    order each time, as a table does. A null id is smaller than any other. An
    empty table gives an empty result; other columns are not looked at.

    Rows first meet by length, then by a hash of their first characters, and a
    hash of the whole text is taken only of those that met another row both
    times. What a level leaves is passed to the next scan as a bitmap of fixed
    size, so no text is shuffled; a bit that two keys share costs a hash of one
    text more and changes nothing. The last level is an aggregate that folds
    groups before the shuffle and a join by the hash, which Spark may split.
    """
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).alias("id"),
        text.alias("_text"),
        *[c.alias(name) for name, c in carried.items()],
    )
    rows = rows.withColumn("_length", F.octet_length("_text"))
    of_length = rows.groupBy("_length").agg(F.count("*").alias("_n")).filter("_n > 1")
    rows = _marked(rows, of_length, "_met", LENGTH_MAPS, "_length")

    rows = rows.withColumn("_start", F.when(F.col("_met"), F.xxhash64(F.left("_text", F.lit(PREFIX_CHARS)))))
    of_start = (
        rows.filter(F.col("_met"))
        .groupBy("_length", "_start")
        .agg(F.count("*").alias("_n"))
        .filter("_n > 1")
    )
    rows = _marked(rows, of_start, "_again", START_MAPS, "_length", "_start")

    rows = rows.withColumn(
        "_whole", F.when(F.col("_met") & F.col("_again"), F.sha2("_text", 256))
    )
    rows = written(
        rows.select("_row", "id", "_length", "_start", "_whole", *carried), "refined"
    )
    key = ["_length", "_start", "_whole"]
    groups = (
        rows.filter(F.col("_whole").isNotNull())
        .groupBy(*key)
        .agg(F.max(F.struct("id", "_row")).alias("_last"), F.count("*").alias("_n"))
        .filter("_n > 1")
    )
    # Read back from a table, so that the join may split a large group.
    found = rows.join(written(groups, "groups"), key, "left")
    return found.select(
        "_row",
        "id",
        F.when(F.col("_n").isNull(), F.col("id")).otherwise(F.col("_last.id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_n").isNull() | (F.col("_last._row") == F.col("_row"))).alias("kept"),
        *carried,
    )


def without_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns."""
    found = exact_duplicates(docs, id_col, text_col)
    dropped = found.filter(~F.col("kept")).select(F.col("_row").alias("_dropped"))
    whole = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.struct(*_columns(docs)).alias("_doc")
    )
    left = whole.join(dropped, F.col("_row") == F.col("_dropped"), "left_anti")
    return left.select("_doc.*")


def _columns(docs: DataFrame) -> list[Column]:
    return [docs[f"`{c}`"] for c in docs.columns]


def _marked(rows: DataFrame, keys: DataFrame, name: str, maps: int, *cols: str) -> DataFrame:
    """Add ``name``: may the row's key be among ``keys``? Never false for one that is."""
    bits = F.broadcast(bit_maps(keys, *cols, maps=maps))  # at most ``maps`` rows of 4 KB
    rows = rows.withColumn("_slot", slot(*cols, maps=maps))
    rows = rows.join(bits, F.expr(f"_slot div {BITS_PER_MAP}") == F.col("_map"), "left")
    byte = f"conv(hex(substring(_bits, cast(_slot % {BITS_PER_MAP} div 8 + 1 as int), 1)), 16, 10)"
    hit = F.expr(f"getbit(cast({byte} as int), cast(_slot % 8 as int)) = 1")
    return rows.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_slot", "_map", "_bits")
