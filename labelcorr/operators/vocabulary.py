"""Vocabulary and token ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelcorr.functions import tokens as K
from labelcorr.session import bounded_batches, kept, written

MAX_BROADCAST_TOKENS = 1_000_000
OPEN = -(2**31)  # from here on: places of tokens the shipped part of the vocabulary does not have


def max_tokens(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(max_tokens)``: the longest token list."""
    return df.agg(F.coalesce(F.max(F.size(tokens)), F.lit(0)).alias("max_tokens"))


def build_vocabulary(
    df: DataFrame, size: int, tokens: str = "tokens", markers: tuple[str, ...] = ()
) -> DataFrame:
    """``(token, n, token_id)``: the ``size`` most frequent tokens.

    Markers get the first ids, in the given order and with a NULL count. The
    counts are folded before the shuffle, so frequent words are no hot keys.
    How many tokens have which count tells the lowest count that can be among
    the ``size`` most frequent. Only tokens from there on are ordered and
    numbered, which one task can do: ``size`` rows and those tied with the last.
    """
    # The outer form: for the inner one Spark adds a size filter below the
    # projection, and the texts are cut into words twice.
    words = df.select(F.explode_outer(tokens).alias("token")).filter("token IS NOT NULL")
    if markers:
        words = words.filter(~F.col("token").isin(list(markers)))
    counts = words.groupBy("token").agg(F.count("*").alias("n"))
    order = [F.col("n").desc(), F.col("token")]
    from_top = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0)
    lowest = (
        counts.groupBy("n")
        .agg(F.count("*").alias("tokens"))
        .withColumn("upto", F.sum("tokens").over(from_top))
        .filter(F.col("upto") >= size)
        .agg(F.coalesce(F.max("n"), F.lit(0)))
    )
    top = counts.filter(F.col("n") >= lowest.scalar()).orderBy(*order).limit(size)
    number = F.row_number().over(Window.orderBy(*order)) - 1 + len(markers)
    numbered = top.select("token", "n", number.alias("token_id"))
    if not markers:
        return numbered
    first = [
        F.struct(
            F.lit(m).alias("token"),
            F.lit(None).cast("bigint").alias("n"),
            F.lit(i).alias("token_id"),
        )
        for i, m in enumerate(markers)
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*first))).unionByName(numbered)


def encode_tokens(
    df: DataFrame,
    vocabulary: DataFrame,
    unknown_id: int,
    tokens: str = "tokens",
    output: str = "token_ids",
    max_broadcast: int = MAX_BROADCAST_TOKENS,
) -> DataFrame:
    """Add the token ids in order, ``unknown_id`` for NULL tokens and those outside the vocabulary.

    A NULL list stays NULL, an empty one empty. The first ``max_broadcast``
    tokens of the vocabulary, which are its most frequent, are shipped to the
    tasks and looked up in Arrow batches bounded in bytes. Only if there are more,
    the tokens that this left open, each once per row, are joined with the rest
    of the vocabulary: they are rare, so the join has no hot key and needs no
    salt. Rows are told apart by a number given here. The vocabulary is computed
    once, and each row is looked up once and written with what it left open.
    """
    bounded_batches(df.sparkSession)
    with kept(vocabulary.select("token", F.col("token_id").cast("int").alias("token_id"))) as pairs:
        head = pairs.orderBy("token_id").limit(max_broadcast + 1).toArrow()
        if head.num_rows <= max_broadcast:
            return df.withColumn(output, _looked_up(df.sparkSession, head, unknown_id)(F.col(tokens)))
        first_open = head["token_id"][max_broadcast].as_py()
        rest = written(pairs.filter(F.col("token_id") >= first_open), "vocabulary")

    found = _left_open(df.sparkSession, head.slice(0, max_broadcast), unknown_id)(F.col(tokens))
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    rows = written(numbered.withColumn("_coded", found), "coded")
    open_tokens = rows.select("_row", F.posexplode("_coded.open").alias("_at", "token"))
    joined = open_tokens.join(rest, "token", "left")
    # Place and id in one number, so the sorted list of a row holds its ids by place.
    token_id = F.coalesce("token_id", F.lit(unknown_id)).cast("long")
    placed = F.shiftleft(F.col("_at").cast("long"), 32) + (token_id - OPEN)
    of_row = joined.groupBy("_row").agg(F.array_sort(F.collect_list(placed)).alias("_placed"))
    end = F.coalesce(F.size("_coded.open"), F.lit(0)) + OPEN
    known = F.transform(
        "_coded.ids",
        lambda i: F.when(i >= end, i).otherwise(
            (F.get("_placed", i - OPEN).bitwiseAND(F.lit(2**32 - 1)) + OPEN).cast("int")
        ),
    )
    return rows.join(of_row, "_row", "left").withColumn(output, known).drop("_row", "_coded", "_placed")


class _Lookup:
    """Token ids by token; the table is built once in each worker."""

    def __init__(self, table: pa.Table):
        self.table = table
        self.ids: dict[str, int] | None = None

    def __getstate__(self) -> dict:
        return {"table": self.table, "ids": None}

    def __call__(self, words: pa.Array, missing: int) -> pa.Array:
        if self.ids is None:
            columns = (self.table[name].to_pylist() for name in ("token", "token_id"))
            self.ids = dict(zip(*columns))
        coded = words.dictionary_encode()
        get = self.ids.get
        numbers = pa.array([get(w, missing) for w in coded.dictionary.to_pylist()], pa.int32())
        return pc.fill_null(pc.take(numbers, coded.indices), missing)


def _looked_up(spark: SparkSession, table: pa.Table, missing: int):
    """An Arrow function from token lists to id lists, ``missing`` for other tokens."""
    lookup = spark.sparkContext.broadcast(_Lookup(table))

    @F.arrow_udf("array<int>")
    def ids(lists: pa.Array) -> pa.Array:
        flat = lookup.value(lists.flatten().cast(pa.string()), missing)
        return pa.ListArray.from_arrays(_offsets(lists), flat.cast(pa.int32()), mask=lists.is_null())

    return ids


def _left_open(spark: SparkSession, table: pa.Table, missing: int):
    """An Arrow function from token lists to ids and the distinct tokens that are not in ``table``.

    The id of such a token is ``OPEN`` plus its place among those of its row;
    NULL tokens get ``missing``.
    """
    lookup = spark.sparkContext.broadcast(_Lookup(table))

    @F.arrow_udf("struct<ids array<int>, open array<string>>")
    def codes(lists: pa.Array) -> pa.Array:
        offsets = _offsets(lists)
        words = lists.flatten().cast(pa.string())
        ids = lookup.value(words, OPEN).to_numpy(zero_copy_only=False).copy()
        coded = words.dictionary_encode()
        ids[words.is_null().to_numpy(zero_copy_only=False)] = missing
        at = np.flatnonzero(ids == OPEN)
        row = np.repeat(np.arange(len(lists)), np.diff(offsets.to_numpy()))[at]
        n = max(1, len(coded.dictionary))
        word = pc.fill_null(coded.indices, 0).to_numpy(zero_copy_only=False)[at]
        seen, which = np.unique(row * n + word, return_inverse=True)
        starts = np.searchsorted(seen // n, np.arange(len(lists) + 1))
        ids[at] = OPEN + (which - starts[row])
        left = coded.dictionary.take(pa.array(seen % n))
        gone = lists.is_null()
        return pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()), mask=gone),
                pa.ListArray.from_arrays(pa.array(starts, pa.int32()), left, mask=gone),
            ],
            ["ids", "open"],
        )

    return codes


def _offsets(lists: pa.Array) -> pa.Array:
    """Where each list starts in the flat values, and where the last one ends."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0)
    ends = pc.cumulative_sum(lengths.cast(pa.int32()))
    return pa.concat_arrays([pa.array([0], pa.int32()), ends])


def batch_tokenize(
    df: DataFrame,
    vocabulary: DataFrame,
    text: str,
    unknown_id: int,
    pad_id: int,
    max_len: int = K.MAX_LEN,
    tokenizer=K.tokenize,
) -> DataFrame:
    """Add ``input_ids``, ``token_type_ids`` and ``attention_mask`` of fixed length.

    The markers are cut and counted as tokens; their ids come from the
    vocabulary. ``tokenizer`` turns a text column into a token array column.
    """
    marked: Column = K.add_special_tokens(tokenizer(F.col(text)), max_len)
    encoded = encode_tokens(
        df.withColumn("_tokens", marked), vocabulary, unknown_id, "_tokens", "_ids"
    )
    return encoded.withColumns(
        {
            "input_ids": K.pad_truncate(F.col("_ids"), F.lit(pad_id), max_len),
            "token_type_ids": K.token_type_ids(max_len),
            "attention_mask": K.attention_mask(F.col("_ids"), max_len),
        }
    ).drop("_tokens", "_ids")
