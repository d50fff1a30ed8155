"""Preference formatting: one shared prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = ("turn", "role", "text")


def preference_turns(
    chosen: DataFrame,
    rejected: DataFrame,
    pair: str = "pair_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trained_role: str = "assistant",
    opening: str = "<|",
    closing: str = "|>\n",
    ending: str = "\n",
) -> DataFrame:
    """``(pair_id, part, turn, role, rendered, trained, loss_start, loss_end)``.

    Both inputs hold one row per turn. A conversation is read in the order of
    (turn, role, text); the longest common prefix of the two is what comes before
    the first turn that only one of them has. It is given once, as part
    ``prompt``; the rest of each is part ``chosen`` and part ``rejected``. The
    rendered turns of a part, joined in order, are its text. Only the message of
    a turn of ``trained_role`` in a completion is trained: ``loss_start`` and
    ``loss_end`` bound it in ``rendered`` (code points, end exclusive); all else is
    masked, with the empty interval 0 to 0.

    Null roles and texts are empty. Rows repeated in one conversation are one
    turn; differing rows with the same turn number are turns of their own. A
    null turn comes first, a null pair is a pair. A pair that only one input has
    gets an empty prompt; one with equal conversations gets no completion rows.
    Other columns are not looked at; empty tables give an empty result.

    Rows stay one per turn: a pair is never gathered, however long it is. One
    aggregate by turn finds who has it, one by pair the first difference.
    """
    def side(df: DataFrame, mine: int) -> DataFrame:
        return df.select(
            F.col(pair).alias("pair_id"),
            F.col(turn).cast("long").alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
            F.lit(mine == 0).alias("_chosen"),
            F.lit(mine == 1).alias("_rejected"),
        )

    turns = (
        side(chosen, 0)
        .unionByName(side(rejected, 1))
        .groupBy("pair_id", *TURN)
        .agg(F.max("_chosen").alias("_chosen"), F.max("_rejected").alias("_rejected"))
    )
    place = F.struct(*TURN)
    alone = ~(F.col("_chosen") & F.col("_rejected"))
    first = turns.groupBy("pair_id").agg(F.min(F.when(alone, place)).alias("_first"))
    first = first.withColumnRenamed("pair_id", "_pair")
    placed = turns.join(first, F.col("pair_id").eqNullSafe(F.col("_pair")))
    in_prompt = F.col("_first").isNull() | (place < F.col("_first"))
    parts = F.when(in_prompt, F.array(F.lit("prompt"))).otherwise(
        F.filter(
            F.array(
                F.when(F.col("_chosen"), F.lit("chosen")),
                F.when(F.col("_rejected"), F.lit("rejected")),
            ),
            lambda p: p.isNotNull(),
        )
    )
    rows = placed.withColumn("part", F.explode(parts))
    head = F.concat(F.lit(opening), F.col("role"), F.lit(closing))
    trained = (F.col("part") != "prompt") & (F.col("role") == trained_role)
    return rows.select(
        "pair_id",
        "part",
        "turn",
        "role",
        F.concat(head, F.col("text"), F.lit(ending)).alias("rendered"),
        trained.alias("trained"),
        F.when(trained, F.length(head)).otherwise(0).cast("long").alias("loss_start"),
        F.when(trained, F.length(head) + F.length("text")).otherwise(0).cast("long").alias("loss_end"),
    )


def stale_answers(
    conversations: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trained_role: str = "assistant",
) -> DataFrame:
    """Rejected conversations: the last answer replaced by the first one given.

    Where the first answer is also the last, it is replaced by an empty one, and
    a conversation without an answer is returned as it is. Ties of the turn
    number are ordered by text. Columns ``(pair_id, turn, role, text)``.
    """
    rows = conversations.select(
        F.col(conv).alias("pair_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    answer = F.when(F.col("role") == trained_role, F.struct("turn", "text"))
    ends = rows.groupBy("pair_id").agg(
        F.min(answer).alias("_first"), F.max(answer).alias("_last")
    )
    ends = ends.withColumnRenamed("pair_id", "_pair")
    is_last: Column = (F.col("role") == trained_role) & F.struct("turn", "text").eqNullSafe(
        F.col("_last")
    )
    stale = F.when(F.col("_first").eqNullSafe(F.col("_last")), F.lit("")).otherwise(
        F.col("_first.text")
    )
    return rows.join(ends, F.col("pair_id").eqNullSafe(F.col("_pair"))).select(
        "pair_id", "turn", "role", F.when(is_last, stale).otherwise(F.col("text")).alias("text")
    )
