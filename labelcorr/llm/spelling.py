"""Spelling variants: words one edit apart, found by walking a trie that is a table of edges.

A state ``(word, position, node)`` says that the word, read up to the position
with one edit made, leads to a node of the trie. One join with the edges moves all
states on by a character; a state that comes to the end of a word has found a
neighbour. Nodes are known by a hash of their prefix, and neighbours are checked
at the end, so two prefixes with the same hash cost a state more and change nothing.

An edit in the first half of a word is one in the second half of the reversed
word, so words are walked in both directions and edited in their second half
only: there the trie is sparse, while near its root every state would go on
to all letters. A deletion is walked from the longer word and a replacement from
the word with the smaller letter; the pairs are then turned around. An edge
below which a single word is left holds that word, and the rest is compared at once.

A node has at most one edge per letter, so a join makes at most as many rows of a
state as there are letters, also where many words share a beginning.

Spark takes a table with a row per place of a word for as small as the words, and
a compressed file for the size of its rows, and would send both to the driver.
Joins are therefore merges, but for states whose size was measured.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelcorr.llm.common import arrow_rows, utf8, written

LETTERS = "a-zA-ZÀ-ÿ"  # fixed value: what words are made of
HELD = 200_000  # different words a task counts before it hands them on
MIN_LETTERS = 6
MIN_COUNT = 5
MORE = 5  # times as frequent as the word: its form
NOISE = 199  # a run loses a letter where this divides its hash
SMALL = 8_000_000  # bytes of states that are broadcast to the edges


def word_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    letters: int = MIN_LETTERS,
    noise: int | None = NOISE,
) -> DataFrame:
    """``(word, n)``: the words of at least ``letters`` code points in all whole texts.

    Words are maximal runs of letters, of which A-Z are lower-cased. With
    ``noise``, a run whose CRC-32 with the id is divisible by it loses one letter.
    Tasks add up what they read before the shuffle, so a frequent word is a few rows.
    A null text has no words, a null id is written as an empty text in the hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[{LETTERS}]{{{letters},}}").findall
        seen: Counter = Counter()
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # bytes.lower() changes A-Z only
                found = runs(text.lower().decode())
                if noise is None:
                    seen.update(found)
                    continue
                start = zlib.crc32(f"{'' if number is None else number}:".encode())
                for word, n in Counter(found).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % noise == 0:
                        cut = h % len(word)
                        word = word[:cut] + word[cut + 1 :]
                        if len(word) < letters:
                            continue
                    seen[word] += n
            if len(seen) >= HELD:
                yield _counted(seen)
                seen.clear()
        yield _counted(seen)

    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    found = arrow_rows(rows, run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
        ["word", "n"],
    )


def near_words(words: DataFrame) -> DataFrame:
    """``(word, near)``: all pairs of different ``word`` that one edit apart, in both orders.

    An edit inserts, deletes or replaces one code point. Nulls and repeated rows
    of ``words`` are taken once or not at all. Letters may be any characters.
    Words longer than a few thousand code points are walked too, but their
    states hold them once per position.
    """
    one = words.select("word").filter("word IS NOT NULL").distinct()
    texts = one.select("word", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    texts = texts.select(
        "back",
        F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")).alias("text"),
        F.length("word").alias("size"),
    )
    places = texts.select(
        "back", "text", "size", F.explode(F.expr("sequence(size div 2, size)")).alias("at")
    )
    node = F.xxhash64("back", F.substring("text", F.lit(1), F.col("at")))
    places = places.withColumns({"node": node, "letter": _letter("text", F.col("at"))})
    edges = written(_edges(places), "edges")
    starts = places.filter(F.col("at") < F.col("size"))
    # One letter left out; of equal neighbours only the last.
    states = starts.filter(F.col("letter") != _letter("text", F.col("at") + 1)).select(
        "back", "text", (F.col("at") + 1).alias("at"), "node"
    )
    moved = _moved(states, edges)
    # Another letter instead, larger than the own one.
    other = edges.select("node", "child", "only", "depth", F.col("letter").alias("_letter"))
    replaced = starts.join(other.hint("merge"), "node").filter(F.col("_letter") > F.col("letter"))
    moved = written(moved.unionByName(_entered(replaced)), "states")
    pairs = []
    while True:
        pairs.append(moved.filter("near IS NOT NULL").select("back", "text", "near"))
        alive = moved.filter("near IS NULL").select("back", "text", "at", "node")
        size = alive.agg(F.sum(F.octet_length("text") + 64)).first()[0]
        if size is None:
            break
        moved = written(_moved(alive, edges, size <= SMALL), "states")
    found = pairs[0]
    for more in pairs[1:]:
        found = found.unionByName(more)
    turn = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c))
    found = found.select(turn("text").alias("word"), turn("near").alias("near"))
    found = found.filter(F.levenshtein("word", "near") == 1)
    both = F.array(
        F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"))
    )
    return found.select(F.explode(both).alias("p")).select("p.*").distinct()


def _letter(text: str, at: Column) -> Column:
    """The code point at a place (from 0), empty at the end."""
    return F.substring(F.col(text), at + 1, F.lit(1))


def _edges(places: DataFrame) -> DataFrame:
    """``(node, letter, child, depth, only)``, the letter empty where a word ends.

    ``only`` is the word below the edge where it is the only one.
    """
    child = F.xxhash64("back", F.substring("text", F.lit(1), F.col("at") + 1))
    return (
        places.withColumn("child", child)
        .groupBy("node", "letter")
        .agg(
            F.min("child").alias("child"),
            (F.min("at") + 1).alias("depth"),
            F.min("text").alias("_least"),
            F.max("text").alias("_most"),
        )
        .select(
            "node", "letter", "child", "depth",
            F.when(F.col("_least") == F.col("_most"), F.col("_least")).alias("only"),
        )
    )


def _moved(states: DataFrame, edges: DataFrame, few: bool = False) -> DataFrame:
    """The states one letter further, or the neighbours they have come to."""
    states = states.withColumn("letter", _letter("text", F.col("at"))).hint("broadcast" if few else "merge")
    return _entered(states.join(edges, ["node", "letter"]).drop("node"))


def _entered(states: DataFrame) -> DataFrame:
    """States that went through an edge; where it holds a word, only those that end there."""
    rest = F.expr("substring(text, at + 2)") == F.expr("substring(only, depth + 1)")
    return states.filter(F.col("only").isNull() | rest).select(
        "back",
        "text",
        (F.col("at") + 1).alias("at"),
        F.col("child").alias("node"),
        F.col("only").alias("near"),
    )


def spelling_variants(words: DataFrame, more: int = MORE) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every row of ``words (word, n)``.

    ``form`` is the near word of largest ``n`` (ties: the smallest in code-point
    order) if that is at least ``more`` times the word's own, else null; ``root``
    follows forms to the last, so it is the word itself where there is none.
    ``words`` has one row per word; an empty table gives an empty result.
    """
    near = written(near_words(words), "near")
    of_near = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = (
        near.join(of_near.hint("merge"), "near")
        .groupBy("word")
        .agg(
            F.count("*").alias("n_near"),
            F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"),
        )
    )
    form = F.when(-F.col("best.less") >= more * F.col("n"), F.col("best.near"))
    told = words.join(best.hint("merge"), "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        form.alias("form"),
        F.when(form.isNotNull(), -F.col("best.less")).alias("form_n"),
    )
    told = written(told, "forms")
    found = told.join(_roots(told).hint("merge"), "word", "left")
    return found.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(told: DataFrame) -> DataFrame:
    """``(word, root)`` of words with a form. Each turn doubles the steps a word has followed;
    counts grow along the way, so it ends."""
    found = told.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    found = written(found, "roots")
    while True:
        after = found.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = found.join(after.hint("merge"), "root", "left").select(
            "word",
            F.coalesce("_next", "root").alias("root"),
            F.col("_next").isNotNull().alias("_moved"),
        )
        moved = written(moved, "roots")
        found = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            return found
