"""Token counts by a byte-level BPE vocabulary, merging only what no single token covers."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelcorr.llm.common import arrow_rows, utf8

MODEL = "byte_bpe_50k.json"
SHORT = 32  # bytes
PER_RANK = 1 << 32  # a key holds the rank of a pair and, below it, the token they become
NO_MERGE = 1 << 62
REMEMBERED = 300_000  # merged pre-tokens a task keeps the counts of

# Fixed value: how the vocabulary's library splits a text before it merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: letters and numbers of a later Unicode version than that library knows.
LATER = "\U00011DE0-\U00011DE9\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016FF4-\U00016FF6"


def read_vocabulary(path: str) -> dict:
    """The parts of a tokenizer file that counting needs, as plain values.

    Only byte-level BPE without normaliser, prefix space and dropout can be
    counted this way; any other file raises.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE"
        and split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and not split.get("add_prefix_space")
        and spec["normalizer"] is None
        and not any(
            model.get(k)
            for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        )
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
    )
    if not plain:
        raise ValueError(f"{path} is no plain byte-level BPE")
    letters = byte_letters()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return {
        "ids": dict(model["vocab"]),
        "bytes": [model["vocab"][letters[b]] for b in range(256)],
        "letters": letters,
        "merges": [(model["vocab"][a], model["vocab"][b], model["vocab"][a + b]) for a, b in merges],
        "added": [t["content"] for t in spec["added_tokens"]],
    }


def splitters() -> tuple:
    """Two functions that cut a text into pre-tokens: the plain one, and one for texts in
    which there may be characters of ``LATER``."""
    careful = SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{LATER}]]")
    for kind in (r"\p{L}", r"\p{N}"):
        careful = careful.replace(f" ?{kind}+", f" ?[{kind}--[{LATER}]]+")
    return regex.compile(SPLIT).findall, regex.compile(careful, regex.V1).findall


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary's strings.

    Printable Latin-1 characters stand for themselves, the other bytes, in
    order, for the characters from U+0100 on.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merger:
    """Merges the bytes of a pre-token, lowest rank first, leftmost of equal ranks."""

    def __init__(self, vocabulary: dict):
        self.bytes = vocabulary["bytes"]
        self.keys = {
            (a, b): rank * PER_RANK + c for rank, (a, b, c) in enumerate(vocabulary["merges"])
        }

    def tokens(self, piece: bytes) -> list[int]:
        """Short pieces with a list of the ranks of all pairs, long ones with a heap: in
        n log n steps, so one endless word is no trouble."""
        if len(piece) > SHORT:
            return self._by_heap(piece)
        ids, rank = [self.bytes[b] for b in piece], self.keys.get
        keys = [rank(pair, NO_MERGE) for pair in zip(ids, ids[1:])]
        while keys and (best := min(keys)) < NO_MERGE:
            i = keys.index(best)
            ids[i : i + 2] = [best % PER_RANK]
            del keys[i]
            if i:
                keys[i - 1] = rank((ids[i - 1], ids[i]), NO_MERGE)
            if i < len(keys):
                keys[i] = rank((ids[i], ids[i + 1]), NO_MERGE)
        return ids

    def _by_heap(self, piece: bytes) -> list[int]:
        ids = [self.bytes[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (hit := self.keys.get((ids[i], ids[after[i]]))):
                heapq.heappush(waiting, (hit, i, ids[i], ids[after[i]]))

        for i in range(n - 1):
            offer(i)
        while waiting:
            hit, i, left, right = heapq.heappop(waiting)
            if ids[i] != left or after[i] >= n or ids[after[i]] != right:
                continue  # one of the two has been merged meanwhile
            j = after[i]
            ids[i], ids[j] = hit % PER_RANK, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [t for t in ids if t >= 0]


def whole_tokens(vocabulary: dict) -> frozenset[str]:
    """The vocabulary strings that encode alone as one token, proved by merging each.

    A string of the vocabulary need not be one token: merges made earlier may
    leave no way to it. Strings that are no UTF-8 never are a pre-token.
    """
    merger = Merger(vocabulary)
    of_letter = {c: b for b, c in enumerate(vocabulary["letters"])}
    proved = set()
    for token, number in vocabulary["ids"].items():
        try:
            piece = bytes(of_letter[c] for c in token)
            text = piece.decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if merger.tokens(piece) == [number]:
            proved.add(text)
    return frozenset(proved)


@lru_cache(maxsize=2)
def _prepared(path: str) -> tuple[dict, frozenset[str]]:
    vocabulary = read_vocabulary(path)
    return vocabulary, whole_tokens(vocabulary)


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str | None = None,
    limit: int = 1024,
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit, n_whole)`` of every row by its whole text.

    ``n_tokens`` is what the vocabulary's library gives without tokens of its
    own at the ends; a string of an added token inside a text is one token. Of
    the pre-tokens, ``n_whole`` are a whole token and only looked up. Null
    counts as empty and has 0 tokens. Rows are counted one by one, so repeated
    rows, ties and null ids stay as they are; an empty table gives an empty
    result; other columns are not looked at. ``model`` is a path on the driver:
    tasks get the vocabulary, which has a fixed size, as a broadcast.
    """
    if model is None:
        import public_tokenizers  # only where its file is asked for

        model = public_tokenizers.path(MODEL)
    vocabulary, whole = _prepared(model)
    told = {k: vocabulary[k] for k in ("bytes", "merges", "added")}
    shared = docs.sparkSession.sparkContext.broadcast((told, whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, whole = shared.value
        merger = Merger(vocabulary)
        plain_split, careful_split = splitters()
        added = sorted(vocabulary["added"], key=len, reverse=True)
        apart = regex.compile("|".join(map(regex.escape, added))).split if added else None
        known: dict[str, int] = {}
        for batch in batches:
            tokens = np.zeros(batch.num_rows, np.int64)
            plain = np.zeros(batch.num_rows, np.int64)
            for i, data in enumerate(batch.column(0).to_pylist()):
                # A first byte of four-byte characters, among which those of LATER are.
                split = careful_split if b"\xf0" in data else plain_split
                text = data.decode()
                parts = [text]
                if any(a in text for a in added):
                    parts = apart(text)
                n, direct = len(parts) - 1, 0
                for part in parts:
                    pieces = split(part)
                    rest = [p for p in pieces if p not in whole]
                    direct += len(pieces) - len(rest)
                    for piece in rest:
                        found = known.get(piece)
                        if found is None:
                            found = len(merger.tokens(piece.encode()))
                            if len(known) >= REMEMBERED:
                                known.clear()
                            if len(piece) < 100:
                                known[piece] = found
                        n += found
                tokens[i], plain[i] = n + direct, direct
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(tokens), pa.array(plain)],
                ["id", "n_bytes", "n_tokens", "n_whole"],
            )

    rows = docs.select(
        utf8(text_col).alias("text"),
        F.col(id_col).alias("id"),
        F.octet_length(utf8(text_col)).cast("long").alias("n_bytes"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    found = arrow_rows(rows, run, f"id {kind}, n_bytes long, n_tokens long, n_whole long")
    return found.select(
        "id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_whole"
    )
