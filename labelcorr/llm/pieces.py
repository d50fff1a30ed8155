"""SentencePiece encoding and decoding as a weighted finite-state transducer."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelcorr.llm.common import arrow_rows, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2  # fixed values: how a model file names its type
CACHED_WORDS = 200_000
CACHED_PAIRS = 400_000
LONG_WORD = 200
OWN_CLASSES = 8  # largest groups of characters at whose borders texts are cut


class Transducer:
    """Normaliser, pieces and byte fallback of a BPE model, compiled.

    The states are (position in the text, last piece). An arc reads the
    characters of a piece and emits it, or reads a character without a piece and
    emits its UTF-8 bytes. Its weight in the tropical semiring is 0 if the piece
    may follow the last one and infinite otherwise: two pieces may stand next to
    each other if merging their characters by the model's scores gives just
    them. A sequence in which that holds for every two neighbours is what
    merging the whole text gives, so one path has finite weight and is the
    shortest. The composition with an input is expanded lazily, longest piece
    first.

    A text is composed word by word: no piece holds a space mark after another
    character, nor a line break or tab, so arcs never cross those borders, nor
    those between characters that stand next to each other in no piece, as letters
    and punctuation (``cuts``).
    """

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.texts: list[str] = []
        self.bytes: list[int] = [0] * 256
        self.emitted: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.scores.append(sp.get_score(i))
            self.texts.append(piece)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.emitted.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                self.emitted.append(b"")
            elif sp.is_unknown(i):
                self.emitted.append(" ⁇ ".encode())
            else:
                self.ids[piece] = i
                self.emitted.append(piece.replace(SPACE, " ").encode())
        spec = normaliser_of(model)
        if spec["model_type"] != BPE:
            raise ValueError("the model is no BPE model: merging would give other ids")
        if spec["charsmap"] or spec["remove_extra_spaces"] or not spec["escape_spaces"]:
            raise ValueError("this model rewrites characters: not supported")
        self.prefix = SPACE if spec["dummy_prefix"] else ""
        if any(re.search(f"[^{SPACE}]{SPACE}|[\n\t]", p) for p in self.ids):
            raise ValueError("a piece crosses the border of a word")
        # Of every beginning of a piece, the piece it is itself, or -1.
        self.starts = {p[:i]: -1 for p in self.ids for i in range(1, len(p) + 1)} | self.ids
        self.pairs: dict[tuple[int, int], bool] = {}
        self.lengths = [len(p) for p in self.texts]
        self.courses: dict[int, tuple[list[float], list[str], list[str]] | None] = {}
        # Words seen of late, and those seen before them: the latter go when the former are many.
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.cut = re.compile(cuts(self.ids)).findall

    def merged(self, text: str) -> list[str]:
        """The pieces that merging by score gives; of equal scores the leftmost first."""
        ids, scores = self.ids, self.scores
        parts = list(text)
        of = [ids.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = -math.inf, -1
            for i, found in enumerate(of):
                if found is not None and scores[found] > best:
                    best, at = scores[found], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del of[at]
            if at:
                of[at - 1] = ids.get(parts[at - 1] + parts[at])
            if at < len(of):
                of[at] = ids.get(parts[at] + parts[at + 1])

    def course(self, piece: int) -> tuple[list[float], list[str], list[str]] | None:
        """How merging makes a piece of its characters: the score of each merge, and what
        stands first and last before it. None if merging does not give the piece.

        Kept per piece; there are no more of them than the model has.
        """
        if piece in self.courses:
            return self.courses[piece]
        ids, scores = self.ids, self.scores
        parts = list(self.texts[piece])
        taken: list[float] = []
        firsts, lasts = [parts[0]], [parts[-1]]
        while len(parts) > 1:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                found = ids.get(parts[i] + parts[i + 1])
                if found is not None and scores[found] > best:
                    best, at = scores[found], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            taken.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        made = (taken, firsts, lasts) if len(parts) == 1 else None
        self.courses[piece] = made
        return made

    def may_follow(self, a: int, b: int) -> bool:
        """Is the weight of the arc for piece ``b`` after ``a`` finite? ``a`` is -1 at a start."""
        known = self.pairs.get((a, b))
        if known is None:
            known = self._apart(a, b)
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def _apart(self, a: int, b: int) -> bool:
        """Does merging the characters of both pieces give just the two?

        While nothing is merged across their border, each is made as if it stood
        alone; so the two courses are gone through together, the higher score first,
        of equal ones the leftmost, until a merge across the border would be next.
        """
        right = self.course(b)
        if a < 0 or right is None:
            return right is not None
        left = self.course(a)
        if left is None:
            return False
        ids, scores = self.ids, self.scores
        if self.texts[a] + self.texts[b] in ids:
            return False
        (before, _, ends), (after, starts, _) = left, right
        i, j, n, m = 0, 0, len(before), len(after)
        across = ids.get(ends[0] + starts[0])
        while i < n or j < m:
            one = before[i] if i < n else -math.inf
            two = after[j] if j < m else -math.inf
            if across is not None and one < scores[across] >= two:
                return False
            if one >= two and i < n:
                i += 1
                moved = ends[i] is not ends[i - 1]
            else:
                j += 1
                moved = starts[j] is not starts[j - 1]
            if moved:
                across = ids.get(ends[i] + starts[j])
        return True

    def _arcs(self, word: str, at: int) -> list[tuple[int, int]]:
        """``(end, piece)`` of the arcs that read ``word`` from ``at``, shortest first.

        A character without a piece has one arc, for its bytes, with piece -1.
        """
        found, begun = [], self.starts.get
        for end in range(at + 1, len(word) + 1):
            piece = begun(word[at:end])
            if piece is None:
                break
            if piece >= 0:
                found.append((end, piece))
        if not found or found[0][0] > at + 1:
            found.insert(0, (at + 1, -1))
        return found

    def shortest_path(self, word: str) -> tuple[int, ...]:
        """The pieces on the path of finite weight through the composition with ``word``.

        The longest arc is tried first; where none goes on, the last one is taken back.
        Words with characters that have no piece are searched with arcs for their bytes.
        """
        n, begun, follows, lengths = len(word), self.starts.get, self.pairs.get, self.lengths
        ids: list[int] = []
        open_arcs: list[list[int]] = []
        dead: set[tuple[int, int]] = set()
        at, last = 0, -1
        while at < n:
            found, end = [], at + 1
            piece = begun(word[at:end])
            while piece is not None:
                if piece >= 0:
                    found.append(piece)
                end += 1
                if end > n:
                    break
                piece = begun(word[at:end])
            while True:
                if found:
                    piece = found.pop()
                    if dead and (at, piece) in dead:
                        continue
                    known = follows((last, piece))
                    if known is None:
                        known = self.may_follow(last, piece)
                    if known:
                        break
                elif ids:
                    gone = ids.pop()
                    at -= lengths[gone]
                    found = open_arcs.pop()
                    dead.add((at, gone))
                    last = ids[-1] if ids else -1
                else:
                    return self._searched(word)
            open_arcs.append(found)
            ids.append(piece)
            at += lengths[piece]
            last = piece
        return tuple(ids)

    def _searched(self, word: str) -> tuple[int, ...]:
        """The same by a search with ways back, also for characters without a piece."""
        n, pairs = len(word), self.pairs
        path: list[tuple[int, int]] = []
        open_arcs = [self._arcs(word, 0)]
        dead: set[tuple[int, int]] = set()
        last = -1
        while not path or path[-1][0] < n:
            arcs = open_arcs[-1]
            while arcs:
                arc = arcs.pop()
                piece = arc[1]
                if dead and arc in dead:
                    continue
                if piece >= 0:
                    known = pairs.get((last, piece))
                    if known is None:
                        known = self.may_follow(last, piece)
                    if not known:
                        continue
                path.append(arc)
                last = piece
                if arc[0] < n:
                    open_arcs.append(self._arcs(word, arc[0]))
                break
            else:
                open_arcs.pop()
                if not path:
                    raise ValueError("no path")
                dead.add(path.pop())
                last = path[-1][1] if path else -1
        if all(piece >= 0 for _, piece in path):
            return tuple([piece for _, piece in path])
        found: list[int] = []
        for end, piece in path:
            if piece >= 0:
                found.append(piece)
            else:
                found += [self.bytes[b] for b in word[end - 1].encode()]
        return tuple(found)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        words, known, before = self.words, self.words.get, self.older.get
        found = []
        for word in self.cut(self.prefix + text.replace(" ", SPACE)):
            ids = known(word)
            if ids is None:
                ids = before(word)
                if ids is None:
                    ids = self.shortest_path(word)
                if len(word) <= LONG_WORD:
                    if len(words) >= CACHED_WORDS // 2:
                        self.older, self.words = words, {}
                        words, known, before = self.words, self.words.get, self.older.get
                    words[word] = ids
            found.append(ids)
        return list(chain.from_iterable(found))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        text = b"".join(map(self.emitted.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def joined_characters(pieces: Iterable[str]) -> list[set[str]]:
    """The characters of pieces, largest group first: what stands side by side in a piece is in
    one group. Space marks at the beginning of a piece belong to none."""
    group_of: dict[str, set[str]] = {}
    for piece in pieces:
        own = set(piece.lstrip(SPACE))
        known = {id(g): g for g in map(group_of.get, own) if g}
        if len(known) == 1 and own <= next(iter(known.values())):
            continue
        own.update(*known.values())
        group_of.update(dict.fromkeys(own, own))
    groups = {id(g): g for g in group_of.values()}.values()
    return sorted(groups, key=lambda g: (-len(g), min(g)))


def cuts(pieces: Iterable[str]) -> str:
    """The pattern of the words of a text: runs of characters that pieces may join, with the
    space marks before them. A character that no piece joins to another is a word."""
    several = [g for g in joined_characters(pieces) if len(g) > 1]
    classes = [*several[:OWN_CLASSES], set().union(*several[OWN_CLASSES:])]
    told = ["".join(map(re.escape, sorted(g))) for g in classes if g]
    runs = "|".join([f"[{g}]+" for g in told] + [f"[^{SPACE}\n\t{''.join(told)}]"])
    return f"{SPACE}*(?:{runs})|{SPACE}+|[\n\t]"


def normaliser_of(model: bytes) -> dict:
    """The normaliser part of a serialised model (field 3 of its message), and the model's
    type, which stands in its trainer part (field 2)."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def varint() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte = data[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(data):
            key = varint()
            kind = key & 7
            if kind == 0:
                yield key >> 3, varint()
            else:
                size = {1: 8, 5: 4}.get(kind) or varint()
                yield key >> 3, data[at : at + size]
                at += size

    trained, spec = (
        dict(fields(next((v for k, v in fields(model) if k == part), b""))) for part in (2, 3)
    )
    return {
        "model_type": trained.get(3, UNIGRAM),
        "charsmap": spec.get(2, b""),
        "dummy_prefix": bool(spec.get(3, 1)),
        "remove_extra_spaces": bool(spec.get(4, 1)),
        "escape_spaces": bool(spec.get(5, 1)),
    }


@lru_cache(maxsize=1)
def compiled(model: bytes) -> Transducer:
    """The machine of a model, kept with what it has learnt for the next tasks of a worker."""
    return Transducer(model)


def _machine(model: bytes) -> Transducer:
    """From the installed package where a worker has it, which keeps the machine between tasks."""
    try:
        from labelcorr.llm import pieces
    except ImportError:
        return Transducer(model)
    return pieces.compiled(model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encoded(
    docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, ids)`` of every row: the piece ids of its whole text.

    A null or empty text has no ids; repeated rows are each encoded; other
    columns are not looked at. The model file (half a megabyte) travels with the job.
    """
    proto = read_model(model)
    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    id_type = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(proto)
        for batch in batches:
            found = [machine.encode(t.as_py().decode()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found)], ["id", "ids"])

    return arrow_rows(rows, run, f"id {id_type}, ids array<int>")


def decoded(
    tokens: DataFrame, model: str = MODEL, id_col: str = "id", ids_col: str = "ids"
) -> DataFrame:
    """``(id, text)`` of rows with piece ids; no ids give an empty text."""
    proto = read_model(model)
    none = F.array().cast("array<int>")
    rows = tokens.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), none).alias("ids"))
    id_type = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(proto)
        for batch in batches:
            texts = [machine.decode(ids.as_py()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], ["id", "text"]
            )

    return arrow_rows(rows, run, f"id {id_type}, text string")


def round_trips(
    docs: DataFrame,
    model: str = MODEL,
    id_col: str = "doc_id",
    text_col: str = "text",
    also: Sequence[str] = (),
) -> DataFrame:
    """``(id, *also, ids, n_tokens, decoded_sha256, round_trip)``: encoded and decoded in one pass.

    ``round_trip`` is false only for texts with the model's space mark (U+2581),
    which decodes to a space. Null and empty texts have no ids and decode to an
    empty text; null ids and repeated rows stay as they are, row by row; columns
    named in ``also`` are passed on, others are not looked at; an empty table
    gives an empty result.
    """
    proto = read_model(model)
    rows = docs.select(utf8(text_col).alias("text"), F.col(id_col).alias("id"), *also)
    told = rows.drop("text")
    names = ["ids", "n_tokens", "decoded_sha256", "round_trip"]
    values = [F.array().cast("array<int>"), F.lit(0).cast("long"), F.lit(""), F.lit(True)]
    schema = told.withColumns(dict(zip(names, values))).schema
    all_names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(proto)
        for batch in batches:
            ids, digests, same = [], [], []
            for value in batch.column(0):
                text = value.as_py().decode()
                ids.append(machine.encode(text))
                back = machine.decode(ids[-1])
                digests.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == text)
            n = pa.array([len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], _lists(ids), n, pa.array(digests, pa.string()), pa.array(same, pa.bool_())],
                all_names,
            )

    return arrow_rows(rows, run, schema)


def _lists(found: list[list[int]]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    flat = np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
