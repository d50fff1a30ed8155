"""Dense statistics of whole texts, taken in one pass."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelcorr.llm.common import arrow_rows, utf8

# Insults and slurs against a person, lower case, one word each: where no lexicon was learnt.
LEXICON = frozenset(
    """
    idiot idiots idiotic moron morons moronic loser losers clown clowns scum scumbag
    trash garbage pathetic worthless disgusting stupid dumb dumbass fool fools imbecile
    imbeciles cretin cretins jerk jerks bastard bastards bitch bitches asshole assholes
    shit shithead fuck fucker fucking retard retarded freak freaks creep creeps coward
    cowards vermin filth filthy parasite parasites degenerate degenerates dimwit halfwit
    nitwit lowlife swine brainless
    """.split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself ur u youre tu te toi vous votre du dich dir dein ihr euch tú ti usted vosotros".split()
)
NEAR_WORDS = 5

NAMES = (
    "log_words", "mean_word", "distinct_words", "upper", "shouted", "digits", "stops",
    "exclaims", "symbols", "symbol_runs", "pipes", "non_ascii", "repeated_lines",
    "log_lines", "spaces", "insults", "log_insults", "distinct_insults", "second_person",
    "insults_near_you", "obfuscated", "spelled_out",
)
# Added where a lexicon was learnt.
LEARNT = ("learnt_share", "learnt_weight", "learnt_most")
SHORTEST, LONGEST = 3, 10  # bytes of the beginnings of words that a lexicon holds
KNOWN_WORDS = 200_000


class Weights(dict):
    """The weight of a word by a lexicon of words (``=word``) and beginnings; 0 if it has none.

    A dictionary of the words seen so far, of bounded size.
    """

    def __init__(self, lexicon: dict[bytes, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> float:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = max((self.lexicon.get(t, 0.0) for t in terms(word)), default=0.0)
        if len(word) < 100:
            self[word] = found
        return found


def terms(word: bytes) -> list[bytes]:
    """What a lexicon may know of a word: itself, and how it begins."""
    return [b"=" + word, *[word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)]]


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters, A-Z lower-cased; bytes beyond ASCII count as letters."""
    return text.translate(PLAIN).split()


def _table(keep: bytes, swap: dict[str, str] | None = None) -> bytes:
    """Bytes as they are if in ``keep`` or not ASCII, lower case, else a space."""
    table = bytearray(32 if i < 128 else i for i in range(256))
    for i in keep:
        table[i] = i
    for i in range(65, 91):
        table[i] = i + 32
    for a, b in (swap or {}).items():
        table[ord(a)] = ord(b)
    return bytes(table)


SHOUTED = re.compile(rb"[A-Z]{2,}").findall
LETTERS = b"abcdefghijklmnopqrstuvwxyz"
PLAIN = _table(LETTERS)
LEET = _table(
    LETTERS, {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
)
MARKS = np.frombuffer(b"#$%&*@^~<>=+_\\{}[]", np.uint8)
IS_MARK = np.zeros(256, bool)
IS_MARK[[*MARKS, 33]] = True
INSULTS = frozenset(w.encode() for w in LEXICON)
YOU = frozenset(w.encode() for w in SECOND_PERSON)


def features(text: bytes, weights: Weights | None = None) -> list[float]:
    """One number per name in ``NAMES``, and with ``weights`` in ``LEARNT``; all zero for an
    empty text. With ``weights``, insults are the words that have one."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (len(NAMES) + (len(LEARNT) if weights is not None else 0))
    size = len(text)
    codes = np.frombuffer(text, np.uint8)
    seen = np.bincount(codes, minlength=256)
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    hit = IS_MARK[codes]
    runs = int(np.count_nonzero(hit[1:] & hit[:-1]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    plain = words_of(text)
    weigh = INSULTS.__contains__ if weights is None else weights.__getitem__
    told = list(map(weigh, plain))
    found = [i for i, hit in enumerate(told) if hit]
    you = [i for i, w in enumerate(plain) if w in YOU] if found else []
    addressed = 0
    if you:
        at = np.asarray(you)
        for i in found:
            j = np.searchsorted(at, i)
            gap = min(abs(int(at[k]) - i) for k in (j - 1, j) if 0 <= k < len(at))
            addressed += gap <= NEAR_WORDS
    masked = sum(map(bool, map(weigh, text.translate(LEET, b"*.-_").split())))
    single = np.fromiter(map(len, plain), np.int64, len(plain)) == 1
    spelled = int(np.count_nonzero(single[3:] & single[2:-1] & single[1:-2] & single[:-3]))
    per_word = 1000.0 / n
    learnt = []
    if weights is not None:
        # A few words more than there are: single hits in short texts are worth less.
        learnt = [len(found) / (n + 5), sum(told) / (n + 5) ** 0.5, max(told, default=0.0)]
    return [
        float(np.log1p(n)),
        size / n,
        len(set(words)) / n,
        upper / max(1, upper + lower),
        len(SHOUTED(text)) / n,
        int(seen[48:58].sum()) / size,
        int(seen[[44, 46, 58, 59]].sum()) / size,
        int(seen[[33, 63]].sum()) / n,
        int(seen[MARKS].sum()) / size,
        runs / size,
        int(seen[124]) / n,
        int(seen[128:].sum()) / size,
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(len(lines))),
        int(seen[[9, 10, 13, 32]].sum()) / size,
        len(found) * per_word,
        float(np.log1p(len(found))),
        float(len({plain[i] for i in found})),
        sum(map(YOU.__contains__, plain)) * per_word,
        addressed * per_word,
        max(0, masked - len(found)) * per_word,
        spelled * per_word,
        *learnt,
    ]


def statistics(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    *also: str,
    lexicons: Sequence[dict[bytes, float]] | None = None,
    which: Column | None = None,
) -> DataFrame:
    """``(id, *also, *NAMES)`` per row, over whole texts; null counts as empty.

    With ``lexicons``, of bounded size, ``LEARNT`` too, by the lexicon whose number
    ``which`` gives (the first by default). An empty table gives an empty result.
    """
    which = F.lit(0) if which is None else which
    rows = docs.select(
        utf8(text_col).alias("text"), which.cast("int").alias("_which"), F.col(id_col).alias("id"), *also
    )
    names = NAMES if lexicons is None else (*NAMES, *LEARNT)
    told = [T.StructField(name, T.DoubleType()) for name in names]
    schema = T.StructType(rows.drop("text", "_which").schema.fields + told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = None if lexicons is None else [Weights(x) for x in lexicons]
        for batch in batches:
            pairs = zip(batch.column(0), batch.column(1).to_pylist())
            found = [features(t.as_py(), weights and weights[k]) for t, k in pairs]
            found = np.array(found, np.float64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], *[pa.array(found[:, i]) for i in range(len(names))]],
                [*batch.schema.names[2:], *names],
            )

    return arrow_rows(rows, run, schema)
