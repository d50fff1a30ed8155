"""Secret scans: fixed patterns, and a battery of randomness tests on opaque tokens."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelcorr.llm.common import arrow_rows, utf8, written

# The base patterns are fixed values. Letters of the keyword stand in either case.
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "random")

MIN_TOKEN = 16
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_TOKEN)
FALSE_DISCOVERY_RATE = 0.01
REJECTED = 0.01  # p-values below it count as not random, however unlike prose
EVIDENCE_BINS = 800  # of the evidence against prose, two to a unit of its logarithm
JUMP = 0.1  # how often plain text is taken to go on as if anew: joined words, separators
EVEN = 0.1  # share of the digits of plain numbers that are taken to be drawn evenly
BACK = 5.0  # places that single characters weigh against the pairs seen after one
# What prose looks like where a corpus has next to none; numbers are taken to be even.
PRIOR = """
The people of the town came to see what had been done with the water in the old river. Some said
that it would take more than a year before anything could be used again, and others thought that
the work should go on as long as there was money for it. Information about the application was
given to every member of the international organization, which made a number of interesting
changes to the development and administration of public services. When they were asked for their
opinion, just a few of them questioned the quality of the result; they knew how expensive it was.
"""
# Alphabets from narrow to wide; a token belongs to the first that has all its characters.
ENCODINGS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "upper36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
CHARACTERS = {name: frozenset(chars) for name, chars in ENCODINGS.items()}
RANKS = {name: {c: i for i, c in enumerate(chars)} for name, chars in ENCODINGS.items()}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the fixed patterns, per kind leftmost and not overlapping."""
    found = [
        (m.start(), m.end(), "assign")
        for m in ASSIGN.finditer(text)
        if len(m.group(2)) >= MIN_ASSIGNED
    ]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return in_order(found)


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def encoding_of(token: str) -> str:
    chars = set(token)
    return next(name for name, allowed in CHARACTERS.items() if chars <= allowed)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(token: str, encoding: str) -> float:
    """Combined p-value of three tests that the token is drawn evenly from its alphabet.

    Chi-squared of the symbol counts, folded to at most eight cells so that short
    tokens fill them; runs above and below the middle of the alphabet; serial
    correlation of successive symbols. Each is a two-sided normal approximation;
    the smallest of the three counts, times three. Close to 1 for random tokens,
    close to 0 for words and numbers in sequence.
    """
    ranks = RANKS[encoding]
    size, n = len(ranks), len(token)
    x = np.fromiter((ranks[c] for c in token), np.float64, n)
    cells = min(size, 8, max(2, n // 4))
    counts = np.bincount((x * cells // size).astype(int), minlength=cells)
    widths = np.bincount(np.arange(size) * cells // size, minlength=cells) / size
    chi = float((((counts - n * widths) ** 2) / (n * widths)).sum())
    # Wilson-Hilferty: the cube root of chi-squared is close to normal.
    free = cells - 1
    z_chi = ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    p_chi = 0.5 * math.erfc(z_chi / math.sqrt(2))
    high = x >= size / 2
    up = int(high.sum())
    down = n - up
    if up and down:
        mean = 2 * up * down / n + 1
        spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / max(1, n - 1)))
        p_runs = _two_sided((1 + int((high[1:] != high[:-1]).sum()) - mean) / spread)
    else:
        p_runs = 2.0 ** (1 - n)
    d = x - x.mean()
    var = float((d * d).sum())
    p_serial = 0.0
    if var:
        r = float((d[1:] * d[:-1]).sum()) / var
        p_serial = _two_sided((r + 1 / n) * math.sqrt(n))
    return min(1.0, 3 * min(p_chi, p_runs, p_serial))


PLACES = np.full(128, len(ENCODINGS["mixed"]))
PLACES[[ord(c) for c in ENCODINGS["mixed"]]] = np.arange(len(ENCODINGS["mixed"]))
OUTSIDE = len(ENCODINGS["mixed"])


def places(text: str) -> np.ndarray:
    """Per character its place in the widest alphabet, ``OUTSIDE`` for all others."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return PLACES[np.minimum(codes, 127)]


def pairs_of(at: np.ndarray) -> np.ndarray:
    """Counts of neighbouring places; a text starts after a character outside."""
    side = OUTSIDE + 1
    before = np.concatenate([[OUTSIDE], at[:-1]])
    return np.bincount(before * side + at, minlength=side * side)


class Prose:
    """What a token looks like if it is only text: characters that follow one another as in prose.

    Learnt from the pairs of neighbouring characters of all documents, outside
    of candidates and base spans, as written and in capitals. With probability
    ``JUMP`` a character does not depend on the one before it. Half of the long
    tokens are taken to be numbers, with digits that follow as in prose or are even.
    """

    def __init__(self, pairs: np.ndarray):
        side = OUTSIDE + 1
        seen = (pairs + pairs_of(places(PRIOR))).reshape(side, side).astype(float)
        digits = PLACES[[ord(c) for c in ENCODINGS["digits"]]]
        seen[np.ix_(digits, digits)] += 1.0
        numbers = seen[np.ix_(digits, digits)]
        numbers = (1 - EVEN) * numbers / numbers.sum(1, keepdims=True) + EVEN / len(digits)
        self.numbers = np.full((side, OUTSIDE), -np.inf)
        self.numbers[np.ix_(digits, digits)] = np.log(numbers)
        self.numbers[OUTSIDE, digits] = -math.log(len(digits))
        shouted = np.zeros_like(seen)
        capital = np.append(PLACES[[ord(c.upper()) for c in ENCODINGS["mixed"]]], OUTSIDE)
        np.add.at(shouted, (capital[:, None], capital[None, :]), seen)
        seen = (seen + shouted)[:, :OUTSIDE]
        single = (seen.sum(0) + 1) / (seen.sum() + OUTSIDE)
        after = (seen + BACK * single) / (seen.sum(1, keepdims=True) + BACK)
        self.logs = np.log((1 - JUMP) * after + JUMP * single)

    def evidence(self, token: str) -> float:
        """Logarithm of an e-value against prose: of a token from it, ``exp`` is 1 or less on average.

        How much likelier the token is if drawn evenly from one of the alphabets,
        all equally likely, than as prose of the same length. Only the token's
        own alphabet is counted, which makes it smaller.
        """
        at = places(token)
        before = np.concatenate([[OUTSIDE], at[:-1]])
        as_text, as_number = self.logs[before, at].sum(), self.numbers[before, at].sum()
        as_prose = np.logaddexp(as_text, as_number) - math.log(2)
        size = len(ENCODINGS[encoding_of(token)])
        return float(-len(token) * math.log(size) - math.log(len(ENCODINGS)) - as_prose)

    def evidence_bin(self, token: str) -> int:
        """The evidence in halves, rounded down; -1 if there is none or the battery rejected."""
        return max(-1, min(EVIDENCE_BINS - 1, math.floor(2 * self.evidence(token)))) if token else -1


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Tokens of any characters ``(start, end, token)`` that overlap no base span; no token if the battery rejects."""
    found = []
    for m in TOKEN.finditer(text):
        token = m.group().rstrip("=")
        if any(s < m.end() and e > m.start() for s, e, _ in base):
            continue
        random = randomness(token, encoding_of(token)) >= REJECTED
        found.append((m.start(), m.end(), token if random else ""))
    return found


def prose_pairs(text: str, base: list[tuple[int, int, str]]) -> np.ndarray:
    """Counts of neighbouring characters outside of base spans and of all tokens long enough."""
    at = places(text)
    if not len(at):
        return np.zeros((OUTSIDE + 1) ** 2, np.int64)
    for start, end in [m.span() for m in TOKEN.finditer(text)] + [s[:2] for s in base]:
        at[start:end] = OUTSIDE
    return pairs_of(at)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row the base spans and the candidates, in one pass over whole texts.

    One more row per task, the only ones with ``pairs``, has the counts of prose.
    """
    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    id_type = dict(rows.dtypes)["id"]
    numbers = pa.list_(pa.int64())
    names = ["id", "base", "tokens", "words", "pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros((OUTSIDE + 1) ** 2, np.int64)
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            base, tokens, words = [], [], []
            for value in batch.column(1):
                text = value.as_py().decode()
                spans = base_spans(text)
                base.append([x for s, e, kind_of in spans for x in (s, e, KINDS.index(kind_of))])
                found = candidates(text, spans)
                tokens.append([x for s, e, _ in found for x in (s, e)])
                words.append([token for _, _, token in found])
                pairs += prose_pairs(text, spans)
            columns = [pa.array(base, numbers), pa.array(tokens, numbers), pa.array(words, pa.list_(pa.string()))]
            none = pa.nulls(len(base), numbers)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, none], names)
        if kind is not None:
            empty = [pa.nulls(1, t) for t in (kind, numbers, numbers, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([pairs.tolist()], numbers)], names)

    return arrow_rows(
        rows,
        run,
        f"id {id_type}, base array<long>, tokens array<long>, words array<string>, pairs array<long>",
    )


def learnt(scanned: DataFrame) -> Prose:
    """The prose of the whole corpus: one sum per pair of characters, 4,489 at most."""
    cells = scanned.filter("pairs IS NOT NULL").select(F.posexplode("pairs").alias("at", "n"))
    pairs = np.zeros((OUTSIDE + 1) ** 2, np.int64)
    for r in cells.groupBy("at").agg(F.sum("n").alias("n")).collect():
        pairs[r["at"]] = r["n"]
    return Prose(pairs)


def bar(rows: DataFrame, prose: Prose, rate: float) -> int:
    """The smallest evidence, in bins, that keeps the false discovery rate.

    Benjamini and Hochberg's rule for e-values, which holds however the tokens
    depend on each other: of ``m`` tokens the ``k`` with the most evidence are
    reported if each has an e-value of ``m / (rate k)``. Each token has its own
    length's and alphabet's e-value, so a token alone can be reported. The
    tokens are counted per bin over the whole corpus.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = Counter(prose.evidence_bin(w) for words in batch.column(0).to_pylist() for w in words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(bins), pa.int64()), pa.array(list(bins.values()), pa.int64())], ["bin", "n"]
            )

    counted = arrow_rows(rows.select("words"), run, "bin long, n long")
    counts = np.zeros(EVIDENCE_BINS + 1)
    for r in counted.groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r["bin"]] = r["n"]  # -1 is the last
    m, least = counts.sum(), EVIDENCE_BINS
    reported = np.cumsum(counts[-2::-1])[::-1]
    for at in range(EVIDENCE_BINS):
        if reported[at] and at / 2 >= math.log(m / (rate * reported[at])):
            least = at
            break
    return least


def secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rate: float = FALSE_DISCOVERY_RATE,
) -> DataFrame:
    """``(id, base, found)`` per row: spans as ``array<struct<kind, start, end>>`` in order.

    ``base`` has the spans of the fixed patterns, ``found`` also those of opaque
    tokens that overlap no base span, pass the battery and are unlike prose
    beyond the bar. Offsets count code points. Null texts are empty and have no
    spans; repeated rows are each returned; other columns are not looked at; an
    empty table gives an empty result.
    """
    scanned = written(scan(docs, id_col, text_col), "scanned")
    rows = scanned.filter("pairs IS NULL")
    prose = learnt(scanned)
    least = bar(rows, prose, rate)

    def chosen(base: list[int], tokens: list[int], words: list[str]) -> tuple[list, list]:
        spans = [(base[i], base[i + 1], KINDS[base[i + 2]]) for i in range(0, len(base), 3)]
        more = [
            (tokens[2 * i], tokens[2 * i + 1], "random")
            for i, word in enumerate(words)
            if prose.evidence_bin(word) >= least
        ]
        return spans, in_order(spans + more)

    id_type = dict(scanned.dtypes)["id"]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [chosen(*row) for row in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
            sides = [
                pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in x[i]] for x in both], span)
                for i in (0, 1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sides], ["id", "base", "found"])

    spans = "array<struct<kind: string, start: long, end: long>>"
    return arrow_rows(
        rows.select("id", "base", "tokens", "words"), run, f"id {id_type}, base {spans}, found {spans}"
    )
