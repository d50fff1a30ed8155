"""Token arrays: split, cut, pad and mask."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token length, and the start, end, padding and unknown markers.
MAX_LEN = 64
CLS = "[CLS]"
SEP = "[SEP]"
PAD = "[PAD]"
UNK = "[UNK]"

WORD_GAPS = "[^a-z0-9]+"


def tokenize(text: Column, gaps: str = WORD_GAPS) -> Column:
    """Lower-cased words between the ``gaps`` pattern."""
    return F.array_remove(F.split(F.lower(text), gaps), "")


def add_special_tokens(tokens: Column, max_len: int = MAX_LEN) -> Column:
    """Start and end marker around the tokens, all within ``max_len``."""
    return F.concat(
        F.array(F.lit(CLS)), F.slice(tokens, 1, max_len - 2), F.array(F.lit(SEP))
    )


def pad_truncate(tokens: Column, pad: Column, max_len: int = MAX_LEN) -> Column:
    """Exactly ``max_len`` items: the tail is cut, or ``pad`` added on the right."""
    head = F.slice(tokens, 1, max_len)
    return F.concat(head, F.array_repeat(pad, F.lit(max_len) - F.size(head)))


def attention_mask(tokens: Column, max_len: int = MAX_LEN) -> Column:
    """1 for each token kept, 0 for padding."""
    kept = F.least(F.size(tokens), F.lit(max_len))
    return F.concat(
        F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), F.lit(max_len) - kept)
    )


def token_type_ids(max_len: int = MAX_LEN) -> Column:
    """Segment ids of a single text: all 0."""
    return F.array_repeat(F.lit(0), max_len)
