"""Reproducible pseudo-random numbers from keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 60


def key_hash(*keys: Column, seed: int = 42) -> Column:
    """A number below 2 to the 60 that depends on the key and seed alone.

    Unlike ``sample`` it does not change with the partitioning of the input,
    and a task that is run again gives the same answer.
    """
    text = F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("bigint")


def in_sample(*keys: Column, fraction: float, seed: int = 42) -> Column:
    """True for about ``fraction`` of the keys; fractions down to 1e-15 are told apart."""
    if not 0 <= fraction <= 1:
        raise ValueError(f"a fraction is between 0 and 1, not {fraction}")
    return key_hash(*keys, seed=seed) < int(fraction * (1 << BITS))
