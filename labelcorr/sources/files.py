"""Choosing part files."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, directory: str, pattern: str = "*.csv") -> list[str]:
    """The files of a folder on any file system Spark can read, sorted by name."""
    found = spark.read.option("pathGlobFilter", pattern).text(directory).inputFiles()
    return sorted(found)


def select_files(
    files: Sequence[str],
    first: int | None = None,
    sample: int | None = None,
    seed: int = 42,
) -> list[str]:
    """The first n files by name, or n files drawn by a hash of name and seed."""
    by_name = sorted(files)
    if first is not None:
        return by_name[:first]
    if sample is not None:
        return sorted(by_name, key=lambda f: (_draw(f, seed), f))[:sample]
    return by_name


def numbered_files(pattern: str, numbers: Sequence[int]) -> list[str]:
    """Paths of numbered parts, e.g. ``parts_{}.csv`` with ``range(1, 9)``."""
    return [pattern.format(n) for n in numbers]


def holdout_files(files: Sequence[str], k: int) -> tuple[list[str], list[str]]:
    """``(train, test)`` paths; reading them apart needs no filter on the rows."""
    by_name = sorted(files)
    return by_name[:k] + by_name[k + 1 :], by_name[k : k + 1]


def sample_file_rows(
    df: DataFrame, n: int, seed: int = 42, file_col: str = "file_name"
) -> DataFrame:
    """The rows of n files drawn by a hash of name and seed, for data read already."""
    draw = F.md5(F.concat(F.col(file_col), F.lit(str(seed))))
    drawn = df.select(file_col).distinct().orderBy(draw, file_col).limit(n)
    return df.join(F.broadcast(drawn), file_col, "left_semi")


def _draw(path: str, seed: int) -> str:
    name = path.rsplit("/", 1)[-1]
    return hashlib.md5(f"{name}{seed}".encode()).hexdigest()
