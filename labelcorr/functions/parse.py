"""Parsed text as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unpacked(fields: Column) -> Column:
    """The fields of a parsed struct as columns, NULL if there is no struct.

    A plain ``data.*`` lets Spark move a later filter on a field below the parser,
    with a parser call for each field the filter names. The generator keeps such
    filters above it, so a text is parsed once.
    """
    return F.inline_outer(F.array(fields))
