"""Label axes that are data: tables ``(axis, raw, code, name)`` of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelcorr.functions.labels import LabelAxis
from labelcorr.session import broadcast_if_small, few_rows

MAX_BROADCAST_LABELS = 100_000
MAX_CLASSES = 10_000


def encode_by_table(
    df: DataFrame,
    raw: str,
    labels: DataFrame,
    axis: str | None = None,
    default: int | None = None,
    code_col: str = "code",
    name_col: str | None = None,
) -> DataFrame:
    """Add the code, and the display name if asked, of a raw value by a label table.

    Values outside the axis get ``default`` and no name; without a default they
    raise when the row is read. A NULL value is looked up like any other. The
    table is broadcast while it is small and joined by shuffle beyond that. A raw
    value that stands in the table twice would double rows: it raises here.
    """
    table = labels if axis is None else labels.filter(F.col("axis") == axis)
    refuse_repeated(table)
    told = table.select(
        F.col("raw").alias("_raw"),
        F.struct(F.col("code").cast("int").alias("code"), F.col("name").alias("name")).alias("_label"),
    )
    told = broadcast_if_small(told, MAX_BROADCAST_LABELS)
    joined = df.join(told, F.col(raw).cast("string").eqNullSafe(F.col("_raw")), "left")
    missing = F.concat_ws(" ", F.lit(f"not a {axis or 'known'} label:"), F.coalesce(F.col(raw).cast("string"), F.lit("NULL")))
    other = F.raise_error(missing).cast("int") if default is None else F.lit(default)
    code = F.when(F.col("_label").isNotNull(), F.col("_label.code")).otherwise(other)
    names = {} if name_col is None else {name_col: F.col("_label.name")}
    return joined.withColumns({code_col: code, **names}).drop("_raw", "_label")


def refuse_repeated(table: DataFrame) -> None:
    """Raise if a raw value has more than one row."""
    several = table.groupBy("raw").agg(F.count("*").alias("n")).filter("n > 1")
    found = [r["raw"] for r in several.orderBy("raw").limit(5).collect()]
    if found:
        raise ValueError(f"raw labels with more than one row: {', '.join(map(str, found))}")


def read_axis(labels: DataFrame, name: str, fill: str | None = None) -> LabelAxis:
    """An axis of a label table as expressions, for all operators that take an axis.

    Codes have to be 0 to n - 1 with one display name each. Axes of more than
    ``MAX_CLASSES`` raw values stay tables: they raise.
    """
    table = labels.filter(F.col("axis") == name)
    refuse_repeated(table)
    rows = few_rows(table.select("raw", "code", "name"), MAX_CLASSES)
    if rows is None:
        raise ValueError(f"{name} has more than {MAX_CLASSES} raw values: use encode_by_table")
    names: dict[int, str] = {}
    for row in rows:
        if names.setdefault(row["code"], row["name"]) != row["name"]:
            raise ValueError(f"code {row['code']} of {name} has several names")
    if not names or sorted(names) != list(range(len(names))):
        raise ValueError(f"the codes of {name} are not 0 to n - 1")
    codes = {r["raw"]: r["code"] for r in sorted(rows, key=lambda r: (r["code"], str(r["raw"])))}
    return LabelAxis(name, codes, tuple(names[c] for c in sorted(names)), fill)
