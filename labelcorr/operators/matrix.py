"""Confusion counts and conditional label distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelcorr.functions.labels import LabelAxis

# The class of labels that are in no list, where they are kept.
OUTSIDE = -1


def confusion_counts(df: DataFrame, given: str, pred: str, *sums: Column) -> DataFrame:
    """``(given, pred, n)`` for the pairs that occur, plus further aggregates."""
    pair = [F.col(given).alias("given"), F.col(pred).alias("pred")]
    return df.groupBy(*pair).agg(F.count("*").alias("n"), *sums)


def conditional_distribution(counts: DataFrame) -> DataFrame:
    """Add ``p = P(pred | given)``; NULL where the given class has no rows."""
    row_total = F.sum("n").over(Window.partitionBy("given"))
    return counts.withColumn("p", F.try_divide(F.col("n").cast("double"), row_total))


def dense_matrix(
    counts: DataFrame,
    given_classes: Sequence[int],
    pred_classes: Sequence[int],
    outside: str = "raise",
) -> DataFrame:
    """``(given, pred, n)`` for every pair of the two class lists, zeros filled.

    Pairs outside the lists raise an error. With ``outside="keep"`` both axes get
    two classes more, ``OUTSIDE`` for other values and NULL for missing ones, so
    every row stays in the denominators.

    The counts, a row per pair, are folded into one row with a sum per cell.
    A join with the cells would filter the labels, and Spark moves that filter
    below the counting: a model would score every post once more to be filtered.
    """
    given, pred = _axis("given", given_classes, outside), _axis("pred", pred_classes, outside)
    cells, sums = {}, []
    for i, (g, is_given) in enumerate(given):
        for j, (p, is_pred) in enumerate(pred):
            cells[g, p] = f"_n{i}_{j}"
            sums.append(F.expr(f"sum(CASE WHEN {is_given} AND {is_pred} THEN n END) AS {cells[g, p]}"))
    in_cells = " OR ".join(f"({g} AND {p})" for _, g in given for _, p in pred)
    rest = F.expr(f"sum(CASE WHEN {in_cells} THEN 0 ELSE n END) AS _rest")
    return counts.agg(*sums, rest).select(_cells(cells))


def _axis(name: str, classes: Sequence[int], outside: str) -> list[tuple[int | None, str]]:
    """``(class, condition)`` of the classes of an axis; conditions are never NULL."""
    if outside not in ("raise", "keep"):
        raise ValueError(f"outside is 'raise' or 'keep', not {outside!r}")
    found = [(c, f"({name} <=> {c})") for c in classes]
    if outside == "keep":
        listed = ", ".join(str(c) for c in classes) or "NULL"
        found.append((OUTSIDE, f"coalesce({name} NOT IN ({listed}), false)"))
        found.append((None, f"({name} IS NULL)"))
    return found


def _cells(columns: dict[tuple[int | None, int | None], str]) -> Column:
    """One row ``(given, pred, n)`` per cell from a row with a column per cell and ``_rest``."""

    def number(c: int | None) -> str:
        return f"cast({'NULL' if c is None else c} AS int)"

    rows = [
        f"struct({number(given)} AS given, {number(pred)} AS pred, coalesce({name}, 0L) AS n)"
        for (given, pred), name in columns.items()
    ]
    refuse = "raise_error('labels outside the listed classes: ' || _rest || ' rows')"
    cells = f"array({', '.join(rows)})"
    return F.expr(f"inline(CASE WHEN coalesce(_rest, 0) > 0 THEN {refuse} ELSE {cells} END)")


def distribution_matrix(
    df: DataFrame,
    given: str,
    pred: str,
    given_classes: Sequence[int],
    pred_classes: Sequence[int],
    outside: str = "raise",
) -> DataFrame:
    """``(given, pred, n, p)`` for every cell."""
    counts = confusion_counts(df, given, pred)
    return conditional_distribution(dense_matrix(counts, given_classes, pred_classes, outside))


def name_matrix(matrix: DataFrame, given: LabelAxis, pred: LabelAxis) -> DataFrame:
    """Add the display names of both axes."""
    return matrix.withColumns(
        {
            "given_name": given.decode(F.col("given")),
            "pred_name": pred.decode(F.col("pred")),
        }
    )


def wide_matrix(matrix: DataFrame, pred_classes: Sequence[int], value: str = "p") -> DataFrame:
    """One row per given class, one column ``pred_<class>`` per predicted one."""
    wide = matrix.groupBy("given").pivot("pred", list(pred_classes)).agg(F.first(value))
    return wide.select("given", *[F.col(f"`{c}`").alias(f"pred_{c}") for c in pred_classes])


def label_association(
    axis_a: DataFrame,
    axis_b: DataFrame,
    key: str,
    a_label: str,
    b_label: str,
    a_classes: Sequence[int],
    b_classes: Sequence[int],
    outside: str = "raise",
) -> DataFrame:
    """P(b label | a label) for two label tables that share a post key.

    Each table is first folded to one row of class counters per key. That
    happens before the shuffle too, so a key that holds many rows stays one
    row per task, its row pairs are multiplied instead of emitted, and the
    join reuses the partitioning of the fold. Labels outside the lists raise,
    or are kept as in ``dense_matrix``.
    """

    def fold(df: DataFrame, label: str, classes: Sequence[int], prefix: str) -> DataFrame:
        counters = [
            F.expr(f"count_if({holds})").alias(f"{prefix}{i}")
            for i, (_, holds) in enumerate(_axis(f"`{label}`", classes, outside))
        ]
        return df.groupBy(key).agg(*counters, F.count("*").alias(f"{prefix}_all"))

    both = fold(axis_a, a_label, a_classes, "_a").join(
        fold(axis_b, b_label, b_classes, "_b"), key
    )
    cells, sums = {}, []
    for i, (a, _) in enumerate(_axis("a", a_classes, outside)):
        for j, (b, _) in enumerate(_axis("b", b_classes, outside)):
            cells[a, b] = f"_n{i}_{j}"
            sums.append(F.expr(f"sum(_a{i} * _b{j}) AS {cells[a, b]}"))
    listed = " + ".join(f"_a{i} * _b{j}" for i in range(len(_axis("a", a_classes, outside)))
                        for j in range(len(_axis("b", b_classes, outside))))
    rest = F.expr(f"sum(_a_all * _b_all - ({listed})) AS _rest")
    return conditional_distribution(both.agg(*sums, rest).select(_cells(cells)))
