"""Label axes: raw category to integer code and back."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LabelAxis:
    """One label axis: raw values with their codes, display names by code."""

    name: str
    codes: Mapping[str, int]
    names: tuple[str, ...]
    fill: str | None = None

    @property
    def classes(self) -> list[int]:
        return list(range(len(self.names)))

    def encode(self, raw: Column, default: int | None = None) -> Column:
        """Raw value to code.

        Values outside the axis, missing ones included, become ``default``;
        without a default they raise. An axis with ``fill`` reads missing
        values as that raw value.
        """
        if self.fill is not None:
            raw = fill_missing(raw, self.fill)
        by_code: dict[int, list[str]] = {}
        for value, code in self.codes.items():
            by_code.setdefault(code, []).append(value)
        branches = F.when(F.lit(False), F.lit(0))
        for code, values in by_code.items():
            branches = branches.when(raw.isin(values), F.lit(code))
        if default is not None:
            return branches.otherwise(F.lit(default))
        message = F.concat(
            F.lit(f"not a {self.name} label: "), F.coalesce(raw, F.lit("NULL"))
        )
        return branches.otherwise(F.raise_error(message).cast("int"))

    def decode(self, code: Column) -> Column:
        """Code to display name; NULL outside the axis."""
        return F.get(F.array(*[F.lit(n) for n in self.names]), code)

    def dim(self, spark: SparkSession) -> DataFrame:
        """The axis as a table ``(axis, raw, code, name)``."""
        rows = [
            F.struct(
                F.lit(self.name).alias("axis"),
                F.lit(raw).alias("raw"),
                F.lit(code).alias("code"),
                F.lit(self.names[code]).alias("name"),
            )
            for raw, code in self.codes.items()
        ]
        return spark.range(1).select(F.inline(F.array(*rows)))


# Raw categories, codes and display names of the axes.
POLITICAL_BIAS = LabelAxis(
    "political_bias",
    {
        "LeftTroll": 0,
        "Unknown": 1,
        "NonEnglish": 1,
        "Commercial": 1,
        "NewsFeed": 1,
        "HashtagGamer": 1,
        "Fearmonger": 1,
        "RightTroll": 2,
    },
    ("Left", "Other", "Right"),
)
SENTIMENT = LabelAxis(
    "sentiment",
    {"neg": 0, "neu": 1, "pos": 2},
    ("Negative", "Neutral", "Positive"),
)
EMOTION = LabelAxis(
    "emotion",
    {"N": 0, "H": 1, "A": 2, "S": 3, "F": 4},
    ("N", "H", "A", "S", "F"),
    fill="N",
)
STANCE = LabelAxis(
    "stance",
    {"AGAINST": 0, "NONE": 1, "FAVOR": 2},
    ("AGAINST", "NONE", "FAVOR"),
)
VERACITY = LabelAxis(
    "veracity",
    {"MISINFORMED_OR_POTENTIALLY_MISLEADING": 0, "NOT_MISLEADING": 1},
    ("MISINFORMED_OR_POTENTIALLY_MISLEADING", "NOT_MISLEADING"),
)

AXES = {a.name: a for a in (POLITICAL_BIAS, SENTIMENT, EMOTION, STANCE, VERACITY)}

# Fixed value: the code of a bias category that the lenient encoder does not know.
LENIENT_BIAS_DEFAULT = 2


def fill_missing(raw: Column, value: str) -> Column:
    return F.coalesce(raw, F.lit(value))


def encode_political_bias(raw: Column, strict: bool = True) -> Column:
    """Strict raises on an unknown or missing category, lenient codes it 2."""
    return POLITICAL_BIAS.encode(raw, None if strict else LENIENT_BIAS_DEFAULT)


def encode_sentiment(raw: Column) -> Column:
    return SENTIMENT.encode(raw)


def encode_emotion(raw: Column) -> Column:
    return EMOTION.encode(raw)


def encode_stance(raw: Column) -> Column:
    return STANCE.encode(raw)


def encode_veracity(raw: Column) -> Column:
    return VERACITY.encode(raw)


def pass_label(raw: Column) -> Column:
    """Labels that are codes already, such as conspiracy."""
    return raw


def shift_multi_label(labels: Column) -> Column:
    """1-based label lists to 0-based ones."""
    return F.transform(labels, lambda label: label - 1)


def merge_category(raw: Column, axis: LabelAxis = POLITICAL_BIAS, other: int = 1) -> Column:
    """Raw category to display name; whatever the axis does not know is ``other``."""
    return axis.decode(axis.encode(raw, default=other))
