import pytest
from pyspark.sql import functions as F

from labelcorr.functions import labels as L

BIAS = {
    "LeftTroll": 0,
    "Unknown": 1,
    "NonEnglish": 1,
    "Commercial": 1,
    "NewsFeed": 1,
    "HashtagGamer": 1,
    "Fearmonger": 1,
    "RightTroll": 2,
}


def codes(spark, function, raws):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, r string")
    return [r["c"] for r in rows.select("i", function(F.col("r")).alias("c")).orderBy("i").collect()]


def test_bias(spark):
    assert codes(spark, L.encode_political_bias, BIAS) == list(BIAS.values())


@pytest.mark.parametrize("raw", ["Elsewhere", None, "", "lefttroll"])
def test_strict_bias_raises(spark, raw):
    with pytest.raises(Exception, match="not a political_bias label"):
        codes(spark, L.encode_political_bias, [raw])


def test_lenient_bias(spark):
    raws = [*BIAS, "Elsewhere", None]
    lenient = codes(spark, lambda c: L.encode_political_bias(c, strict=False), raws)
    assert lenient == [*BIAS.values(), 2, 2]


@pytest.mark.parametrize(
    "function, raws",
    [
        (L.encode_sentiment, ["neg", "neu", "pos"]),
        (L.encode_emotion, ["N", "H", "A", "S", "F"]),
        (L.encode_stance, ["AGAINST", "NONE", "FAVOR"]),
        (L.encode_veracity, ["MISINFORMED_OR_POTENTIALLY_MISLEADING", "NOT_MISLEADING"]),
    ],
)
def test_other_axes(spark, function, raws):
    assert codes(spark, function, raws) == list(range(len(raws)))
    with pytest.raises(Exception, match="label"):
        codes(spark, function, ["?"])


def test_missing_emotion_is_none(spark):
    assert codes(spark, L.encode_emotion, [None, "A"]) == [0, 2]


def test_missing_sentiment_raises(spark):
    with pytest.raises(Exception, match="NULL"):
        codes(spark, L.encode_sentiment, [None])


def test_pass_shift_merge_decode(spark):
    rows = spark.createDataFrame([([1, 3], 4, "Fearmonger"), ([], None, None)], "l array<int>, c int, r string")
    out = rows.select(
        L.shift_multi_label(F.col("l")).alias("l"),
        L.pass_label(F.col("c")).alias("c"),
        L.merge_category(F.col("r")).alias("r"),
        L.POLITICAL_BIAS.decode(F.lit(2)).alias("two"),
        L.POLITICAL_BIAS.decode(F.lit(3)).alias("three"),
    ).collect()
    assert [tuple(r) for r in out] == [
        ([0, 2], 4, "Other", "Right", None),
        ([], None, "Other", "Right", None),
    ]


def test_dim(spark):
    rows = L.POLITICAL_BIAS.dim(spark).collect()
    assert {r["raw"]: r["code"] for r in rows} == BIAS
    assert {r["code"]: r["name"] for r in rows} == {0: "Left", 1: "Other", 2: "Right"}
    assert {r["axis"] for r in rows} == {"political_bias"}


def test_axes_by_name():
    assert set(L.AXES) == {"political_bias", "sentiment", "emotion", "stance", "veracity"}


def test_encoding_needs_no_join(spark, plan):
    rows = spark.createDataFrame([("neg",)], "r string")
    text = plan(rows.select(L.encode_sentiment(F.col("r"))))
    assert "Join" not in text and "Python" not in text
