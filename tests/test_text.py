from itertools import groupby

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelcorr.functions import text as X

NBSP = chr(160)
SPACES = [chr(c) for c in range(0x110000) if chr(c).isspace()]


def words(text):
    return ["".join(run) for space, run in groupby(text, str.isspace) if not space]


def cleaned(text):
    """All steps, word by word, without regular expressions."""
    text = "&".join(text.split("&amp;"))
    text = "".join(c for c in text if c != NBSP)
    kept = ""
    while text:
        at = text.find("http")
        if at < 0:
            kept, text = kept + text, ""
            continue
        kept, text = kept + text[:at], text[at + 4 :]
        run = 0
        while run < len(text) and not text[run].isspace():
            run += 1
        if run == 0:
            kept += "http"
        text = text[run:]
    return " ".join(words(kept))


def run(spark, function, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    out = rows.select("i", function(F.col("t")).alias("t")).collect()
    return [r["t"] for r in sorted(out, key=lambda r: r["i"])]


def test_there_are_29_space_code_points():
    assert len(SPACES) == 29


def test_squeeze_knows_every_unicode_space_and_nothing_else(spark):
    texts = [f"a{c}{c}b{c}" for c in SPACES] + ["a​b", "a᠎b"]
    assert run(spark, X.squeeze_space, texts) == ["a b"] * 29 + ["a​b", "a᠎b"]


def test_space_class_over_all_code_points(spark):
    codes = spark.range(1, 0x10000).filter("id NOT BETWEEN 55296 AND 57343")
    text = F.concat(F.lit("a"), F.expr("char_from_code"), F.lit("b"))
    chars = codes.select(
        "id", F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("char_from_code")
    )
    found = chars.filter(X.squeeze_space(text) == "a b").select("id").collect()
    assert sorted(r["id"] for r in found) == [ord(c) for c in SPACES]


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("a &amp; b", "a & b"),
        ("&amp;amp;", "&amp;"),
        (f"a{NBSP}b", "ab"),
        (f"x http://t.co/{NBSP}y z", "x z"),
        ("seehttps://t.co/x,y z", "see z"),
        ("HTTP://X", "HTTP://X"),
        ("http", "http"),
        ("a http b", "a http b"),
        ("http://only.url", ""),
        ("http://a http://b", ""),
        ("", ""),
        ("  a \n\n b\t", "a b"),
        (None, None),
    ],
)
def test_normalize_text(spark, text, wanted):
    assert run(spark, X.normalize_text, [text]) == [wanted]
    if text is not None:
        assert cleaned(text) == wanted


def test_normalize_text_off(spark):
    texts = ["a  &amp; http://x", None]
    assert run(spark, lambda c: X.normalize_text(c, enabled=False), texts) == texts


pieces = st.one_of(
    st.sampled_from(["&amp;", "&", "amp;", "http", "https://t.co/x", "://", "HTTP", "a", "é", "😀"]),
    st.sampled_from(SPACES),
)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(pieces, max_size=12).map("".join), min_size=150, max_size=200))
def test_normalize_text_equals_plain_python(spark, texts):
    assert run(spark, X.normalize_text, texts) == [cleaned(t) for t in texts]


def test_no_python_in_the_plan(spark, plan):
    rows = spark.createDataFrame([("a",)], "t string")
    assert "Python" not in plan(rows.select(X.normalize_text(F.col("t"))))
