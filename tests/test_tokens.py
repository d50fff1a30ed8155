import pytest
from pyspark.sql import functions as F

from labelcorr.functions import tokens as K
from labelcorr.operators import vocabulary as V


@pytest.fixture(scope="module")
def lengths(spark):
    rows = [(n, [f"t{i}" for i in range(n)]) for n in (0, 1, 61, 62, 63, 64, 65, 200)]
    return spark.createDataFrame(rows, "n int, tokens array<string>")


def test_tokenize(spark):
    texts = ["Hello, World!", " a--b ", "", None, "é1", "..."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["x"] for r in rows.select(K.tokenize(F.col("t")).alias("x")).collect()]
    assert got == [["hello", "world"], ["a", "b"], [], None, ["1"], []]


def test_tokenize_with_another_pattern(spark):
    rows = spark.createDataFrame([("a_b c",)], "t string")
    assert rows.select(K.tokenize(F.col("t"), r"\s+").alias("x")).first()["x"] == ["a_b", "c"]


def test_pad_truncate_mask_types(lengths):
    out = lengths.select(
        "n",
        K.pad_truncate(F.col("tokens"), F.lit(K.PAD)).alias("padded"),
        K.attention_mask(F.col("tokens")).alias("mask"),
        K.token_type_ids().alias("types"),
    ).collect()
    for row in out:
        kept = min(row["n"], 64)
        assert row["padded"] == [f"t{i}" for i in range(kept)] + ["[PAD]"] * (64 - kept)
        assert row["mask"] == [1] * kept + [0] * (64 - kept)
        assert row["types"] == [0] * 64


def test_special_tokens(lengths):
    for row in lengths.select("n", K.add_special_tokens(F.col("tokens")).alias("t")).collect():
        kept = min(row["n"], 62)
        assert row["t"] == ["[CLS]", *[f"t{i}" for i in range(kept)], "[SEP]"]


def test_max_tokens(spark, lengths):
    assert V.max_tokens(lengths).first()["max_tokens"] == 200
    assert V.max_tokens(lengths.limit(0)).first()["max_tokens"] == 0


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "b a a".split()), (2, "c a b".split()), (3, []), (4, None), (5, ["z"])]
    return spark.createDataFrame(rows, "id int, tokens array<string>").repartition(3)


def test_vocabulary_order_and_ties(docs):
    rows = V.build_vocabulary(docs, 3).collect()
    assert [tuple(r) for r in sorted(rows, key=lambda r: r["token_id"])] == [
        ("a", 3, 0),
        ("b", 2, 1),
        ("c", 1, 2),
    ]


def test_vocabulary_with_markers(docs):
    rows = V.build_vocabulary(docs, 2, markers=("[PAD]", "b")).collect()
    assert {r["token"]: r["token_id"] for r in rows} == {"[PAD]": 0, "b": 1, "a": 2, "c": 3}


@pytest.mark.parametrize("max_broadcast", [10, 3, 2, 1, 0])
def test_encode_tokens(docs, max_broadcast):
    vocabulary = V.build_vocabulary(docs, 3)
    out = V.encode_tokens(docs, vocabulary, -1, max_broadcast=max_broadcast)
    assert out.columns == ["id", "tokens", "token_ids"]
    got = {r["id"]: r["token_ids"] for r in out.collect()}
    assert got == {1: [1, 0, 0], 2: [2, 0, 1], 3: [], 4: None, 5: [-1]}


@pytest.mark.parametrize("max_broadcast", [10, 2, 0])
def test_encode_tokens_with_nulls_and_equal_keys(spark, docs, max_broadcast):
    vocabulary = V.build_vocabulary(docs, 3)
    rows = [(1, ["a", None, "b"]), (1, ["c"]), (None, ["a"]), (None, None), (2, []), (2, [None, "q"])]
    odd = spark.createDataFrame(rows, "id int, tokens array<string>").repartition(2)
    out = V.encode_tokens(odd, vocabulary, -1, max_broadcast=max_broadcast)
    got = sorted((r["id"] or 0, r["token_ids"] is None, r["token_ids"] or []) for r in out.collect())
    assert got == [
        (0, False, [0]), (0, True, []), (1, False, [0, -1, 1]), (1, False, [2]), (2, False, []),
        (2, False, [-1, -1]),
    ]


def test_a_row_joins_a_token_once(spark):
    rows = spark.createDataFrame([(["a"] * 9 + ["b"] * 4 + ["q", None] * 3,)], "tokens array<string>")
    vocabulary = V.build_vocabulary(rows.selectExpr("slice(tokens, 1, 13) AS tokens"), 2)
    lookup = V._left_open(spark, vocabulary.orderBy("token_id").limit(1).toArrow(), -1)
    coded = rows.select(lookup("tokens").alias("c")).first()["c"]
    assert coded["open"] == ["b", "q"]
    assert coded["ids"] == [0] * 9 + [V.OPEN] * 4 + [V.OPEN + 1, -1] * 3


def test_lookups_take_batches_bounded_in_bytes(spark, tmp_path):
    folder = str(tmp_path / "tokens")
    words = F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda i: F.concat(F.lit("w"), i % 40))
    spark.range(2000, numPartitions=1).select("id", words.alias("tokens")).write.parquet(folder)
    rows = spark.read.parquet(folder)
    vocabulary = V.build_vocabulary(rows, 30)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    for shipped in (100, 5):
        found = V.encode_tokens(rows, vocabulary, -1, max_broadcast=shipped)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 1 << 24
        told = F.aggregate("token_ids", F.lit(0), lambda a, x: a + x)
        ids = {r["token"]: r["token_id"] for r in vocabulary.collect()}
        wanted = 25 * sum(ids.get(f"w{i}", -1) for i in range(40))
        assert [tuple(r) for r in found.groupBy(told).count().collect()] == [(wanted, 2000)]


def test_words_are_cut_once_per_scan(spark, plan):
    rows = spark.createDataFrame([(1, "a b")], "id int, t string")
    tokens = rows.select("id", K.tokenize(F.col("t")).alias("tokens"))
    vocabulary = V.build_vocabulary(tokens, 5)
    assert "size(" not in plan(vocabulary)
    vocabulary.collect()
    assert "ReusedExchange" in plan(vocabulary)


def test_batch_tokenize(spark):
    rows = spark.createDataFrame([(1, "B a a"), (2, ""), (3, "x " * 100)], "id int, t string")
    tokens = rows.select(K.tokenize(F.col("t")).alias("tokens")).filter("size(tokens) < 10")
    markers = (K.PAD, K.UNK, K.CLS, K.SEP)
    vocabulary = V.build_vocabulary(tokens, 10, markers=markers)
    out = V.batch_tokenize(rows, vocabulary, "t", unknown_id=1, pad_id=0)
    got = {r["id"]: r for r in out.collect()}
    assert got[1]["input_ids"] == [2, 5, 4, 4, 3] + [0] * 59
    assert got[1]["attention_mask"] == [1] * 5 + [0] * 59
    assert got[2]["input_ids"] == [2, 3] + [0] * 62
    assert got[3]["input_ids"] == [2] + [1] * 62 + [3]
    assert got[3]["token_type_ids"] == [0] * 64
