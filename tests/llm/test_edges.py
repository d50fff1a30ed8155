"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelcorr.llm import chat, common, exact_dedup, mixing, near_dedup, pieces, quality, secrets, toxicity
from labelcorr.llm import fingerprints as fp
from labelcorr.llm import warc

LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(30_000))
TEXTS = [
    (1, "Some plain words that are here to be read by all of us today"),
    (2, "some PLAIN words that are here to be read by all of us today"),
    (2, "some PLAIN words that are here to be read by all of us today"),
    (3, None),
    (4, ""),
    (None, "a row without an id but with words"),
    (None, None),
    (5, LONG),
    (6, LONG + " end"),
    (7, " \t\n"),
    (8, "É ñ 中 🙂 İ"),
]
SCHEMA = """doc_id long, text string, lang string, source string, n_chars long,
            kept boolean, score double, id long, component long, n long, _row long, rate double"""


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, None, None, True, 0.5, 9, 9, 9, 9, 1.0) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def stored(spark, docs, tmp_path_factory):
    """As Parquet: row numbers of a table in memory and of files both have to hold."""
    path = str(tmp_path_factory.mktemp("docs"))
    docs.coalesce(2).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (3, None, 0), (None, 1, 1), (5, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def none_of(df):
    return df.filter(F.lit(False))


def test_exact_duplicates(stored):
    rows = exact_dedup.exact_duplicates(stored).collect()
    assert len(rows) == len(TEXTS)
    of = lambda i: [r for r in rows if r["id"] == i]
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in of(1)] == [(2, 3, False)]
    assert sorted(r["kept"] for r in of(2)) == [False, True]
    # Null and empty texts are equal; the largest id stays.
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in of(3)] == [(4, 3, False)]
    left = exact_dedup.without_duplicates(stored)
    assert left.columns == stored.columns and left.count() == len(TEXTS) - 4
    assert exact_dedup.exact_duplicates(none_of(stored)).count() == 0
    assert exact_dedup.without_duplicates(none_of(stored)).count() == 0


def test_near_duplicates(stored):
    rows = near_dedup.near_duplicates(stored, shingle=2).collect()
    found = {r["id"]: (r["n_shingles"], r["component"]) for r in rows if r["id"] is not None}
    assert found[1] == found[2] == (13, 1)
    assert found[3] == (0, 3) and found[4] == (0, 4) and found[7] == (0, 7)
    assert found[5][1] == found[6][1] == 5 and found[8] == (4, 8)
    assert [r["component"] for r in rows if r["id"] is None] == [None, None]
    left = near_dedup.without_near_duplicates(stored, shingle=2)
    assert left.columns == stored.columns
    assert sorted(r[0] or 0 for r in left.select("doc_id").collect()) == [0, 0, 1, 3, 4, 5, 7, 8]
    assert near_dedup.near_duplicates(none_of(stored)).count() == 0
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(stored, percent=50)


def test_classifiers(stored, labels):
    for some in (labels, none_of(labels), labels.filter("doc_id = 1")):
        tox = toxicity.fit_toxicity(stored, some)
        rows = toxicity.toxicity_scores(stored, tox).collect()
        assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
        good = quality.fit_rules(stored, some)
        rows = quality.quality_scores(stored, good).collect()
        assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["id"] in (3, 4)}) == 1
    assert toxicity.toxicity_scores(none_of(stored), tox).count() == 0
    assert toxicity.fit_toxicity(none_of(stored), labels).trees is None
    assert toxicity.without_toxic(stored, tox).columns == stored.columns


def test_secrets(stored):
    rows = secrets.secrets(stored).collect()
    assert len(rows) == len(TEXTS) and all(r["base"] == [] for r in rows)
    assert secrets.secrets(none_of(stored)).count() == 0


def test_fingerprints(stored):
    rows = fp.fingerprints(stored, rows_per_run=2).collect()
    assert len(rows) == len(TEXTS)
    assert sorted(r["n_chars"] for r in rows) == sorted(len(t or "") for _, t in TEXTS)
    same = {r["fingerprint"] for r in rows if r["id"] in (3, 4)}
    assert len(same) == 1 and same.pop().endswith(":")
    assert fp.fingerprints(none_of(stored)).count() == 0
    one = fp.fingerprints(stored.filter("doc_id = 8")).first()
    assert one["near_next"] == 1.0


def test_archives(spark, stored):
    pages = stored.withColumnRenamed("text", "html").withColumn("url", F.lit("http://x/\r\na"))
    pages = pages.withColumn("url", F.when(F.col("doc_id") != 8, F.col("url")))
    root = warc.archive_folder(pages)
    index = warc.write_archives(pages, root, id_col="doc_id")
    rows = warc.read_archives(index, root).collect()
    assert len(rows) == len(TEXTS) == index.count()
    texts = sorted((r["id"] or 0, bytes(r["payload"]).decode()) for r in rows)
    assert texts == sorted((i or 0, t or "") for i, t in TEXTS)
    assert {r["url"] for r in rows} == {None, "http://x/%0D%0Aa"}
    empty = warc.write_archives(none_of(pages), root, id_col="doc_id")
    assert warc.read_archives(empty, root).count() == 0


def test_pieces(stored):
    rows = pieces.round_trips(stored).collect()
    assert len(rows) == len(TEXTS) and all(r["round_trip"] for r in rows)
    assert all(r["ids"] == [] for r in rows if r["id"] in (3, 4))
    back = pieces.decoded(pieces.encoded(stored)).collect()
    assert sorted(r["text"] for r in back) == sorted(t or "" for _, t in TEXTS)
    assert pieces.round_trips(none_of(stored)).count() == 0


def test_mixing(stored, labels):
    for some in (labels, none_of(labels)):
        told = mixing.domain_labels(some)
        rows = mixing.document_rates(stored, told, (0.8, 0.1, 0.1)).collect()
        assert len(rows) == len(TEXTS) and all(r["rate"] >= 0 for r in rows)
        assert {r["tokens"] for r in rows if r["id"] in (3, 4)} == {0}
        kept = mixing.mixed(stored, told, (0.8, 0.1, 0.1))
        assert kept.columns == [*stored.columns, "copies"]
        assert kept.count() == stored.count() and kept.filter("copies < 1 OR copies > 4").count() == 0
    assert mixing.document_rates(none_of(stored), told, (1, 1, 1)).count() == 0


def test_chat(spark):
    schema = "pair_id long, turn long, role string, text string, part string"
    chosen = spark.createDataFrame(
        [(1, 0, "user", "q", "x"), (1, 0, "user", "q", "x"), (1, 1, "assistant", "good", "x"),
         (None, None, None, None, None), (3, 0, "user", "only", "x")],
        schema,
    )
    rejected = spark.createDataFrame(
        [(1, 0, "user", "q", "x"), (1, 1, "assistant", "bad", "x"), (1, 2, "user", "more", "x"),
         (None, None, None, None, None)],
        schema,
    )
    rows = chat.preference_turns(chosen, rejected).collect()
    got = sorted((r["pair_id"] or 0, r["part"], r["turn"] or 0, r["trained"]) for r in rows)
    assert got == [
        (0, "prompt", 0, False),
        (1, "chosen", 1, True),
        (1, "prompt", 0, False),
        (1, "rejected", 1, True),
        (1, "rejected", 2, False),
        (3, "chosen", 0, False),
    ]
    for r in rows:
        message = r["rendered"][r["loss_start"] : r["loss_end"]]
        assert message == ({"chosen": "good", "rejected": "bad"}[r["part"]] if r["trained"] else "")
    assert chat.preference_turns(none_of(chosen), none_of(rejected)).count() == 0
    assert chat.stale_answers(none_of(chosen.withColumnRenamed("pair_id", "conv_id"))).count() == 0


def test_pipeline_of_odd_rows(spark, stored, labels, tmp_path):
    sf_dir = str(tmp_path)
    stored.write.parquet(f"{sf_dir}/documents.parquet")
    labels.write.parquet(f"{sf_dir}/labels.parquet")
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} >= {5, 8} and all(r["round_trip"] for r in rows)
    empty = f"{sf_dir}/empty"
    none_of(stored).write.parquet(f"{empty}/documents.parquet")
    none_of(labels).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_batches_and_what_is_kept_of_them_are_small(spark):
    rows = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    found = [r["n"] for r in common.arrow_rows(rows, sizes, "n long").collect()]
    assert sum(found) > 30_000_000 and max(found) <= 5_000_000


def test_terms_are_handed_on_by_group(spark):
    texts = ["Toxic words", "plain words", None, ""]
    rows = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts * 40)], "doc_id long, text string, _label int")
    lexicons = toxicity.learnt_lexicons(rows.withColumn("_label", (F.lower("text").contains("toxic")).cast("int")).na.fill(0), "doc_id", "text")
    assert len(lexicons) == 1 + toxicity.PARTS
    assert all(b"=toxic" in x and b"=plain" not in x for x in lexicons)
    counted = toxicity._counted({2: {b"a": 2, b"b": 1}, 5: {b"a": 1}})
    assert counted.to_pydict() == {"term": [b"a", b"b", b"a"], "at": [2, 2, 5], "n": [2, 1, 1]}
