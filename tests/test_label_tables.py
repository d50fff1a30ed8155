import pytest
from pyspark.sql import functions as F

from labelcorr.functions.labels import POLITICAL_BIAS
from labelcorr.operators import label_tables as T
from labelcorr.plans import multilabel as ML
from labelcorr.sources import positions

ROWS = [("bias", "l", 0, "Left"), ("bias", "r", 1, "Right"), ("bias", None, 0, "Left"), ("other", "l", 5, "L")]


@pytest.fixture
def labels(spark):
    return spark.createDataFrame(ROWS, "axis string, raw string, code int, name string")


@pytest.mark.parametrize("most", [100, 0])
def test_codes_from_a_table(spark, labels, plan, monkeypatch, most):
    monkeypatch.setattr(T, "MAX_BROADCAST_LABELS", most)
    df = spark.createDataFrame([(1, "l"), (2, "r"), (3, None), (4, "x")], "id int, raw string")
    found = T.encode_by_table(df, "raw", labels, "bias", default=9, name_col="said")
    got = sorted(tuple(r) for r in found.select("id", "code", F.coalesce("said", F.lit("-"))).collect())
    assert got == [(1, 0, "Left"), (2, 1, "Right"), (3, 0, "Left"), (4, 9, "-")]
    assert ("BroadcastHashJoin" in plan(found)) == (most > 0)
    strict = T.encode_by_table(df, "raw", labels, "bias")
    assert strict.filter("id < 4").select("code").count() == 3
    with pytest.raises(Exception, match="not a bias label: x"):
        strict.select("code").collect()


def test_repeated_raw_values_are_refused(spark, labels):
    with pytest.raises(ValueError, match="more than one row: l"):
        T.encode_by_table(labels, "raw", labels)
    assert T.encode_by_table(labels.limit(0), "raw", labels, "other").count() == 0


def test_an_axis_from_a_table(spark, labels):
    axis = T.read_axis(labels, "bias")
    assert axis.names == ("Left", "Right") and axis.codes == {"l": 0, None: 0, "r": 1}
    back = T.read_axis(POLITICAL_BIAS.dim(spark), "political_bias")
    assert dict(back.codes) == dict(POLITICAL_BIAS.codes) and back.names == POLITICAL_BIAS.names
    for name in ("other", "none"):
        with pytest.raises(ValueError, match="not 0 to n - 1"):
            T.read_axis(labels, name)
    two = labels.unionByName(spark.createDataFrame([("bias", "q", 0, "L")], labels.schema))
    with pytest.raises(ValueError, match="several names"):
        T.read_axis(two, "bias")


def numbered(spark, path):
    return [tuple(r) for r in positions.read_numbered(spark, path).orderBy("id").collect()]


def test_rows_are_numbered_by_file_and_place(spark, tmp_path):
    df = spark.range(0, 95, 1, 4).selectExpr("id * 7 % 95 AS x")
    df.write.option("maxRecordsPerFile", 10).parquet(str(tmp_path / "a"))
    got = numbered(spark, str(tmp_path / "a"))
    files = sorted((tmp_path / "a").glob("part-*"))
    assert len(files) > 8
    wanted = [r["x"] for f in files for r in spark.read.parquet(str(f)).collect()]
    assert got == list(enumerate(wanted))


def test_tables_side_by_side(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(50).selectExpr("id AS x").coalesce(1).write.option("maxRecordsPerFile", 7).parquet(a)
    spark.range(50).selectExpr("id * 2 AS y").coalesce(1).write.option("maxRecordsPerFile", 20).parquet(b)
    both = positions.join_by_position(spark, a, b)
    assert both.columns == ["id", "x", "y"]
    assert sorted(tuple(r) for r in both.collect()) == [(i, i, 2 * i) for i in range(50)]
    with pytest.raises(ValueError, match="both tables have x"):
        positions.join_by_position(spark, a, a)
    spark.range(1).selectExpr("id AS y").write.mode("append").parquet(b)
    with pytest.raises(ValueError, match="50 rows.*51"):
        positions.join_by_position(spark, a, b)


def test_several_labels_per_post(spark):
    words = ["red", "green", "blue"]
    rows = []
    for i in range(120):
        own = [k for k in range(3) if i >> k & 1]
        rows.append((" ".join(words[k] for k in own) + " filler", [*own, 3]))
    df = spark.createDataFrame([*rows, ("filler", None)], "content string, labels array<int>")
    settings = ML.Settings(features=1 << 8, reg=0.001)
    model = ML.train_multi_label(df.limit(120), 5, settings)
    assert model.labels[3:] == (True, False)
    found = ML.predict_multi_label(df, model).collect()
    assert all(r["predicted"] == sorted(r["labels"] or [3]) for r in found)
    counters = ML.label_counters(ML.predict_multi_label(df, model), 5)
    by_label = {r["label"]: tuple(r)[1:] for r in counters.collect()}
    assert by_label[3] == (120, 1, 0) and by_label[4] == (0, 0, 0) and by_label[0] == (60, 0, 0)
    score = ML.multi_label_scores(counters).first()
    both = sum(c[0] for c in by_label.values())
    assert score["recall"] == 1.0 and score["micro_f1"] == pytest.approx(2 * both / (2 * both + 1))
    with pytest.raises(ValueError, match="outside 0 to 1"):
        ML.train_multi_label(df, 2, settings)


def test_counters_of_odd_arrays(spark):
    rows = [([0, 0], [0]), (None, [1]), ([1], None), ([], [])]
    df = spark.createDataFrame(rows, "labels array<int>, predicted array<int>")
    got = {r["label"]: tuple(r)[1:] for r in ML.label_counters(df, 2).collect()}
    assert got == {0: (1, 0, 0), 1: (0, 1, 1)}
    none = ML.multi_label_scores(ML.label_counters(df.limit(0), 2)).first()
    assert none["micro_f1"] is None
    sets = df.select(ML.label_sets([F.lit(2), F.lit(None).cast("int"), F.lit(2), F.lit(0)])).first()[0]
    assert sets == [2, 0]
