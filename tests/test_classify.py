import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from labelcorr.functions.labels import POLITICAL_BIAS, SENTIMENT
from labelcorr.operators import splits as S
from labelcorr.operators.quality import evaluate, prediction_table, score_counts
from labelcorr.plans import classify, jobs, multilabel
from labelcorr.sources import models

SMALL = classify.Settings(features=256, max_iter=10)
TOPICS = ["health care union", "weather news sports", "border guns flag"]
CATEGORIES = ["LeftTroll", "NewsFeed", "RightTroll"]


@pytest.fixture(scope="module")
def posts(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        c = int(rng.choice(3, p=[0.2, 0.5, 0.3]))
        picked = rng.choice(TOPICS[c].split(), 4).tolist() + rng.choice("a b c d".split(), 2).tolist()
        rows.append((i, "  ".join(picked) + " http://t.co/x", CATEGORIES[c]))
    return spark.createDataFrame(rows, "id long, content string, account_category string")


@pytest.fixture(scope="module")
def prepared(posts):
    return jobs.prepare(posts, POLITICAL_BIAS, keep=["id"])


@pytest.fixture(scope="module")
def model(prepared):
    return classify.train_classifier(prepared, [0, 1, 2], SMALL)


def test_prepare_drops_whole_rows(spark):
    rows = [("a  b", "LeftTroll"), (None, "RightTroll")]
    df = spark.createDataFrame(rows, "content string, account_category string")
    assert [tuple(r) for r in jobs.prepare(df, POLITICAL_BIAS).collect()] == [("a b", 0)]
    raw = jobs.prepare(df, POLITICAL_BIAS, normalize=False)
    assert raw.first()["content"] == "a  b"


def test_predictions_match_the_model(prepared, model):
    scored = classify.predict(prepared, model, 3)
    assert scored.columns == ["content" if c == "content" else c for c in prepared.columns] + ["logits"]
    own = model.transform(prepared).select("id", F.col("_prediction").cast("int").alias("p"))
    both = prediction_table(scored, "id").join(own, F.col("ids") == own["id"])
    assert both.filter("pred <> p").count() == 0 and both.count() == 240


def test_learns_separable_topics(prepared, model):
    scored = classify.predict(prepared, model, 3)
    scores = evaluate(score_counts(scored, "label")).first()
    assert scores["accuracy"] > 0.95


def test_absent_class_cannot_be_weighted(prepared):
    with pytest.raises(Exception, match="no rows of class 3"):
        classify.train_classifier(prepared, [0, 1, 2, 3], SMALL)


def test_missing_top_classes_get_no_chance(prepared, model):
    row = classify.predict(prepared, model, 5).first()
    assert len(row["logits"]) == 5 and row["logits"][3:] == [float("-inf")] * 2


def test_select_best_takes_the_first_of_equals(prepared):
    train, test = S.random_split(prepared, "id")
    candidates = [classify.Settings(features=256, max_iter=0), SMALL, SMALL]
    choice = classify.select_best(train, test, [0, 1, 2], candidates)
    assert choice.candidate == 1
    assert [t["candidate"] for t in choice.tried] == [0, 1, 2]
    assert choice.f1 == choice.accuracy == max(t["f1"] for t in choice.tried)


def test_train_and_evaluate(spark, prepared):
    train, test = S.random_split(prepared, "id")
    choice = jobs.train_and_evaluate(train, test, POLITICAL_BIAS, [SMALL])
    again = evaluate(
        score_counts(classify.predict(test, choice.model, 3), "label"), choice.weights
    ).first()
    row = choice.scores(spark).first()
    assert row["examples"] == again["examples"] == test.count()
    assert row["micro_f1"] == again["micro_f1"] == choice.f1
    assert row["loss"] == pytest.approx(again["loss"])


def test_cross_validation_uses_the_folds(prepared):
    folds = S.stratified_kfold(prepared, "label", "id", folds=3, buckets=16)
    model, scores = classify.cross_validate(folds, [0, 1, 2], [0.01, 100.0], folds=3, settings=SMALL)
    assert len(scores) == 2 and scores[0] >= scores[1]
    assert classify.predict(prepared, model, 3).count() == 240


def test_matrix_of_another_source(spark, model):
    rows = [("union health", "pos"), ("guns", "neg"), ("flag border", "neg"), ("sports", "neu")]
    tweets = spark.createDataFrame(rows, "tweet string, label string")
    given = jobs.prepare(tweets, SENTIMENT, "tweet", "label")
    matrix = jobs.predicted_matrix(given, model, "label", SENTIMENT, POLITICAL_BIAS)
    got = {(r["given_name"], r["pred_name"]): r["p"] for r in matrix.collect()}
    assert len(got) == 9
    assert got["Positive", "Left"] == got["Negative", "Right"] == got["Neutral", "Other"] == 1.0


def test_posts_are_scored_once(prepared, model, plan):
    matrix = jobs.predicted_matrix(prepared, model, "label", POLITICAL_BIAS, POLITICAL_BIAS)
    physical = plan(matrix).split("== Physical Plan ==")[1]
    assert physical.count("trim(") <= 1


def test_a_filter_on_the_prediction_scores_once(spark, prepared, model, plan):
    kept = prediction_table(classify.predict(prepared, model, 3), "id").filter("pred = 1")
    physical = plan(kept).split("== Physical Plan ==")[1]
    assert physical.count("trim(") == 1 and 0 < kept.count() < 240
    rows = spark.range(9).selectExpr("id", "array(double(id), 1D) AS x")
    scored = classify.predict_with(rows, lambda: lambda x: x, ["x"], input_shapes=[[2]])
    kept = prediction_table(scored, "id").filter("pred = 1")
    assert plan(kept).split("== Physical Plan ==")[1].count("EvalPython") == 1
    assert kept.count() == 1


def test_any_scorer(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(5)], "id long, x array<double>")

    def make_scorer():
        return lambda x: x * 10

    scored = classify.predict_with(rows, make_scorer, ["x"], batch_size=2, input_shapes=[[3]])
    got = {r["ids"]: r["pred"] for r in prediction_table(scored, "id").collect()}
    assert got == {0: 2, 1: 2, 2: 0, 3: 0, 4: 0}


def test_save_and_load(spark, tmp_path, prepared, model):
    path = models.save_model(spark, model, str(tmp_path), "political_bias", 0, 5, 0.68149, accuracy=0.7)
    assert path.endswith("/political_bias-fold-0-candidate-5")
    models.save_model(spark, model, str(tmp_path), "political_bias", 1, 2, 0.9)
    back, about = models.load_model(spark, path)
    assert about == {
        "axis": "political_bias", "fold": 0, "candidate": 5, "f1": 0.68149, "loss": None, "accuracy": 0.7
    }
    old = model.transform(prepared).select("id", vector_to_array("_raw").alias("z"))
    new = back.transform(prepared).select("id", vector_to_array("_raw").alias("z"))
    assert old.exceptAll(new).count() == 0
    listed = models.list_models(spark, str(tmp_path)).collect()
    assert [r["f1"] for r in listed] == [0.9, 0.68149]
    assert listed[1]["path"].endswith("political_bias-fold-0-candidate-5")


def test_models_of_two_classes_take_no_session_to_the_tasks(spark):
    rows = spark.createDataFrame([("left", 0), ("right", 1)] * 10, "content string, label int")
    settings = classify.Settings(features=1 << 6)
    one = classify.train_classifier(rows, [0, 1], settings)
    best = classify.select_best(rows, rows, [0, 1], [settings]).model
    arrays = rows.selectExpr("content", "array(label) AS labels")
    several = multilabel.train_multi_label(arrays, 2, settings)
    for model in (one.stages[-1], best.stages[-1], *several.labels):
        data = spark._jvm.java.io.ByteArrayOutputStream()
        spark._jvm.java.io.ObjectOutputStream(data).writeObject(model._java_obj)
        assert b"sql.classic.SparkSession" not in bytes(data.toByteArray())
        assert model.numClasses == 2


def test_cross_validation_keeps_rows_and_session_out_of_python_and_tasks(spark):
    texts = [("union care", 0), ("guns flag", 1)]
    rows = spark.createDataFrame([(*t, i % 2) for i in range(8) for t in texts], "content string, label int, fold int")
    settings = classify.Settings(features=1 << 10)
    model, scores = classify.cross_validate(rows, [0, 1], [0.01, 0.001], 2, settings)
    assert scores == [1.0, 1.0] and not model.stages[-1].hasSummary
    for bad, folds, message in [("NULL", 2, "16 rows are in no fold"), ("0", 1, "fold 0 holds 16 of 16"), ("2", 2, "no fold")]:
        with pytest.raises(ValueError, match=message):
            classify.cross_validate(rows.selectExpr("content", "label", f"int({bad}) AS fold"), [0, 1], [0.01], folds, settings)


def test_steps_of_a_fit_take_few_tasks_whatever_the_partitions(spark, monkeypatch):
    seen = []
    fit = classify.LogisticRegression.fit

    def spied(self, rows, *args):
        seen.append(rows.rdd.getNumPartitions())
        return fit(self, rows, *args)

    monkeypatch.setattr(classify.LogisticRegression, "fit", spied)
    rows = spark.range(0, 600, 1, 96).selectExpr("IF(id % 3 = 0, 'left a', 'right b') AS content", "int(id % 3 = 0) AS label")
    candidates = [classify.Settings(features=1 << 6, reg=r) for r in (0.1, 0.01, 0.001)]
    choice = classify.select_best(rows, rows, [0, 1], candidates)
    assert choice.candidate == 0 and [t["examples"] for t in choice.tried] == [600] * 3
    assert seen == [max(spark.sparkContext.defaultParallelism, 6)] * 3
    # All rows are still in the model, which is that of one fit after another over any partitions.
    again = classify.select_best(rows.coalesce(1), rows, [0, 1], candidates, parallelism=1)
    assert [t["loss"] for t in again.tried] == pytest.approx([t["loss"] for t in choice.tried])
    assert seen[3:] == [1] * 3
