"""From CSV folders to a matrix, the way the README shows it."""

import csv

import numpy as np
import pytest

from labelcorr.functions.labels import POLITICAL_BIAS, SENTIMENT
from labelcorr.operators import counts as C
from labelcorr.operators.quality import prediction_table
from labelcorr.operators.splits import holdout_by_file
from labelcorr.plans import classify, jobs
from labelcorr.sources import files, models, posts, sinks

WORDS = {"LeftTroll": "union health care", "Fearmonger": "weather sports", "RightTroll": "flag border"}
MOODS = {"pos": "LeftTroll", "neu": "Fearmonger", "neg": "RightTroll"}


def text(rng, category):
    return " &amp; ".join(rng.choice(WORDS[category].split(), 3)) + "\nhttp://t.co/a"


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    rng = np.random.default_rng(11)
    root = tmp_path_factory.mktemp("data")
    (root / "bias").mkdir()
    (root / "sentiment").mkdir()
    for part in range(3):
        with open(root / "bias" / f"part_{part}.csv", "w", newline="") as out:
            rows = csv.writer(out)
            rows.writerow(["author", "content", "account_category"])
            for i in range(60):
                category = str(rng.choice(list(WORDS), p=[0.3, 0.2, 0.5]))
                rows.writerow([i, None if i == 7 else text(rng, category), category])
    with open(root / "sentiment" / "all.csv", "w", newline="") as out:
        rows = csv.writer(out)
        rows.writerow(["tweet", "label"])
        for i in range(40):
            mood = str(rng.choice(list(MOODS)))
            rows.writerow([text(rng, MOODS[mood]), mood])
    return root


def test_train_transfer_and_store(spark, data, tmp_path):
    raw = posts.read_posts(spark, str(data / "bias"))
    assert sum(r["n"] for r in C.merged_counts(raw, "account_category").collect()) == 180
    train, test = holdout_by_file(raw, k=0)
    ready = jobs.prepare(train, POLITICAL_BIAS)
    assert ready.count() == 118
    choice = jobs.train_and_evaluate(
        ready,
        jobs.prepare(test, POLITICAL_BIAS),
        POLITICAL_BIAS,
        [classify.Settings(features=256, reg=r, max_iter=10) for r in (0.1, 0.01)],
    )
    assert choice.scores(spark).count() == 2
    assert choice.f1 == 1.0 and choice.candidate == 0 and choice.examples == 59
    path = models.save_model(
        spark, choice.model, str(tmp_path), "political_bias", 0, choice.candidate, choice.f1
    )

    model, about = models.load_model(spark, path)
    assert about["axis"] == "political_bias"
    tweets = posts.read_posts(spark, str(data / "sentiment"), "tweet string, label string")
    given = jobs.prepare(tweets, SENTIMENT, "tweet", "label")
    matrix = jobs.predicted_matrix(given, model, "label", SENTIMENT, POLITICAL_BIAS)
    got = {(r["given_name"], r["pred_name"]): r["p"] for r in matrix.collect()}
    assert got["Positive", "Left"] == got["Neutral", "Other"] == got["Negative", "Right"] == 1.0
    assert sum(got.values()) == pytest.approx(3.0)

    out = str(tmp_path / "predictions")
    scored = classify.predict(posts.read_posts(spark, str(data / "bias")).dropna(subset=["content"]), model)
    numbered = scored.selectExpr("xxhash64(content, file_name) AS id", "logits")
    sinks.write_predictions(prediction_table(numbered, "id"), out)
    assert spark.read.option("header", True).csv(out).count() == 177


def test_files_chosen_before_reading(spark, data):
    found = files.list_files(spark, str(data / "bias"))
    train, test = files.holdout_files(files.select_files(found, first=2), k=0)
    assert posts.read_posts(spark, train).count() == posts.read_posts(spark, test).count() == 60
