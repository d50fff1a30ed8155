import json
import time

import pytest
from pyspark.sql import functions as F

from labelcorr.functions.hashing import in_sample
from labelcorr.functions.labels import encode_political_bias
from labelcorr.functions.text import normalize_text
from labelcorr.operators import matrix as M
from labelcorr.operators import quality as Q
from labelcorr.operators.splits import mark_split
from labelcorr.plans import catalog, classify
from labelcorr.sources import posts as P
from labelcorr.sources import replay, sinks
from labelcorr.streaming import job

CATEGORIES = ["LeftTroll", "NewsFeed", "RightTroll", "Elsewhere", None]


def by_length(rows):
    """Logits from the text alone: its length modulo 3 wins."""
    best = F.length("content") % 3
    logits = [F.when(best == c, 1.0).otherwise(0.0) for c in range(3)]
    return rows.withColumn("logits", F.array(*logits))


@pytest.fixture
def lines():
    good = [
        json.dumps({"content": f"post  {'x' * (i % 7)} {i}", "account_category": CATEGORIES[i % 5]})
        for i in range(200)
    ]
    no_text = json.dumps({"content": None, "account_category": "LeftTroll"})
    return [*good, "1,foo,bar", "", "not json", '{"other": 1}', no_text]


def start(spark, tmp_path, lines, **options):
    feed = tmp_path / "feed"
    if not feed.exists():
        feed.mkdir()
        for i in range(0, len(lines), 60):
            (feed / f"part{i:04d}.txt").write_text("\n".join(lines[i : i + 60]) + "\n")
    run = job.run_stream(
        P.replay_stream(spark, str(feed), max_files=1),
        options.pop("score", by_length),
        str(tmp_path / "counts"),
        str(tmp_path / "checkpoint"),
        trigger={"availableNow": True},
        **options,
    )
    run.awaitTermination()
    return str(tmp_path / "counts")


def batch_result(spark, lines):
    """The same computation on all lines at once."""
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    parsed = df.select(F.from_json("value", P.POST_SCHEMA).alias("d")).select("d.*")
    test = parsed.filter("content IS NOT NULL").filter(
        ~in_sample(F.col("content"), F.col("account_category"), fraction=0.8)
    )
    cleaned = test.select(
        normalize_text(F.col("content")).alias("content"),
        encode_political_bias(F.col("account_category"), strict=False).alias("truth"),
    )
    return Q.score_counts(by_length(cleaned))


def test_stream_equals_batch(spark, tmp_path, lines):
    path = start(spark, tmp_path, lines)
    counts = batch_result(spark, lines)
    wanted = M.conditional_distribution(M.dense_matrix(counts, range(3), range(3)))
    got = job.stream_matrix(spark, path, range(3), range(3))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    total = job.stream_total(spark, path, [1.0, 2.0, 3.0]).first()
    scores = Q.evaluate(counts, [1.0, 2.0, 3.0]).first()
    assert tuple(total)[:4] == pytest.approx(tuple(scores))
    # Two lines that are no JSON; an empty line, an object without the fields, a post without a text.
    assert (total["corrupt"], total["no_text"]) == (2, 3)
    assert total["examples"] > 10


def test_batches_and_restart(spark, tmp_path, lines):
    path = start(spark, tmp_path, lines)
    metrics = job.stream_metrics(spark, path).collect()
    assert len(metrics) == 4
    total = job.stream_total(spark, path).first()
    assert sum(m["examples"] for m in metrics) == total["examples"]
    one = job.stream_matrix(spark, path, range(3), range(3), batch_id=1)
    assert one.agg(F.sum("n")).first()[0] == [m["examples"] for m in metrics if m["batch_id"] == 1][0]
    assert sum(r["corrupt"] for r in job.stream_corrupt(spark, path).collect()) == total["corrupt"]
    start(spark, tmp_path, lines)
    assert tuple(job.stream_total(spark, path).first()) == tuple(total)


def test_predictions_of_the_test_posts(spark, tmp_path, lines):
    out = str(tmp_path / "predictions")
    path = start(spark, tmp_path, lines, predictions_path=out, name="with_predictions")
    rows = spark.read.option("header", True).csv(out)
    assert set(rows.columns) == {"ids", "political_bias", "batch_id"}
    assert rows.count() == job.stream_total(spark, path).first()["examples"]
    assert rows.select("batch_id", "ids").distinct().count() == rows.count()


def test_an_empty_stream_gives_zeros(spark, tmp_path):
    path = str(tmp_path / "nothing")
    assert [r["n"] for r in job.stream_matrix(spark, path, range(2), range(2)).collect()] == [0] * 4
    assert job.stream_total(spark, path).first()["examples"] == 0
    assert job.stream_metrics(spark, path).count() == 0


def test_a_new_checkpoint_overwrites_nothing(spark, tmp_path, lines):
    path = start(spark, tmp_path, lines)
    before = tuple(job.stream_total(spark, path).first())
    (tmp_path / "checkpoint").rename(tmp_path / "elsewhere")
    with pytest.raises(ValueError, match="another checkpoint"):
        start(spark, tmp_path, lines)
    assert tuple(job.stream_total(spark, path).first()) == before


def test_compacted_results_are_the_same(spark, tmp_path, lines):
    path = start(spark, tmp_path, lines)
    before = sorted(map(tuple, job.stream_metrics(spark, path).collect()))
    assert job.compact_stream(spark, path) == 3
    assert sorted(map(tuple, job.stream_metrics(spark, path).collect())) == before


def test_registered_stream_runs_in_batches(spark):
    path = catalog._run_events(spark, "/root/testdata/sf0.001")
    assert job.stream_counts(spark, path).select("batch_id").distinct().count() >= 3


def test_strict_stream_counts_unreadable_lines(spark, tmp_path):
    good = [json.dumps({"content": f"t{i}", "account_category": "LeftTroll"}) for i in range(50)]
    settings = job.StreamSettings(default=None, train_fraction=0.0)
    path = start(spark, tmp_path, good + ["garbage"], settings=settings)
    total = job.stream_total(spark, path).first()
    assert (total["examples"], total["corrupt"]) == (50, 1)


def test_model_on_the_stream(spark, tmp_path, lines):
    rows = [(f"x{i % 3} word{i % 3}", i % 3) for i in range(60)]
    train = spark.createDataFrame(rows, "content string, label int")
    model = classify.train_classifier(train, [0, 1, 2], classify.Settings(features=64, max_iter=5))
    path = start(spark, tmp_path, lines, score=lambda posts: job.stream_predict(posts, model, 3))
    total = job.stream_total(spark, path).first()
    assert total["examples"] > 10 and total["loss"] is not None


def test_stream_parse_types(spark):
    values = ['{"content": "x", "account_category": "y"}', "1,foo", '{"content": 5}', None, "{}",
              '{"content": null, "account_category": "y"}']
    df = spark.createDataFrame([(v,) for v in values], "value string")
    assert [tuple(r) for r in job.stream_parse(df).collect()] == [
        ("x", "y", False, False),
        (None, None, True, False),
        ("5", None, False, False),
        (None, None, False, True),
        (None, None, False, True),
        (None, "y", False, True),
    ]


def test_a_line_is_parsed_once(spark, plan):
    df = spark.createDataFrame([("{}",)], "value string")
    rows = job.tested(job.stream_posts(df)).filter("label = 1")
    physical = plan(rows).split("== Physical Plan ==")[1]
    assert physical.count("from_json(") == 1


def test_copies_stay_on_one_side(spark):
    df = spark.createDataFrame([("a", "b")] * 20 + [("c", "d")] * 20, "content string, k string")
    sides = mark_split(df, "content", "k", fraction=0.5).distinct()
    assert sides.count() == 2


def test_replay_writes_limited_files(spark, tmp_path):
    path = str(tmp_path / "replay")
    rows = [(f"t{i}", "LeftTroll", i) for i in range(25)]
    df = spark.createDataFrame(rows, "content string, account_category string, x int")
    P.write_replay(df.coalesce(1), path, rows_per_file=10)
    lines = spark.read.text(path)
    assert len(list((tmp_path / "replay").glob("part-*"))) == 3
    assert json.loads(lines.first()["value"]).keys() == {"content", "account_category"}
    assert P.replay_stream(spark, path).isStreaming


def test_copies_count_once_across_batches_and_restarts(spark, tmp_path):
    text = lambda i, k: json.dumps({"content": f"post {i}", "account_category": k})
    first = [text(i % 10, "LeftTroll") for i in range(40)] + ["bad", "bad"]
    settings = job.StreamSettings(train_fraction=0.0, distinct_within="1 day")
    path = start(spark, tmp_path, first, settings=settings)
    total = lambda: job.stream_total(spark, path).first()
    assert (total()["examples"], total()["corrupt"]) == (10, 2)
    more = [text(3, "LeftTroll"), text(3, "RightTroll"), text(11, "NewsFeed"), text(11, "NewsFeed"), "bad"]
    (tmp_path / "feed" / "zz1.txt").write_text("\n".join(more) + "\n")
    (tmp_path / "feed" / "zz2.txt").write_text("\n".join(more) + "\n")
    start(spark, tmp_path, [], settings=settings)
    assert (total()["examples"], total()["corrupt"]) == (12, 4)


def test_running_matrix_equals_the_batch_after_each_run(spark, tmp_path, lines):
    (tmp_path / "feed").mkdir()
    written, path = [], str(tmp_path / "matrix")
    for n, part in enumerate((lines[:90], lines[90:], [])):
        for i in range(0, len(part), 30):
            (tmp_path / "feed" / f"{n}-{i:03d}.txt").write_text("\n".join(part[i : i + 30]) + "\n")
        run = job.run_matrix(
            P.replay_stream(spark, str(tmp_path / "feed")), by_length, path,
            str(tmp_path / "checkpoint"), trigger={"availableNow": True},
        )
        run.awaitTermination()
        written += part
        wanted = M.dense_matrix(batch_result(spark, written), range(3), range(3))
        got = job.running_matrix(spark, path, range(3), range(3))
        assert sorted(map(tuple, got.collect())) == sorted(
            map(tuple, M.conditional_distribution(wanted).collect())
        )
    # Only the last result is kept, however many batches there were.
    assert len(list((tmp_path / "matrix" / "batches").glob("batch_id=*"))) == 1
    with pytest.raises(ValueError, match="distinct"):
        job.run_matrix(None, by_length, path, path, job.StreamSettings(distinct_within="1 hour"))


def test_an_empty_running_matrix(spark, tmp_path):
    found = job.running_matrix(spark, str(tmp_path / "none"), range(2), range(2))
    assert [r["n"] for r in found.collect()] == [0] * 4


@pytest.mark.parametrize("with_predictions", [False, True])
def test_observed_metrics_equal_the_counts(spark, tmp_path, lines, with_predictions):
    weights = [1.0, 2.0, 3.0]
    extra = {"predictions_path": str(tmp_path / "out")} if with_predictions else {}
    for part in (lines[:130], None):
        seen = job.BatchMetrics(spark, str(tmp_path / "metrics"), weights)
        if part is None:
            (tmp_path / "feed" / "later.txt").write_text("\n".join(lines[130:]) + "\n")
        feed = tmp_path / "feed"
        if not feed.exists():
            feed.mkdir()
            for i in range(0, len(part), 60):
                (feed / f"part{i:04d}.txt").write_text("\n".join(part[i : i + 60]) + "\n")
        run = job.run_stream(
            P.replay_stream(spark, str(feed)), by_length, str(tmp_path / "counts"),
            str(tmp_path / "checkpoint"), trigger={"availableNow": True}, metrics=seen, **extra,
        )
        run.awaitTermination()
        seen.wait(run)
        got = job.BatchMetrics.stored(spark, str(tmp_path / "metrics")).orderBy("batch_id").collect()
        wanted = job.stream_metrics(spark, str(tmp_path / "counts"), weights).orderBy("batch_id").collect()
        assert [r["batch_id"] for r in got] == [r["batch_id"] for r in wanted]
        for a, b in zip(got, wanted):
            assert a["examples"] == b["examples"] and a["accuracy"] == pytest.approx(b["accuracy"])
            assert a["loss"] == pytest.approx(b["loss"])
    lost = job.stream_total(spark, str(tmp_path / "counts")).first()
    assert sum(r["corrupt"] for r in got) == lost["corrupt"] == 2
    assert sum(r["no_text"] for r in got) == lost["no_text"]


def replayed(spark, tmp_path, rows_per_trigger, upto=None):
    lines = replay.replay_at_pace(spark, str(tmp_path / "table"), rows_per_trigger, rows_per_task=4)
    write = lambda batch, n: sinks.write_batch(batch, str(tmp_path / "lines"), n)
    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c"))
    run = writer.trigger(processingTime="0 seconds").start()
    while upto and run.isActive and (run.lastProgress or {"batchId": 0})["batchId"] < upto:
        time.sleep(0.05)
    if not upto:
        run.processAllAvailable()
    run.stop()
    rows = sinks.read_batches(spark, str(tmp_path / "lines"), "value string").collect()
    return {b: [json.loads(r["value"])["content"] for r in rows if r["batch_id"] == b]
            for b in {r["batch_id"] for r in rows}}


def test_replay_keeps_its_pace_and_resumes(spark, tmp_path):
    rows = [(f"t{i:03d}", "LeftTroll") for i in range(47)]
    df = spark.createDataFrame(rows, "content string, account_category string").repartition(3)
    replay.write_replay_table(df, str(tmp_path / "table"), rows_per_file=10)
    first = replayed(spark, tmp_path, 5, upto=2)
    whole = replayed(spark, tmp_path, 5)
    assert all(whole[b] == texts for b, texts in first.items())
    assert sorted(t for texts in whole.values() for t in texts) == [t for t, _ in rows]
    assert [len(whole[b]) for b in sorted(whole)] == [5] * 9 + [2]
    with pytest.raises(ValueError):
        replay.replay_at_pace(spark, str(tmp_path / "table"), rows_per_trigger=0)
