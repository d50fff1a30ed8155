import numpy as np
import pytest
from pyspark.sql import functions as F

from labelcorr.operators import rows as R
from labelcorr.operators import splits as S


def dealt_folds(labels, folds):
    """Deal the class-sorted rows to the folds in turn, then cut each class in runs."""
    first_seen = {}
    for x in labels:
        first_seen.setdefault(x, len(first_seen))
    codes = np.array([first_seen[x] for x in labels])
    by_class = np.sort(codes, kind="stable")
    fold_of_slot = np.arange(len(codes)) % folds
    out = np.empty(len(codes), int)
    for c in range(len(first_seen)):
        out[codes == c] = np.sort(fold_of_slot[by_class == c])
    return out.tolist()


def fold_list(df, **options):
    rows = S.stratified_kfold(df, "label", "id", **options).orderBy("id").collect()
    return [r["fold"] for r in rows]


@pytest.mark.parametrize("n, partitions, buckets", [(97, 1, 4), (110, 4, 16), (123, 16, 1024)])
def test_kfold_equals_restatement(spark, n, partitions, buckets):
    rng = np.random.default_rng(n)
    labels = rng.choice(["neg", "neu", "pos"], size=n, p=[0.2, 0.7, 0.1]).tolist()
    rows = list(zip(range(n), labels))
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(i), str(x)) for i, x in rows], "id long, label string")
    got = fold_list(df.repartition(partitions), buckets=buckets)
    assert got == dealt_folds(labels, 5)


def test_kfold_with_a_rare_class_and_missing_labels(spark):
    labels = ["a"] * 40 + ["b"] * 2 + [None] * 9 + ["c"]
    df = spark.createDataFrame(list(enumerate(labels)), "id long, label string")
    assert fold_list(df, buckets=8) == dealt_folds(labels, 5)


def test_kfold_of_uneven_keys(spark):
    labels = ["a", "b"] * 50
    keys = [i if i < 90 else 10**15 + i * 10**12 for i in range(100)]
    df = spark.createDataFrame(list(zip(keys, labels)), "id long, label string")
    assert fold_list(df, folds=3, buckets=8) == dealt_folds(labels, 3)


def test_kfold_when_nothing_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_BROADCAST_CLASSES", 0)
    labels = ["a", "b", "b"] * 20
    df = spark.createDataFrame(list(enumerate(labels)), "id long, label string")
    assert fold_list(df, buckets=8) == dealt_folds(labels, 5)


def test_kfold_neither_sorts_nor_shuffles_the_rows(spark):
    df = spark.range(100).withColumn("label", F.col("id") % 2)
    text = S.stratified_kfold(df, "label", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in text and "Sort" not in text


def test_last_pass_over_the_keys_is_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(5000).withColumn("label", F.col("id") % 3).write.parquet(path)
    cuts = S.class_cuts(spark.read.parquet(path), "label", "id", 5, 64)
    text = cuts._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id" in text and "ReadSchema: struct<id:bigint,label:bigint>" in text


def test_fold_rows_and_train_counts(spark):
    labels = ["neg"] * 10 + ["neu"] * 25 + ["pos"] * 5
    df = spark.createDataFrame(list(enumerate(labels)), "id long, label string")
    folds = S.stratified_kfold(df, "label", "id", buckets=8)
    assert R.rows_in_fold(folds, 1).count() == 8
    assert R.rows_in_fold(folds, 1, train=True).count() == 32
    rows = S.fold_train_counts(folds, "label", ["neg", "neu", "pos"]).collect()
    assert {(r["fold"], r["label"]): r["n"] for r in rows} == {
        (f, c): n for f in range(5) for c, n in [("neg", 8), ("neu", 20), ("pos", 4)]
    }


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_random_split_does_not_depend_on_layout(spark, partitions):
    df = spark.range(2000).repartition(partitions)
    train, test = S.random_split(df, "id")
    ids = sorted(r["id"] for r in train.collect())
    base = sorted(r["id"] for r in S.random_split(spark.range(2000).coalesce(1), "id")[0].collect())
    assert ids == base
    assert train.count() + test.count() == 2000
    assert train.intersect(test).count() == 0
    assert 0.75 < len(ids) / 2000 < 0.85


def test_random_split_seeds_differ(spark):
    one = S.random_split(spark.range(500), "id", seed=1)[0]
    two = S.random_split(spark.range(500), "id", seed=2)[0]
    assert one.exceptAll(two).count() > 0


def test_rest_is_a_set_difference(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "c")], "k int, v string")
    train = spark.createDataFrame([(3, "c"), (9, "z")], "k int, v string")
    got = S.test_rest(df, train)
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, None)]
    assert sorted(map(tuple, df.subtract(train).collect())) == sorted(map(tuple, got.collect()))


def test_split_rest_equals_subtract(spark):
    df = spark.range(400).withColumn("v", F.col("id") % 60)
    train = S.random_split(df, "id")[0]
    wanted = df.select("v").subtract(train.select("v"))
    got = S.split_rest(df, ["v"], "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_split_rest_folds_copies_before_the_shuffle(spark):
    df = spark.range(10).withColumn("v", F.lit(1))
    text = S.split_rest(df, ["v"], "id")._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in text and "Join" not in text


def test_holdout_by_file(spark):
    rows = [("b", 1), ("a", 1), ("c", 2), ("b", 1), ("a", 3)]
    df = spark.createDataFrame(rows, "file_name string, v int")
    train, test = S.holdout_by_file(df, 1)
    assert sorted(map(tuple, test.collect())) == [("b", 1), ("b", 1)]
    assert sorted(map(tuple, train.collect())) == [("a", 1), ("a", 3), ("c", 2)]
    evaluation = S.holdout_by_file(df, 1, include_train=True)[1]
    assert sorted(map(tuple, evaluation.collect())) == sorted(rows)


def test_holdout_beyond_the_last_file(spark):
    df = spark.createDataFrame([("a", 1)], "file_name string, v int")
    train, test = S.holdout_by_file(df, 4)
    assert (train.count(), test.count()) == (1, 0)


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_row_ids(spark, partitions):
    df = spark.range(300).withColumn("s", F.md5(F.col("id").cast("string"))).repartition(partitions)
    rows = R.add_row_id(df.withColumnRenamed("id", "key"), ["s"]).collect()
    by_text = sorted(rows, key=lambda r: r["s"])
    assert [r["id"] for r in by_text] == list(range(300))


def test_row_ids_of_one_repeated_value(spark):
    df = spark.range(1000).select(F.lit("x").alias("v"), "id").withColumnRenamed("id", "key")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        numbered = R.add_row_id(df.repartition(4), ["v"], unique=False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["id"] for r in numbered.collect()) == list(range(1000))
    # The value is spread over several sorted partitions.
    assert numbered.groupBy(F.spark_partition_id()).count().count() == 4
    assert numbered.columns == ["id", "v", "key"]


def test_row_helpers(spark):
    df = spark.createDataFrame([("t", "a"), (None, "b"), ("u", None)], "tweet string, Stance string")
    rows = R.drop_non_text(R.project(df, "tweet", "Stance"))
    assert [tuple(r) for r in rows.collect()] == [("t", "a"), ("u", None)]
    filled = R.fill_missing(rows, "label", "N")
    assert [r["label"] for r in filled.collect()] == ["a", "N"]
    lines = spark.createDataFrame(
        [('{"content": "x", "account_category": "y"}',), ("1,foo,bar",), ('{"content": 5}',), (None,)],
        "value string",
    )
    assert [tuple(r) for r in R.parse_json(lines).collect()] == [
        ("x", "y"),
        (None, None),
        ("5", None),
        (None, None),
    ]


def test_small_fractions(spark):
    keys = spark.range(1_000_000)
    chosen = S.random_split(keys, "id", fraction=1e-5)[0].count()
    assert 1 <= chosen <= 30
    assert 90 <= S.random_split(keys, "id", fraction=0.00014)[0].count() <= 200
    for fraction in (-0.1, 1.5):
        with pytest.raises(ValueError):
            S.random_split(keys, "id", fraction=fraction)
    assert S.random_split(keys, "id", fraction=1.0)[1].count() == 0


def folds_of(df):
    return sorted((r["id"], r["fold"]) for r in df.select("id", "fold").collect())


def test_more_classes_than_can_be_broadcast(spark, plan, monkeypatch):
    label = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 37)
    df = spark.range(4000).withColumn("label", label)
    wanted = folds_of(S.stratified_kfold(df, "label", "id", buckets=16))
    monkeypatch.setattr(S, "MAX_BROADCAST_CLASSES", 5)
    got = S.stratified_kfold(df, "label", "id", buckets=16)
    # The half of the rows in one class gets its cuts from a broadcast.
    assert "BroadcastHashJoin" in plan(got).split("== Physical Plan ==")[1]
    assert folds_of(got) == wanted


@pytest.mark.parametrize("sort_rows", [1, 7, 100])
def test_large_buckets_are_counted_again(spark, sort_rows):
    key = F.when(F.col("id") < 1500, F.col("id")).otherwise(F.col("id") * 1_000_003)
    df = spark.range(3000).select(key.alias("id"), (F.col("id") % 3).alias("label"))
    whole = S.class_cuts(df, "label", "id", 5, 4)
    small = S.class_cuts(df, "label", "id", 5, 4, sort_rows)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, small.collect()))


def test_labels_that_are_not_listed(spark):
    rows = [(i, ["neg", "pos", "odd", None][i % 4], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label string, fold int")
    with pytest.raises(Exception, match="not listed"):
        S.fold_train_counts(df, "label", ["neg", "pos"], 2).collect()
    found = S.fold_train_counts(df, "label", ["neg", "pos"], 2, other="pos").collect()
    assert sum(r["n"] for r in found) == 40
    apart = S.fold_train_counts(df, "label", ["neg", "pos"], 2, other="rest").collect()
    assert {r["label"]: r["n"] for r in apart if r["fold"] == 0} == {"neg": 0, "pos": 10, "rest": 10}


def test_mark_holdout_equals_holdout(spark):
    df = spark.createDataFrame([(i, f"f{i % 3}") for i in range(12)], "id int, file_name string")
    train, test = S.holdout_by_file(df, 1)
    marked = S.mark_holdout(df, 1)
    assert sorted(r["id"] for r in marked.filter("in_test").collect()) == sorted(r["id"] for r in test.collect())
    assert marked.filter("NOT in_test").count() == train.count()
    assert S.mark_holdout(df, 7).filter("in_test").count() == 0
