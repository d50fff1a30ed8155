from pathlib import Path

import pytest
from pyspark.sql import functions as F

from labelcorr import session
from labelcorr.operators import splits as S
from labelcorr.sources import files, posts, sinks

POSTS = [
    ("plain", "LeftTroll"),
    ("two\nlines", "RightTroll"),
    ('a "quoted" word, and a comma', "Unknown"),
    ("  outer blanks ", "NewsFeed"),
    (None, "Commercial"),
    ("NA", None),
]
READ = [*POSTS[:5], (None, None)]


def key(row):
    return [(x is None, x or "") for x in row]


def pairs(df):
    return sorted(((r["content"], r["account_category"]) for r in df.collect()), key=key)


@pytest.fixture
def folder(spark, tmp_path):
    for i, name in enumerate(["b.csv", "a.csv", "c.csv"]):
        text = "author,content,account_category\n" + f"u{i},text {i},LeftTroll\n" * (i + 1)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_csv(spark.createDataFrame(POSTS, "content string, account_category string"), path)
    assert pairs(posts.read_posts(spark, path)) == sorted(READ, key=key)


def test_reads_by_name_and_knows_the_file(spark, folder):
    df = posts.read_posts(spark, folder)
    assert df.columns == ["content", "account_category", "file_name"]
    got = {r["file_name"]: r["n"] for r in df.groupBy("file_name").agg(F.count("*").alias("n")).collect()}
    assert got == {"b.csv": 1, "a.csv": 2, "c.csv": 3}


def test_missing_strings_and_types(spark, tmp_path):
    cells = ["", "NA", "null", "nan", "N/A", '""', "7", "x"]
    lines = "".join(f"t,{c}\n" for c in cells)
    (tmp_path / "x.csv").write_text("tweet,conspiracy\n" + lines)
    for kind, wanted in [("int", [None] * 6 + [7, None]), ("string", [None] * 6 + ["7", "x"])]:
        rows = posts.read_posts(spark, str(tmp_path / "x.csv"), f"conspiracy {kind}").collect()
        assert [r["conspiracy"] for r in rows] == wanted


def test_every_file_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("content,account_category\nx,LeftTroll\n")
    (tmp_path / "b.csv").write_text("account_category,content\nRightTroll,y\n")
    (tmp_path / "c.csv").write_text("n,account_category,more,content\n1,NewsFeed,m,z\n")
    (tmp_path / "empty.csv").write_text("")
    assert pairs(posts.read_posts(spark, str(tmp_path))) == [
        ("x", "LeftTroll"), ("y", "RightTroll"), ("z", "NewsFeed")
    ]
    (tmp_path / "d.csv").write_text("content,other\nx,LeftTroll\n")
    with pytest.raises(ValueError, match="account_category"):
        posts.read_posts(spark, str(tmp_path))


RAGGED = """content,account_category
good,LeftTroll
hello, world,LeftTroll
only
"quoted, comma",NewsFeed

"two
lines",RightTroll
"""


def test_ragged_rows_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text(RAGGED)
    for schema in (posts.POST_SCHEMA, "content string"):
        with pytest.raises(Exception, match="refused row of a.csv"):
            posts.read_posts(spark, str(tmp_path), schema).collect()
    with pytest.raises(Exception, match="refused row of a.csv"):
        posts.read_posts(spark, str(tmp_path)).count()
    with pytest.raises(ValueError, match="raise or keep"):
        posts.read_posts(spark, str(tmp_path), refused="drop")


@pytest.mark.parametrize("schema", [posts.POST_SCHEMA, "account_category string"])
def test_ragged_rows_are_quarantined(spark, tmp_path, schema):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(RAGGED)
    (tmp_path / "in" / "b.csv").write_text("n,account_category,content\n1,Unknown,x\n1,2,3,4\n")
    rows = posts.read_posts(spark, str(tmp_path / "in"), schema, refused="keep")
    counts = {r["file_name"]: (r["good"], r["refused"]) for r in posts.refusal_counts(rows).collect()}
    assert counts == {"a.csv": (3, 2), "b.csv": (1, 1)}
    good = posts.quarantine_posts(rows, str(tmp_path / "bad"))
    got = sorted(r["account_category"] for r in good.collect())
    assert got == ["LeftTroll", "NewsFeed", "RightTroll", "Unknown"] and "refused" not in good.columns
    bad = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert sorted(map(tuple, bad)) == [
        ("a.csv", "hello, world,LeftTroll"), ("a.csv", "only"), ("b.csv", "1,2,3,4")
    ]
    assert rows.count() == 7 and rows.filter("refused IS NOT NULL").count() == 3


def test_headers_of_many_files_are_one_job(spark, tmp_path):
    for i in range(120):
        (tmp_path / f"f{i:03d}.csv").write_text(f"c{i % 3},content\nx,y\n")
    (tmp_path / "empty.csv").write_text("\n\n")
    (tmp_path / "marked.csv").write_bytes("\ufeffcontent,\"a\nb\",,X,x\r\n1,2,3,4,5".encode())
    sc = spark.sparkContext
    sc.setJobGroup("headers", "headers")
    try:
        found = posts.read_headers(spark, str(tmp_path))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("headers")) == 1
    names = {Path(path).name: header for path, header in found.items()}
    assert len(names) == 121 and names["f004.csv"] == ("c1", "content")
    assert names["marked.csv"] == ("content", "a\nb", "_c2", "X3", "x4")


def test_headers_that_only_spark_can_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(posts, "_opens", lambda uri: False)
    (tmp_path / "a.csv").write_text("\ncontent,k\nx,y\n")
    (tmp_path / "b.csv").write_text('k,"content"\nx,y\n')
    found = posts.read_headers(spark, str(tmp_path))
    assert sorted(found.values()) == [("content", "k"), ("k", "content")]


def test_a_quote_inside_a_plain_cell(spark, tmp_path):
    rows = ['5" nail,LeftTroll', "plain,RightTroll", '7" pipe,Unknown', "last,NewsFeed"]
    (tmp_path / "a.csv").write_text("\n".join(["content,account_category", *rows]) + "\n")
    assert len(posts.read_posts(spark, str(tmp_path)).collect()) == 4


def test_single_line_files_are_read_in_splits(spark, tmp_path):
    lines = [f"text {i},LeftTroll" for i in range(3000)]
    (tmp_path / "a.csv").write_text("\n".join(["content,account_category", *lines]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 10_000)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        df = posts.read_posts(spark, str(tmp_path), multi_line=False)
        assert df.rdd.getNumPartitions() >= 5
        assert df.select("content").distinct().count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_single_line_files_can_be_split(spark, folder):
    df = posts.read_posts(spark, folder, multi_line=False, partitions=3)
    assert df.count() == 6 and df.rdd.getNumPartitions() == 3


def test_choosing_files(spark, folder):
    found = files.list_files(spark, folder)
    names = [f.rsplit("/", 1)[1] for f in found]
    assert names == ["a.csv", "b.csv", "c.csv"]
    assert files.select_files(found, first=2) == found[:2]
    drawn = files.select_files(found, sample=2, seed=7)
    assert drawn == files.select_files(found[::-1], sample=2, seed=7) and len(set(drawn)) == 2
    assert files.holdout_files(found, 1) == ([found[0], found[2]], [found[1]])
    assert files.numbered_files("x_{}.csv", range(1, 4)) == ["x_1.csv", "x_2.csv", "x_3.csv"]
    train, test = files.holdout_files(found, 0)
    assert posts.read_posts(spark, train).count() == 4
    assert posts.read_posts(spark, test).count() == 2


def test_drawn_files_equal_drawn_rows(spark, folder):
    found = files.list_files(spark, folder)
    drawn = files.select_files(found, sample=2)
    rows = files.sample_file_rows(posts.read_posts(spark, folder), 2)
    names = {r["file_name"] for r in rows.collect()}
    assert names == {f.rsplit("/", 1)[1] for f in drawn}


def test_parquet_copy(spark, folder, tmp_path):
    out = str(tmp_path / "copy")
    df = posts.read_posts(spark, folder)
    posts.posts_to_parquet(df, out, rows_per_file=2)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, df.collect()))


def test_predictions(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = spark.createDataFrame([(0, 2), (1, 0)], "ids long, pred int")
    sinks.write_predictions(rows, path)
    sinks.write_predictions(rows, path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["ids", "political_bias"]
    assert sorted(map(tuple, back.collect())) == [("0", "2"), ("1", "0")]


def test_fold_files_keep_all_columns(spark, tmp_path):
    path = str(tmp_path / "folds")
    rows = [(i, f"text\n{i}", ["neg", "pos"][i % 2]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, content string, label string")
    sinks.write_folds(S.stratified_kfold(df, "label", "id", buckets=4), path)
    back = [
        tuple(r)[:3]
        for fold in range(5)
        for r in posts.read_posts(spark, f"{path}/fold={fold}", "id long, content string, label string").collect()
    ]
    assert sorted(back) == rows


def ids_by_batch(spark, path):
    rows = sinks.read_batches(spark, path, "id bigint").groupBy("batch_id").count().collect()
    return {r["batch_id"]: r["count"] for r in rows}


def test_batches_are_replaced(spark, tmp_path):
    path = str(tmp_path / "batches")
    assert ids_by_batch(spark, path) == {}
    for n in (3, 5):
        sinks.write_batch(spark.range(n), path, 0)
    sinks.write_batch(spark.range(2), path, 1)
    assert ids_by_batch(spark, path) == {0: 5, 1: 2}


def test_batches_are_compacted(spark, tmp_path):
    path = str(tmp_path / "batches")
    assert sinks.compact_batches(spark, path, "id bigint") is None
    for b in range(3):
        sinks.write_batch(spark.range(b + 1), path, b)
    assert sinks.compact_batches(spark, path, "id bigint") == 2
    assert not list((tmp_path / "batches").glob("batches/batch_id=*"))
    sinks.write_batch(spark.range(9), path, 3)
    assert ids_by_batch(spark, path) == {0: 1, 1: 2, 2: 3, 3: 9}
    # A run that was lost before its table was complete changes nothing.
    (tmp_path / "batches" / "compacted" / "upto=9").mkdir()
    assert ids_by_batch(spark, path) == {0: 1, 1: 2, 2: 3, 3: 9}
    assert sinks.compact_batches(spark, path, "id bigint") == 3
    assert sinks.compact_batches(spark, path, "id bigint") == 3
    assert ids_by_batch(spark, path) == {0: 1, 1: 2, 2: 3, 3: 9}


def test_scratch_data_is_removed(spark):
    with session.scratch(spark) as folder:
        path = session.scratch_path(spark, "x")
        assert path.startswith(folder)
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    assert not Path(folder.removeprefix("file:")).exists()
    assert not session.scratch_path(spark, "x").startswith(folder)


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert session.checkpoint_dir(spark) == named
    assert session.scratch_path(spark, "x").startswith(named)
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def test_broadcast_only_when_small(spark, plan):
    small = spark.range(3).withColumnRenamed("id", "k")
    assert "strategy=broadcast" in plan(session.broadcast_if_small(small, 3))
    assert "strategy=broadcast" not in plan(session.broadcast_if_small(small, 2))
