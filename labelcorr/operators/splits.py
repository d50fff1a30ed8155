"""Train and test splits that do not depend on the layout of the data."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelcorr.functions.hashing import in_sample
from labelcorr.session import checkpointed, few_rows, kept

MAX_BROADCAST_CLASSES = 10_000
MAX_PUSHED_RANGES = 64
BOUNDS_SAMPLE = 0.01
MAX_SORT_ROWS = 1_000_000
MAX_REFINEMENTS = 8
SPREAD = 4096


def holdout_by_file(
    df: DataFrame, k: int, file_col: str = "file_name", include_train: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``(train, test)``: the k-th file by name is the test set, the others train.

    With ``include_train`` the evaluation set is train and test together, which
    is every row once, so it is ``df`` itself and needs no union.
    """
    kth = F.broadcast(_kth_file(df, k, file_col))
    train = df.join(kth, file_col, "left_anti")
    test = df if include_train else df.join(kth, file_col, "left_semi")
    return train, test


def mark_holdout(df: DataFrame, k: int, file_col: str = "file_name") -> DataFrame:
    """Add ``in_test``: is the row in the k-th file by name? One pass for both sides."""
    kth = F.broadcast(_kth_file(df, k, file_col).withColumnRenamed(file_col, "_kth"))
    marked = df.join(kth, F.col(file_col) == F.col("_kth"), "left")
    return marked.withColumn("in_test", F.col("_kth").isNotNull()).drop("_kth")


def _kth_file(df: DataFrame, k: int, file_col: str) -> DataFrame:
    """One row at most: the k-th name, if there are that many."""
    held = df.select(file_col).distinct().orderBy(file_col).limit(k + 1)
    last = held.agg(F.max(file_col).alias(file_col), F.count("*").alias("_files"))
    return last.filter(F.col("_files") == k + 1).select(file_col)


def mark_split(
    df: DataFrame, *keys: str, fraction: float = 0.8, seed: int = 42
) -> DataFrame:
    """Add ``in_train`` by a hash of the key; rows with the same key stay on one side."""
    return df.withColumn("in_train", _sampled(keys, fraction, seed))


def random_split(
    df: DataFrame, *keys: str, fraction: float = 0.8, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """``(train, rest)`` by a hash of the key; every row is in exactly one of them."""
    chosen = _sampled(keys, fraction, seed)
    return df.filter(chosen), df.filter(~chosen)


def test_rest(df: DataFrame, train: DataFrame) -> DataFrame:
    """The distinct rows of ``df`` that are not in ``train``.

    Written as one aggregate over both inputs instead of an anti join: copies
    are folded before the shuffle, so a row that occurs very often costs each
    task one row.
    """
    marked = df.withColumn("_train", F.lit(0)).unionByName(
        train.withColumn("_train", F.lit(1))
    )
    seen = marked.groupBy(*df.columns).agg(F.max("_train").alias("_train"))
    return seen.filter(F.col("_train") == 0).drop("_train")


def split_rest(
    df: DataFrame, columns: list[str], *keys: str, fraction: float = 0.8, seed: int = 42
) -> DataFrame:
    """``test_rest`` of a ``random_split`` on ``columns``: one scan with the sample as a flag."""
    chosen = _sampled(keys, fraction, seed)
    seen = df.groupBy(*columns).agg(F.max(chosen).alias("_train"))
    return seen.filter(~F.col("_train")).drop("_train")


def stratified_kfold(
    df: DataFrame,
    label: str,
    key: str,
    folds: int = 5,
    fold_col: str = "fold",
    buckets: int = 1024,
) -> DataFrame:
    """Add the test fold of each row, class shares kept, unshuffled.

    ``key`` is a unique number that gives the row order. The rows of a class
    are cut into ``folds`` runs in key order, so a fold is known from the keys
    at which the cuts fall. Those few keys are found from a histogram per class;
    the rows themselves are neither sorted nor shuffled, only compared with the
    cuts of their class.
    """
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_size"))
    with kept(class_cuts(df, label, key, folds, buckets)) as cuts:
        few = few_rows(cuts, MAX_BROADCAST_CLASSES)
        if few is None:
            joined = _joined_cuts(df, written_cuts(cuts, sizes), label, key)
        else:
            small = F.broadcast(df.sparkSession.createDataFrame(few, cuts.schema))
            joined = df.join(small, F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")
    passed = F.lit(0)
    for i in range(folds - 1):
        passed = passed + F.when(F.col(key) >= F.get("_cuts", F.lit(i)), 1).otherwise(0)
    return joined.withColumn(fold_col, passed).drop("_cuts")


def written_cuts(cuts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Checkpointed cuts with ``_hot``: is the class one of the few with many rows?

    Fewer than ``MAX_BROADCAST_CLASSES`` classes can hold more than that share of
    all rows each, so the hot ones always fit a broadcast.
    """
    total = sizes.agg(F.sum("_size").alias("_rows"))
    bar = total.select(F.col("_rows") / max(1, MAX_BROADCAST_CLASSES)).scalar()
    sized = sizes.select(F.col("_label").alias("_sized"), "_size")
    joined = cuts.join(sized, F.col("_label").eqNullSafe(F.col("_sized")))
    return checkpointed(joined.select("_label", "_cuts", (F.col("_size") > bar).alias("_hot")))


def _joined_cuts(df: DataFrame, cuts: DataFrame, label: str, key: str) -> DataFrame:
    """``df`` with the cuts of its classes, too many to broadcast them all.

    Rows of hot classes get theirs from a broadcast. The others meet theirs by
    label, and rows that have their cuts already are spread over many keys that
    match nothing, so no key is hot.
    """
    hot = F.broadcast(cuts.filter("_hot").select(F.col("_label").alias("_h"), F.col("_cuts").alias("_hot_cuts")))
    cold = cuts.filter("NOT _hot").select(F.col("_label").alias("_c"), "_cuts", F.lit(0).alias("_at"))
    with_hot = df.join(hot, F.col(label).eqNullSafe(F.col("_h")), "left")
    spread = F.pmod(F.xxhash64(key), F.lit(SPREAD)).cast("int") + 1
    with_hot = with_hot.withColumn("_to", F.when(F.col("_hot_cuts").isNotNull(), spread).otherwise(0))
    met = F.col(label).eqNullSafe(F.col("_c")) & (F.col("_to") == F.col("_at"))
    both = with_hot.join(cold, met, "left")
    return both.withColumn("_cuts", F.coalesce("_hot_cuts", "_cuts")).drop("_h", "_hot_cuts", "_to", "_c", "_at")


def class_cuts(
    df: DataFrame, label: str, key: str, folds: int, buckets: int, sort_rows: int = MAX_SORT_ROWS
) -> DataFrame:
    """``(_label, _cuts)``: per class the keys that start its second and later folds.

    A class whose rows all fall in the first fold has no row here.

    Narrow passes over label and key: quantiles of the key as bucket bounds, a
    count per class and bucket, and a sort of only those buckets a cut falls in,
    each by itself. A bucket with more than ``sort_rows`` rows is counted again
    in as many parts of its key range first, until none is larger, so the sort
    stays small however many rows there are. The key ranges of the buckets are
    literals of the last pass, which lets the scan skip row groups.
    """
    rows = df.select(F.col(label).alias("_label"), F.col(key).alias("_key"))
    shares = [i / buckets for i in range(1, buckets)]
    some = rows.sample(BOUNDS_SAMPLE, seed=0)
    bounds = sorted(set(some.approxQuantile("_key", shares, 0.5 / buckets))) or [0.0]
    bucketed = Bucketizer(
        splits=[-float("inf"), *bounds, float("inf")], inputCol="_key", outputCol="_bucket"
    ).transform(rows)
    bucketed = bucketed.withColumn("_bucket", F.col("_bucket").cast("long"))

    with kept(_histogram(bucketed)) as histogram:
        with kept(_located_cuts(histogram, folds)) as located:
            bucketed, small = _narrowed(df.sparkSession, bucketed, located, folds)
    for _ in range(MAX_REFINEMENTS):
        largest = small.agg(F.max("_n")).first()[0]
        if largest is None or largest <= sort_rows:
            break
        bucketed = _refined(bucketed, small, buckets)
        with kept(_relocated(_histogram(bucketed), small, buckets)) as located:
            bucketed, small = _narrowed(df.sparkSession, bucketed, located, folds)
    at = F.col("_label").eqNullSafe(F.col("_at_label")) & (
        F.col("_bucket") == F.col("_at_bucket")
    )
    nth = F.row_number().over(Window.partitionBy("_label", "_bucket").orderBy("_key")) - 1
    found = (
        bucketed.join(small.drop("_low", "_high", "_n"), at)
        .select("_label", "_bucket", "_key", "_wanted")
        .withColumn("_row", nth)
        .select(
            "_label",
            "_key",
            F.explode(F.filter("_wanted", lambda nth: nth == F.col("_row"))).alias("_hit"),
        )
    )
    return found.groupBy("_label").agg(F.sort_array(F.collect_list("_key")).alias("_cuts"))


def _histogram(bucketed: DataFrame) -> DataFrame:
    return bucketed.groupBy("_label", "_bucket").agg(
        F.count("*").alias("_n"), F.min("_key").alias("_low"), F.max("_key").alias("_high")
    )


def _narrowed(
    spark: SparkSession, bucketed: DataFrame, located: DataFrame, folds: int
) -> tuple[DataFrame, DataFrame]:
    """Rows in the key ranges of the buckets with a cut, and those buckets, fixed."""
    few = few_rows(located, MAX_BROADCAST_CLASSES * folds)
    if few is None:
        return bucketed, checkpointed(located)
    if 0 < len(few) <= MAX_PUSHED_RANGES:
        ranges = [F.col("_key").between(r["_low"], r["_high"]) for r in few]
        bucketed = bucketed.filter(reduce(or_, ranges))
    return bucketed, F.broadcast(spark.createDataFrame(few, located.schema))


def _refined(bucketed: DataFrame, located: DataFrame, parts: int) -> DataFrame:
    """The rows of the buckets with a cut, each bucket cut into parts of equal key width."""
    ends = located.select("_at_label", "_at_bucket", "_low", "_high")
    at = F.col("_label").eqNullSafe(F.col("_at_label")) & (F.col("_bucket") == F.col("_at_bucket"))
    low, high = F.col("_low").cast("double"), F.col("_high").cast("double")
    place = (F.col("_key").cast("double") - low) / F.greatest(high - low, F.lit(1e-300)) * parts
    part = F.least(F.lit(parts - 1), F.floor(place)).cast("long")
    return bucketed.join(ends, at).select(
        "_label", "_key", (F.col("_bucket") * parts + part).alias("_bucket")
    )


def _relocated(histogram: DataFrame, located: DataFrame, parts: int) -> DataFrame:
    """Where the cuts of the buckets fall in their parts: like ``_located_cuts``."""
    mother = F.floor(F.col("_bucket") / parts).cast("long")
    inside = Window.partitionBy("_label", "_mother").orderBy("_bucket")
    upto = F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = histogram.withColumn("_mother", mother).withColumn("_end", upto)
    placed = placed.withColumn("_start", F.col("_end") - F.col("_n"))
    wanted = located.select(
        F.col("_at_label").alias("_of"), F.col("_at_bucket").alias("_in"), F.explode("_wanted").alias("_rank")
    )
    hit = (
        F.col("_label").eqNullSafe(F.col("_of"))
        & (F.col("_mother") == F.col("_in"))
        & (F.col("_rank") >= F.col("_start"))
        & (F.col("_rank") < F.col("_end"))
    )
    return _collected_cuts(placed.join(wanted, hit))


def _collected_cuts(hits: DataFrame) -> DataFrame:
    return hits.groupBy(
        F.col("_label").alias("_at_label"), F.col("_bucket").alias("_at_bucket"), "_low", "_high", "_n"
    ).agg(F.collect_list(F.col("_rank") - F.col("_start")).alias("_wanted"))


def _located_cuts(histogram: DataFrame, folds: int) -> DataFrame:
    """Per class and bucket with a cut: its key range and the ranks at which it is cut."""
    in_order = Window.partitionBy("_label").orderBy("_bucket")
    upto = F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    placed = histogram.withColumn("_end", upto).withColumn("_start", F.col("_end") - F.col("_n"))

    # One row per class, so the window without a partition key is small.
    earlier = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    classes = (
        histogram.groupBy("_label")
        .agg(F.sum("_n").alias("_size"), F.min("_low").alias("_first"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    )
    targets = classes.select(
        F.col("_label").alias("_at_label"), F.explode(F.array(*_fold_starts(folds))).alias("_rank")
    )
    inside = (
        F.col("_at_label").eqNullSafe(F.col("_label"))
        & (F.col("_rank") >= F.col("_start"))
        & (F.col("_rank") < F.col("_end"))
    )
    return _collected_cuts(targets.join(placed, inside))


def _sampled(keys: tuple[str, ...], fraction: float, seed: int) -> Column:
    return in_sample(*[F.col(k) for k in keys], fraction=fraction, seed=seed)


def _fold_starts(folds: int) -> list[Column]:
    """Ranks inside a class at which fold 1, 2, ... start.

    The rows of all classes are dealt to the folds in turn, class after class;
    a fold then takes as many rows of a class as it was dealt.
    """

    def dealt(upto: str, fold: int) -> str:
        return f"({upto} - {fold} + {folds - 1}) div {folds}"

    starts, total = [], "0L"
    for fold in range(folds - 1):
        total += f" + {dealt('(_offset + _size)', fold)} - {dealt('_offset', fold)}"
        starts.append(F.expr(total))
    return starts


def fold_train_counts(
    df: DataFrame,
    label: str,
    classes: list,
    folds: int = 5,
    fold_col: str = "fold",
    other: object | None = None,
) -> DataFrame:
    """``(fold, label, n)``: rows of each class in the train part of each fold.

    One counter per fold and class in a single aggregate; train is the class
    total less the fold's own rows. Labels that are not listed, NULL among them,
    are counted as class ``other``, which may be one of ``classes`` or a further
    one; without it they raise an error.
    """
    listed = F.coalesce(F.col(label).isin(classes), F.lit(False))
    tests = {c: listed & (F.col(label) == F.lit(c)) for c in classes}
    if other is not None:
        tests[other] = tests.get(other, F.lit(False)) | ~listed
    names = list(tests)
    total = [F.count_if(tests[c]).alias(f"t{i}") for i, c in enumerate(names)]
    own = [
        F.count_if((F.col(fold_col) == f) & tests[c]).alias(f"f{f}_{i}")
        for f in range(folds)
        for i, c in enumerate(names)
    ]
    counts = df.agg(*total, *own, F.count_if(~listed).alias("rest"))
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("fold"),
                F.lit(c).alias("label"),
                (F.col(f"t{i}") - F.col(f"f{f}_{i}")).alias("n"),
            )
            for f in range(folds)
            for i, c in enumerate(names)
        ]
    )
    if other is None:
        refused = F.raise_error(F.concat(F.col("rest").cast("string"), F.lit(" labels are not listed")))
        cells = F.when(F.col("rest") > 0, refused).otherwise(cells)
    return counts.select(F.inline(cells))
