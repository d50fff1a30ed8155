import math

import pytest

from labelcorr.operators import counts as C
from labelcorr.operators import matrix as M
from labelcorr.operators import quality as Q


@pytest.fixture(scope="module")
def posts(spark):
    rows = [(0, "RightTroll"), (1, "NewsFeed"), (2, "RightTroll"), (3, "LeftTroll"), (4, None), (5, "Odd")]
    return spark.createDataFrame(rows, "id int, c string").repartition(3)


def test_class_counts_in_order_with_absent(posts):
    rows = C.class_counts(posts, "c", ["LeftTroll", "Absent", "RightTroll"]).collect()
    assert [tuple(r) for r in rows] == [
        (0, "LeftTroll", 1, 6),
        (1, "Absent", 0, 6),
        (2, "RightTroll", 2, 6),
    ]


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_first_seen_order(posts, partitions):
    split = posts.repartition(partitions)
    rows = C.category_counts(split, "c", "id").orderBy("first").collect()
    assert [tuple(r) for r in rows] == [
        ("RightTroll", 2, 0),
        ("NewsFeed", 1, 1),
        ("LeftTroll", 1, 3),
        (None, 1, 4),
        ("Odd", 1, 5),
    ]
    names = [r["category"] for r in C.distinct_categories(split, "c", "id").collect()]
    assert names == ["RightTroll", "NewsFeed", "LeftTroll", None, "Odd"]


def test_merged_counts(posts):
    rows = C.merged_counts(posts, "c").collect()
    assert [tuple(r) for r in rows] == [("Left", 1), ("Other", 3), ("Right", 2)]


def weights(spark, labels, **options):
    rows = spark.createDataFrame([(x,) for x in labels], "label int")
    return [r["weight"] for r in C.class_weights(rows, "label", range(3), **options).collect()]


def test_class_weights(spark):
    assert weights(spark, [0, 1, 2]) == [3.0, 3.0, 3.0]
    assert weights(spark, [0] * 6 + [1] + [2]) == [8 / 6, 8.0, 8.0]
    assert weights(spark, [0, 2, 2]) == [3.0, None, 1.5]


def test_absent_class_raises_when_strict(spark):
    with pytest.raises(Exception, match="no rows of class 1"):
        weights(spark, [0, 2], strict=True)


def test_example_and_batch_counts(spark):
    assert tuple(C.example_and_batch_counts(spark.range(17), 8).first()) == (17, 3)
    assert tuple(C.example_and_batch_counts(spark.range(16), 8).first()) == (16, 2)


def pairs(spark, rows):
    return spark.createDataFrame(rows, "given int, pred int")


def test_matrix_with_empty_row_and_column(spark):
    rows = pairs(spark, [(0, 0), (0, 0), (0, 2), (2, 2)])
    matrix = M.distribution_matrix(rows, "given", "pred", range(3), range(3))
    got = {(r["given"], r["pred"]): (r["n"], r["p"]) for r in matrix.collect()}
    assert len(got) == 9
    assert got[0, 0] == (2, 2 / 3) and got[0, 1] == (0, 0.0) and got[0, 2] == (1, 1 / 3)
    assert [got[1, p] for p in range(3)] == [(0, None)] * 3
    assert got[2, 2] == (1, 1.0)


def test_rectangular_and_wide_matrix(spark):
    rows = pairs(spark, [(0, 4), (1, 0), (1, 4)])
    matrix = M.distribution_matrix(rows, "given", "pred", range(3), range(5))
    wide = {r["given"]: tuple(r)[1:] for r in M.wide_matrix(matrix, range(5)).collect()}
    assert wide[0] == (0.0, 0.0, 0.0, 0.0, 1.0)
    assert wide[1] == (0.5, 0.0, 0.0, 0.0, 0.5)
    assert wide[2] == (None,) * 5


def test_matrix_without_rows(spark):
    matrix = M.distribution_matrix(pairs(spark, []), "given", "pred", range(2), range(2))
    assert [(r["n"], r["p"]) for r in matrix.collect()] == [(0, None)] * 4


def test_matrix_does_not_filter_below_the_counting(spark, plan):
    rows = pairs(spark, [(0, 0)])
    matrix = M.distribution_matrix(rows, "given", "pred", range(3), range(3))
    optimized = plan(matrix).split("== Optimized Logical Plan ==")[1]
    assert "Filter" not in optimized and "Join" not in optimized


def test_association_multiplies_repeated_keys(spark):
    a_rows = [(1, 0), (1, 0), (1, 1), (2, 1), (3, 0)]
    b_rows = [(1, 0), (1, 1), (1, 1), (2, 0), (4, 1)]
    a = spark.createDataFrame(a_rows, "k int, a int")
    b = spark.createDataFrame(b_rows, "k int, b int")
    got = {
        (r["given"], r["pred"]): r["n"]
        for r in M.label_association(a, b, "k", "a", "b", [0, 1], [0, 1]).collect()
    }
    wanted = {(i, j): 0 for i in range(2) for j in range(2)}
    for k, x in a_rows:
        for m, y in b_rows:
            if k == m:
                wanted[x, y] += 1
    assert got == wanted


def scored(spark, rows):
    return spark.createDataFrame(rows, "id int, logits array<double>, truth int")


ROWS = [
    (0, [2.0, 1.0, 0.0], 0),
    (1, [0.0, 3.0, 3.0], 1),
    (2, [1.0, 5.0, 0.5], 2),
    (3, [800.0, -800.0, 0.0], 0),
]


def nll(logits, label):
    top = max(logits)
    return math.log(sum(math.exp(z - top) for z in logits)) + top - logits[label]


@pytest.mark.parametrize("weights", [None, [1.0, 2.0, 5.0]])
def test_evaluate(spark, weights):
    counts = Q.score_counts(scored(spark, ROWS))
    row = Q.evaluate(counts, weights).first()
    w = weights or [1.0] * 3
    total = sum(w[t] for _, _, t in ROWS)
    loss = sum(w[t] * nll(z, t) for _, z, t in ROWS) / total
    assert row["examples"] == 4
    assert row["loss"] == pytest.approx(loss)
    assert row["accuracy"] == row["micro_f1"] == 0.75
    assert Q.accuracy(counts).first()[0] == Q.micro_f1(counts).first()[0] == 0.75
    assert Q.weighted_cross_entropy(counts, weights).first()[0] == pytest.approx(loss)


def test_evaluate_with_a_weight_table(spark):
    rows = scored(spark, ROWS)
    table = C.class_weights(rows, "truth", range(3))
    listed = C.weight_list(rows, "truth", range(3))
    counts = Q.score_counts(rows)
    assert Q.evaluate(counts, table).first()["loss"] == pytest.approx(
        Q.evaluate(counts, listed).first()["loss"]
    )


@pytest.mark.parametrize("truth, wanted", [([0, 1, 2], 1.0), ([1, 2, 0], 0.0)])
def test_all_right_and_all_wrong(spark, truth, wanted):
    rows = [(i, [float(c == i) for c in range(3)], t) for i, t in enumerate(truth)]
    found = Q.evaluate(Q.score_counts(scored(spark, rows))).first()
    assert found["accuracy"] == found["micro_f1"] == wanted


def test_evaluate_nothing(spark):
    found = Q.evaluate(Q.score_counts(scored(spark, []))).first()
    assert tuple(found) == (0, None, None, None)


def test_argmax_ties_and_nan(spark):
    rows = scored(spark, [(0, [1.0, 1.0], 0), (1, [0.0, float("nan"), 9.0], 0), (2, [-1.0, -0.5], 0)])
    got = Q.order_by_id(Q.prediction_table(rows, "id")).collect()
    assert [tuple(r) for r in got] == [(0, 0), (1, 1), (2, 1)]


def test_attach_truth(spark):
    predictions = spark.createDataFrame([(1, 0), (2, 1), (9, 1)], "ids int, pred int")
    labels = spark.createDataFrame([(2, 1), (1, 2)], "id int, label int")
    rows = Q.attach_truth(predictions, labels, "id", "label").collect()
    assert sorted(tuple(r) for r in rows) == [(1, 0, 2), (2, 1, 1)]


def test_mean_batch_loss(spark):
    rows = scored(spark, ROWS).selectExpr("*", "id div 2 AS batch")
    w = [1.0, 2.0, 5.0]
    batches = [ROWS[:2], ROWS[2:]]
    wanted = sum(
        sum(w[t] * nll(z, t) for _, z, t in b) / sum(w[t] for _, _, t in b) for b in batches
    )
    loss, steps = Q.mean_batch_loss(rows, "batch", w).first()
    assert steps == 2 and loss == pytest.approx(wanted / 2)


def counts_with_outsiders(spark):
    rows = [(0, 0), (0, 0), (0, 4), (7, 1), (None, 0), (1, None)]
    return spark.createDataFrame(rows, "a int, b int")


def test_labels_outside_the_lists_raise_or_stay(spark):
    df = counts_with_outsiders(spark)
    with pytest.raises(Exception, match="outside the listed"):
        M.distribution_matrix(df, "a", "b", [0, 1], [0, 1]).collect()
    kept = M.distribution_matrix(df, "a", "b", [0, 1], [0, 1], outside="keep").collect()
    cells = {(r["given"], r["pred"]): (r["n"], r["p"]) for r in kept}
    assert len(cells) == 16 and sum(n for n, _ in cells.values()) == 6
    assert cells[0, 0] == (2, pytest.approx(2 / 3)) and cells[0, M.OUTSIDE][0] == 1
    assert cells[M.OUTSIDE, 1][0] == cells[None, 0][0] == cells[1, None][0] == 1


def test_association_keeps_what_is_outside(spark):
    a = spark.createDataFrame([(1, 0), (2, 0), (3, 5), (4, None)], "k int, a int")
    b = spark.createDataFrame([(1, 0), (2, 9), (3, 0), (4, 0)], "k int, b int")
    with pytest.raises(Exception, match="outside the listed"):
        M.label_association(a, b, "k", "a", "b", [0], [0]).collect()
    found = M.label_association(a, b, "k", "a", "b", [0], [0], outside="keep").collect()
    cells = {(r["given"], r["pred"]): r["n"] for r in found}
    assert cells[0, 0] == cells[0, M.OUTSIDE] == cells[M.OUTSIDE, 0] == cells[None, 0] == 1
    assert sum(cells.values()) == 4


def test_a_class_without_weight_raises(spark):
    rows = [(0, 0, 5, 1.0), (1, 1, 4, 1.0), (2, 0, 3, 1.0)]
    counts = spark.createDataFrame(rows, "given int, pred int, n long, nll double")
    table = spark.createDataFrame([(0, 1.0), (1, 2.0)], "label int, weight double")
    for weights in (table, [1.0, 2.0]):
        with pytest.raises(Exception, match="no weight for class 2"):
            Q.evaluate(counts, weights).collect()
        assert Q.evaluate(counts.filter("given < 2"), weights).first()["examples"] == 9


def test_weights_of_counts(spark):
    rows = [(0, 0, 5), (0, 1, 1), (1, 1, 4), (None, 1, 2)]
    counts = spark.createDataFrame(rows, "given int, pred int, n long")
    found = C.weights_of_counts(counts, "given", [0, 1, 2]).collect()
    assert [(r["label"], r["n"], r["weight"]) for r in found] == [(0, 6, 2.0), (1, 4, 3.0), (2, 0, None)]
