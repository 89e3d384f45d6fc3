import random

import pytest

from storegrain.operators import metrics, splits


def pair_auc(rows):
    pos = [s for s, y in rows if y > 0.5]
    neg = [s for s, y in rows if y <= 0.5]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_ties(spark):
    rng = random.Random(4)
    rows = [(round(rng.random(), 1), float(rng.random() < 0.4)) for _ in range(300)]
    df = spark.createDataFrame(rows, "s double, y double")
    assert metrics.auc(df, "s", "y") == pytest.approx(pair_auc(rows), abs=1e-12)


def test_auc_of_one_class_and_of_nothing(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.9, 1.0)], "s double, y double")
    assert metrics.auc(df, "s", "y") == 0.0 and metrics.auc(df.limit(0), "s", "y") == 0.0


def test_classification_by_hand(spark):
    df = spark.createDataFrame([(0.9, 1.0), (0.6, 0.0), (0.5, 1.0), (0.1, 0.0)], "s double, y double")
    row = metrics.classification_metrics(df, [("s", "y", "t")]).first()
    assert (row.t_acc, row.t_f1) == (0.5, 0.5)
    none = metrics.classification_metrics(df.filter("y = 0 and s < 0.5"), [("s", "y", "t")]).first()
    assert (none.t_acc, none.t_f1) == (1.0, 0.0)


def test_regression_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (5.0, 5.0)], "y double, s double")
    row = metrics.regression_metrics(df, [("s", "y", "t", True)]).first()
    assert row.t_mae == pytest.approx(2 / 3) and row.t_r2 == pytest.approx(1 - 2 / 8)
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, s double")
    assert metrics.regression_metrics(flat, [("s", "y", "t", True)]).first().t_r2 == 1.0
    assert metrics.regression_metrics(flat.selectExpr("y", "2.0D as s"), [("s", "y", "t", True)]).first().t_r2 == 0.0


def test_comparison_directions(spark):
    rows = [("a", "x_auc", 0.7), ("b", "x_auc", 0.9), ("a", "x_mae", 3.0), ("b", "x_mae", 5.0), ("a", "only", 1.0),
            ("a", "tie", 1.0), ("b", "tie", 1.0)]
    out = {r.metric: r.best_model for r in metrics.compare_models(spark.createDataFrame(rows, "model string, metric string, value double")).collect()}
    assert out == {"x_auc": "b", "x_mae": "a", "tie": "a"}


@pytest.mark.parametrize("n", [1, 2, 7, 100, 2_503])
def test_exact_sizes(spark, n):
    df = spark.range(n)
    out = {r.split: r.n for r in splits.split_counts(splits.assign_split(df, "id", exact=True)).collect()}
    assert out == {k: v for k, v in splits.split_sizes(n).items() if v}


def test_split_does_not_depend_on_other_rows(spark):
    small, big = spark.range(200), spark.range(1_000)
    a = splits.assign_split(small, "id")
    b = splits.assign_split(big.repartition(5), "id")
    assert a.exceptAll(b).isEmpty()


def test_sizes_follow_the_rounding_rule():
    # 4500 * (0.1 / 0.9) is a little over 500 in doubles, and the part is rounded up.
    assert splits.split_sizes(5_000) == {"train": 3_999, "val": 501, "test": 500}
    assert splits.split_sizes(105) == {"train": 83, "val": 11, "test": 11}
