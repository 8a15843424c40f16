import math

import pytest
from pyspark.sql import functions as F

from hatefold.functions.scores import argmax, lrap_row, softmax
from hatefold.operators import metrics as M


def _lrap(spark, truth, scores):
    df = spark.createDataFrame([(t, s) for t, s in zip(truth, scores)], "y array<int>, s array<double>")
    return df.agg(F.avg(lrap_row(F.col("y"), F.col("s")))).first()[0]


def test_lrap_literal(spark):
    v = _lrap(spark, [[1, 0, 0], [0, 0, 1]], [[.75, .5, 1.0], [1.0, .2, .1]])
    assert v == pytest.approx(0.416666667, abs=1e-6)


def test_lrap_all_or_none_true_is_one(spark):
    assert _lrap(spark, [[0, 0, 0]], [[.1, .2, .3]]) == 1.0
    assert _lrap(spark, [[1, 1, 1]], [[.1, .2, .3]]) == 1.0


def test_lrap_ties(spark):
    # true label tied with a false one: rank counts both -> 1/2
    assert _lrap(spark, [[1, 0, 0]], [[.5, .5, .1]]) == pytest.approx(0.5)
    # two true labels tied at the top -> 1.0
    assert _lrap(spark, [[1, 1, 0]], [[.5, .5, .1]]) == pytest.approx(1.0)


def test_argmax_first_on_ties(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "s array<double>")
    assert df.select(argmax("s")).first()[0] == 1


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([([1000.0, 1001.0, 999.0],)], "z array<double>")
    p = df.select(softmax("z").alias("p")).first()["p"]
    assert sum(p) == pytest.approx(1.0)
    assert max(p) == p[1]


def test_multilabel_macro_counts_absent_label_as_zero(spark):
    # label 1 is never true nor predicted: it scores 0 and still counts in the macro mean
    rows = [([1, 0], [5.0, -5.0]), ([0, 0], [-5.0, -5.0])]
    df = spark.createDataFrame(rows, "y_fine array<int>, logits_fine array<double>")
    r = M.fine_metrics(df, n_labels=2).first()
    assert r["macro_f1"] == pytest.approx(0.5)
    assert r["micro_f1"] == pytest.approx(1.0)
    assert r["jaccard_macro"] == pytest.approx(0.5)
    assert r["hamming_loss"] == 0.0
    assert r["subset_accuracy"] == 1.0


def test_single_label_macro_drops_unseen_classes(spark):
    # classes 0 and 1 seen; class 2 never in truth nor prediction -> not averaged
    rows = [(0, [5.0, 0.0, -5.0]), (1, [0.0, 5.0, -5.0]), (1, [5.0, 0.0, -5.0])]
    df = spark.createDataFrame(rows, "y_coarse int, logits_coarse array<double>")
    r = M.coarse_metrics(df).first()
    # class 0: tp=1 fp=1 fn=0 -> 2/3 ; class 1: tp=1 fp=0 fn=1 -> 2/3
    assert r["macro_f1"] == pytest.approx(2 / 3, abs=1e-6)
    assert r["accuracy"] == pytest.approx(2 / 3, abs=1e-6)
    assert r["micro_f1"] == pytest.approx(2 / 3, abs=1e-6)


def test_class_weights_absent_class_counts_as_one(spark):
    df = spark.createDataFrame([("clean",), ("clean",), ("hate",)], "hate_label string")
    w = {r["cls"]: r["weight"] for r in M.class_weights(df, "hate_label", ["clean", "offensive", "hate"]).collect()}
    assert w["clean"] == pytest.approx(3 / (3 * 2))
    assert w["offensive"] == pytest.approx(3 / (3 * 1))
    assert w["hate"] == pytest.approx(3 / (3 * 1))


def test_pos_weights(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0), (0, 0)], "a int, b int")
    w = {r["label"]: r["weight"] for r in M.pos_weights(df, ["a", "b"]).collect()}
    assert w["a"] == pytest.approx(2 / (2 + 1e-6))
    assert w["b"] == pytest.approx(4 / 1e-6)


def test_consistency_penalty(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0], [0.0, 0.0])], "zc array<double>, zf array<double>")
    v = df.select(M.consistency_penalty(F.col("zc"), F.col("zf"))).first()[0]
    c, q = 1 / 3, 0.25
    assert v == pytest.approx(c * (1 - q) + (1 - c) * q)


def test_losses_match_numpy(spark):
    import numpy as np
    from hatefold.operators.train import head_gradients
    rows = [(0, [1, 0, 0, 0, 0, 0, 0, 0], [0.2, -0.1, 0.3], [0.1] * 8),
            (2, [0, 1, 1, 0, 0, 0, 0, 1], [-0.5, 0.4, 0.9], [-0.3, 0.2, 0.5, -1.0, 0.0, 0.7, -0.2, 0.3])]
    df = spark.createDataFrame(rows, "y_coarse int, y_fine array<int>, logits_coarse array<double>, "
                                     "logits_fine array<double>")
    r = M.losses(df, lambda_fine=1.0, lambda_hier=1.0).first()
    zc = np.array([x[2] for x in rows])
    zf = np.array([x[3] for x in rows])
    y = np.array([x[0] for x in rows])
    Y = np.array([x[1] for x in rows], dtype=float)
    loss_h, _ = head_gradients(zc, zf, y, Y, np.ones(3), np.ones(8), 2.0, 2.0, 1.0, 1.0)
    assert r["loss_hier"] == pytest.approx(loss_h, abs=1e-5)
    assert not math.isnan(r["loss_flat"])
