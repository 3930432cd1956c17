"""Selectors and classifiers on hand-made frames, where the answer is known."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventalpha.operators import ml as ML


@pytest.fixture(scope="module")
def frame(spark):
    """y depends on a strongly, on b less, on c a little, on d and e not at all; a2 repeats a."""
    rng = random.Random(2)
    rows = []
    for i in range(400):
        a, b, c, d, e = (rng.gauss(0, 1) for _ in range(5))
        rows.append((i, a, b, c, d, e, 3 * a + rng.gauss(0, 0.05), 8 * a + 4 * b + 1.5 * c + rng.gauss(0, 0.1)))
    return spark.createDataFrame(rows, "vec_id int, a double, b double, c double, d double, e double, a2 double, y double"), rows


def test_correlations_in_one_pass(spark, frame):
    df, rows = frame
    names = ["a", "b", "c", "d", "a2", "y"]
    x = np.array([[r[{"a": 1, "b": 2, "c": 3, "d": 4, "a2": 6, "y": 7}[n]] for n in names] for r in rows])
    wide = df.withColumn("a", F.col("a") + 1e6)  # a large mean loses nothing
    got = {(r.a, r.b): r["corr"] for r in ML.correlations(wide.repartition(9), names).collect()}
    expected = np.corrcoef(x.T)
    assert got == {(names[i], names[j]): pytest.approx(expected[i, j], abs=1e-7) for i in range(6) for j in range(i + 1, 6)}
    flat = ML.correlations(df.withColumn("f", F.lit(2.0)), ["f", "y"]).first()["corr"]
    assert flat == 0.0


def test_collinear_pair_loses_the_weaker_one(frame):
    kept = {r.feature for r in ML.drop_collinear(frame[0], ["a", "a2", "b", "d"], "y").collect()}
    assert kept == {"a", "b", "d"}


def test_elimination_order(frame):
    df, _ = frame
    got = {r.feature: r.ranking for r in ML.eliminate(df, ["a", "b", "c", "d", "e"], "y", 1).collect()}
    assert got["a"] == 1 and got["b"] == 2 and got["c"] == 3 and {got["d"], got["e"]} == {4, 5}
    by_two = {r.feature: r.ranking for r in ML.eliminate(df, ["a", "b", "c", "d", "e"], "y", 2, step=2).collect()}
    assert [f for f, r in by_two.items() if r == 1] == ["a", "b"] and by_two["c"] == 2 and by_two["d"] == by_two["e"] == 3
    assert {r.ranking for r in ML.eliminate(df, ["a", "b"], "y", 5).collect()} == {1}
    assert ML.select_by_forest(df, ["a", "b", "c", "d", "e"], "y", 2)[0][0] == "a"


@pytest.fixture(scope="module")
def classes(spark):
    """Three well parted classes by the signs of two features, and one without meaning."""
    rng = random.Random(4)
    rows = []
    for i in range(300):
        label = i % 3
        x, y = ((-4, -4), (4, -4), (0, 5))[label]
        rows.append((i, x + rng.gauss(0, 0.7), y + rng.gauss(0, 0.7), rng.random(), label))
    return spark.createDataFrame(rows, "vec_id int, x double, y double, z double, label int")


@pytest.mark.parametrize("kind,least", [("forest", 0.97), ("svm", 0.95), ("perceptron", 0.9), ("bayes", 0.6)])
def test_held_out_accuracy(classes, kind, least):
    model = ML.fit(classes.filter("vec_id < 240"), ["x", "y", "z"], kind=kind)
    r = ML.accuracy(ML.predict(model, classes.filter("vec_id >= 240"))).first()
    assert r.n == 60 and r.accuracy >= least


def test_bayes_takes_rows_below_the_training_minimum(spark, classes):
    model = ML.fit(classes, ["x", "y", "z"], kind="bayes")
    far = spark.createDataFrame([(1, -100.0, -100.0, -5.0, 0), (2, None, 100.0, None, 2)], classes.schema)
    got = ML.predict(model, far).select("vec_id", "prediction", "features").collect()
    assert all(min(r.features) >= 0 for r in got) and [r.prediction for r in got if r.vec_id == 2] == [2.0]


def test_importances(classes):
    found = ML.fit(classes, ["x", "y", "z"]).importances().collect()
    assert [r.feature for r in found][-1] == "z" and sum(r.importance for r in found) == pytest.approx(1.0)


def test_each_block_is_predicted_from_those_before(spark, classes):
    good = ML.time_series_cv(classes, ["x", "y", "z"], ["vec_id"], 3).collect()
    assert [(r.fold, r.n) for r in sorted(good)] != [] and all(r.accuracy >= 0.95 and r.n == 75 for r in good)
    # In the last block the labels mean something else: only its own fold is wrong, so no fit has seen it.
    turned = classes.withColumn("label", F.when(F.col("vec_id") >= 225, (F.col("label") + 1) % 3).otherwise(F.col("label")))
    worse = {r.fold: r.accuracy for r in ML.time_series_cv(turned, ["x", "y", "z"], ["vec_id"], 3).collect()}
    assert worse[1] >= 0.95 and worse[2] >= 0.95 and worse[3] <= 0.05
