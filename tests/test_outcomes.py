"""The outcome model: all classes, hinges, weights and the early stop."""

import random

from pyspark.sql import functions as F

from tallylane.functions import features
from tallylane.operators import model

c = F.col


def rows_of(spark, n, seed, noise=0.0):
    """Class follows x by thirds; class 3 is rare."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = rng.uniform(-1, 1)
        y = 3.0 if i % 50 == 0 else float(min(2, int((x + 1) * 1.5)))
        out.append((x, rng.gauss(0, 1), float(rng.randrange(4)) if rng.random() < noise else y, 1.0 + i % 3))
    return spark.createDataFrame(out, "x double, z double, label double, w double")


def test_all_classes_and_the_best_budget(spark):
    train, stop = rows_of(spark, 600, 1), rows_of(spark, 200, 2)
    m, history = model.outcome_model(train, stop, ["x", "z"], "label", budgets=(1, 4, 16, 64))
    assert m.numClasses == 4 and [h[0] for h in history] == [1, 4, 16, 64][: len(history)]
    p = model.predict(m, stop, ["x", "z"])
    loss = model.log_loss(p, "p", "label")
    assert abs(loss - min(h[2] for h in history)) < 1e-5 and loss < 0.6
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in p.select("p").collect())


def test_growing_budgets_stop_when_the_held_rows_get_worse(spark):
    """Labels of the held rows do not follow the training rows, so more iterations cannot help."""
    train = rows_of(spark, 300, 3)
    stop = train.withColumn("label", F.pmod(c("label") + 1, F.lit(3.0)))
    _, history = model.outcome_model(train, stop, ["x"], "label", budgets=(1, 8, 64))
    assert len(history) == 2 and history[1][2] >= history[0][2]


def test_weights_are_relative(spark):
    train = rows_of(spark, 300, 4, 0.2)
    a, _ = model.outcome_model(train, train, ["x"], "label", "w", budgets=(30,))
    b, _ = model.outcome_model(train.withColumn("w", c("w") * 10), train, ["x"], "label", "w", budgets=(30,))
    assert abs(a.coefficientMatrix.toArray() - b.coefficientMatrix.toArray()).max() < 1e-6


def test_an_unknown_class_has_the_floor(spark):
    scored = spark.createDataFrame([([0.5, 0.5], 0.0), ([0.5, 0.5], 5.0)], "p array<double>, label double")
    assert 10 < model.log_loss(scored, "p", "label") < 20


def test_hinges_of_many_columns_equal_those_of_one(spark):
    df = rows_of(spark, 200, 5)
    both = features.hinge_table(df, df.where("w > 1"), ["x", "z"])
    for x in ("x", "z"):
        one = features.hinges(df, df.where("w > 1"), x)
        cols = ["x", "z", *[f"{x}_h{i}" for i in (1, 2, 3)]]
        assert sorted(map(tuple, both.select(cols).collect())) == sorted(map(tuple, one.select(cols).collect()))
