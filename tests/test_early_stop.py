"""Boosted trees are cut at their best round."""

import random

from sparkbars.operators import ml


def test_rounds_kept():
    assert ml.rounds_kept([3.0, 2.0, 1.0]) == 3
    assert ml.rounds_kept([3.0, 1.0, 1.0, 2.0]) == 2  # the first of equal ones
    assert ml.rounds_kept([3.0, 1.0, 2.0, 2.0, 0.5], patience=2) == 2
    assert ml.rounds_kept([3.0, 1.0, 2.0, 2.0, 0.5], patience=3) == 5
    assert ml.rounds_kept([]) == 0 and ml.rounds_kept([float("nan")] * 4) == 4


def test_overfitting_is_cut(spark):
    rng = random.Random(3)
    rows = [(rng.random(), rng.random(), rng.random(), i % 2) for i in range(600)]
    rows = [(a, b, c, float(a > 0.5) if rng.random() < 0.6 else float(y)) for a, b, c, y in rows]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double").coalesce(1)
    train, valid = df.limit(300).checkpoint(), df.offset(300).checkpoint()
    full = ml.boosted_trees(["a", "b", "c"], "y", 12).fit(train)
    losses = full.stages[1].evaluateEachIteration(full.stages[0].transform(valid))
    model = ml.fit_boosted(train, valid, ["a", "b", "c"], "y", rounds=12, patience=3).stages[1]
    assert len(model.trees) == ml.rounds_kept(losses, 3)
    assert [t.toDebugString.split("\n")[1:] for t in model.trees] == [t.toDebugString.split("\n")[1:] for t in full.stages[1].trees[: len(model.trees)]]
    upside = valid.selectExpr("a", "b", "c", "1 - y AS y")  # every round makes it worse
    assert len(ml.fit_boosted(train, upside, ["a", "b", "c"], "y", rounds=12, patience=3).stages[1].trees) == 1
    assert len(ml.fit_boosted(train, valid.limit(0), ["a", "b", "c"], "y", rounds=4).stages[1].trees) == 4
