"""Forecast: the window it starts from, the training windows, the scale and the ensemble."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from sparkbars.operators import ml
from sparkbars.plans.layout import layout
from tests.helpers import bars


def _panel(spark, sizes):
    df = None
    for k, (symbol, n) in enumerate(sizes.items()):
        b = bars(spark, [(i + 1, i + 1, i + 1, i + 1 + 1000 * k, 1) for i in range(n)], symbol=symbol)
        df = b if df is None else df.union(b)
    return layout(df)


def test_last_windows_end_at_the_newest_bar(spark):
    got = {r["symbol"]: r for r in ml.last_windows(_panel(spark, {"A": 130, "B": 60, "C": 75, "D": 59}), ["c", "o"], 60).collect()}
    assert set(got) == {"A", "B", "C"}  # also symbols without a training window
    assert got["A"]["x"] == [float(v) for i in range(70, 130) for v in (i + 1, i + 1)]
    assert got["C"]["x"][::2] == [float(i + 2001) for i in range(15, 75)]
    assert got["A"]["ts"] == dt.datetime(2024, 1, 2, 9, 15) + dt.timedelta(minutes=5 * 129)


def test_training_windows_are_the_first_of_each_symbol(spark):
    w = ml.sequence_windows(_panel(spark, {"A": 130, "B": 101}), ["c"], 60, 30)
    train, test = ml.split_windows(w)
    rn = lambda df, s: sorted(r["rn"] for r in df.filter(F.col("symbol") == s).collect())
    assert (rn(train, "A"), rn(test, "A")) == (list(range(60, 92)), list(range(92, 100)))
    assert (rn(train, "B"), rn(test, "B")) == (list(range(60, 68)), list(range(68, 71)))


def test_scale_is_that_of_the_training_rows(spark):
    x = np.random.default_rng(4).normal(5, 3, (50, 4))
    x[:, 2] = 7.25  # a constant
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "x array<double>")
    scale = ml.vector_scale(df)
    got = np.array([r["x"] for r in ml.standardised(df.limit(3), scale).collect()])
    std = x.std(axis=0)
    std[2] = 1
    np.testing.assert_allclose(got, ((x - x.mean(axis=0)) / std)[:3], atol=1e-9)


def test_forecast_is_the_weighted_ensemble(spark, monkeypatch):
    small = [("gbm", 0.4, lambda: GBTRegressor(maxIter=3, maxDepth=3, seed=42)), ("gb", 0.3, lambda: GBTRegressor(maxIter=2, maxDepth=2, seed=7)),
             ("rf", 0.2, lambda: RandomForestRegressor(numTrees=3, maxDepth=3, seed=42)), ("ridge", 0.1, None)]
    assert [(n, w) for n, w, _ in ml.ENSEMBLE] == [(n, w) for n, w, _ in small]
    monkeypatch.setattr(ml, "ENSEMBLE", small)
    pan = _panel(spark, {"A": 130, "B": 60})
    train, _ = ml.split_windows(ml.sequence_windows(pan, ["c", "o"], 60, 30))
    scale = ml.vector_scale(train)
    models = ml.fit_models(ml.standardised(train, scale).select(array_to_vector("x").alias("features"), "y"))
    last = ml.last_windows(pan, ["c", "o"], 60)
    got = {(r["symbol"], r["step"]): r["pred"] for r in ml.forecast(models, scale, last, 5).collect()}
    assert set(got) == {(s, k) for s in "AB" for k in range(5)}
    for r in ml.standardised(last, scale).collect():
        for k in range(5):
            v = spark.createDataFrame([(np.roll(r["x"], -k).tolist(),)], "x array<double>").select(array_to_vector("x").alias("features")).first()[0]
            want = sum(w * models[n].predict(v) for n, w, _ in small)
            assert got[r["symbol"], k] == pytest.approx(want)
