"""Trees over binned features: against exhaustive search, and both ways of training."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sparkbars.operators import boost


def _data(n=300, d=6, seed=3, values=9):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, values, (n, d)).astype(float)
    return x, x[:, 0] * 2 - (x[:, 1] > 4) * 5 + x[:, 2] * x[:, 3] / 3 + rng.normal(size=n)


def _frame(spark, x, y):
    df = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y)], "x array<double>, y double")
    return df.select(array_to_vector("x").alias("features"), "y").repartition(3)


def exhaustive(x, y, depth, leaves, least):
    """Predictions of the best-first tree by trying every value of every feature."""
    def best(rows):
        found = (1e-9, None)
        for f in range(x.shape[1]):
            for v in np.unique(x[rows, f])[:-1]:
                a, b = rows[x[rows, f] <= v], rows[x[rows, f] > v]
                if min(len(a), len(b)) >= least:
                    gain = y[a].sum() ** 2 / len(a) + y[b].sum() ** 2 / len(b) - y[rows].sum() ** 2 / len(rows)
                    if gain > found[0] + 1e-9:
                        found = (gain, (a, b))
        return found

    done, todo = [], [(*best(np.arange(len(y))), np.arange(len(y)), 0)]
    while todo and len(done) + len(todo) < leaves:
        todo.sort(key=lambda t: -t[0])
        gain, halves, rows, level = todo.pop(0)
        if halves is None or level == depth:
            done.append(rows)
            continue
        todo += [(*best(h), h, level + 1) for h in halves]
    out = np.zeros(len(y))
    for rows in done + [t[2] for t in todo]:
        out[rows] = y[rows].mean()
    return out


@pytest.mark.parametrize("depth, leaves, least", [(3, None, 1), (7, 12, 20), (2, 3, 5), (5, 31, 1), (1, None, 200)])
def test_one_tree_is_the_exhaustive_one(depth, leaves, least):
    x, y = _data()
    bins = boost.binned(x, boost.edges(x))
    tree = boost.grow(bins, y, np.ones(len(y)), depth, leaves, least, boost.BINS, float(np.abs(y).max()) / 2**21)
    np.testing.assert_allclose(tree.predict(bins), exhaustive(x, y, depth, leaves or 10**6, least), atol=1e-4)


def test_histogram_sums_and_sibling():
    x, y = _data(5000)
    bins, rows, w = boost.binned(x, boost.edges(x)), np.arange(0, 5000, 2), np.arange(5000) % 4.0
    steps = np.rint(y / np.abs(y).max() * 2**23)
    sums = lambda rows: boost.histogram(bins, rows, steps, w, np.zeros((boost.BINS, 2, 6)))
    h = sums(rows)
    for f in range(x.shape[1]):
        assert (h[:, 0, f] == np.bincount(bins[rows, f], w[rows] * steps[rows], boost.BINS)).all()
        assert (h[:, 1, f] == np.bincount(bins[rows, f], w[rows], boost.BINS)).all()
    assert (h - sums(rows[:700]) == sums(rows[700:])).all()
    heavy = boost.histogram(bins, np.arange(5000), np.full(5000, -(2.0**23)), np.full(5000, 15.0), np.zeros((boost.BINS, 2, 6)))
    assert heavy[:, 0].sum(axis=0).tolist() == [-(2.0**23) * 15 * 5000] * 6 and heavy[:, 1].sum(axis=0).tolist() == [75000.0] * 6


def test_edges():
    x = np.array([[0.0, 7, 1], [0, 7, 2], [1, 7, 3], [5, 7, 4]] * 3)
    assert boost.edges(x, 4).tolist() == [[0.5, 3.0, np.inf], [np.inf] * 3, [1.5, 2.5, 3.5]]
    many = np.arange(1000.0)[:, None]
    counts = np.bincount(boost.binned(many, boost.edges(many))[:, 0])
    assert len(counts) == boost.BINS and counts.min() > 20


KINDS = {"leaf-wise": dict(rounds=6, depth=5, rate=0.3, leaves=7, least=8), "by depth": dict(rounds=4, depth=3, rate=0.5), "forest": dict(rounds=5, depth=4, seed=2)}


@pytest.mark.parametrize("kind", KINDS)
def test_passes_give_the_trees_of_one_task(spark, kind):
    x, y = _data(260, 10)
    df = _frame(spark, x, y)
    one, two = (boost.HistTrees(**KINDS[kind], local_cells=k).setLabelCol("y").fit(df) for k in (1 << 20, 0))
    np.testing.assert_allclose(one.scores(x), two.scores(x), atol=1e-3)
    # without a number of leaves the two ways make the same nodes in another order
    nodes = lambda m: [sorted(zip(t.feature, t.bin)) if "leaves" not in KINDS[kind] else t.feature for t in m.trees]
    assert [[n for n in t if n != (-1, 0)] for t in nodes(one)] == [[n for n in t if n != (-1, 0)] for t in nodes(two)]


def test_boosting_by_hand(spark):
    x, y = _data(200, 4)
    model = boost.HistTrees(rounds=5, depth=2, rate=0.4).setLabelCol("y").setPredictionCol("p").fit(_frame(spark, x, y))
    score = np.full(len(y), y.mean())
    for _ in range(5):
        score += 0.4 * exhaustive(x, y - score, 2, 10**6, 1)
    np.testing.assert_allclose(model.scores(x), score, atol=1e-3)
    got = {tuple(r["x"]): r["p"] for r in model.transform(_frame(spark, x, y)).select(F.expr("p"), F.col("features").cast("string").alias("s")).withColumn("x", F.array("s")).collect()}
    assert len(got) == len(np.unique(x, axis=0))
    assert sorted(set(np.round(list(got.values()), 6))) == sorted(set(np.round(model.scores(x), 6)))


def test_forest_is_the_mean_of_bootstrapped_trees(spark):
    x, y = _data(200, 4)
    w = boost.poisson(np.arange(100_000), 3)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    model = boost.HistTrees(rounds=30, depth=6, seed=42).setLabelCol("y").fit(_frame(spark, x, y))
    assert len(model.trees) == 30 and np.corrcoef(model.scores(x), y)[0, 1] > 0.9


def test_few_and_constant_rows(spark):
    for x, y in (([[1.0, 2.0]], [3.0]), ([[1.0, 2.0]] * 5, [3.0, 4, 5, 6, 7]), ([[1.0], [2.0], [3.0]], [4.0, 4.0, 4.0])):
        model = boost.HistTrees(rounds=3, depth=2, rate=0.5).setLabelCol("y").fit(_frame(spark, x, y))
        np.testing.assert_allclose(model.scores(np.array(x)), np.mean(y))
    empty = spark.createDataFrame([], "x array<double>, y double").select(array_to_vector("x").alias("features"), "y")
    assert boost.HistTrees(rounds=3, depth=2, rate=0.5).setLabelCol("y").fit(empty).scores(np.zeros((2, 3))).tolist() == [0, 0]
