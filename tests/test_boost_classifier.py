"""The boosted classifier: the trees of MLlib's, however the rows are dealt, without a look at them per tree so far."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from sparkbars.operators import boost, ml

NAMES = ["a", "b", "c", "d"]


def _rows(n=2500, seed=5):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 9, n), np.full(n, 2.5), np.where(rng.random(n) < 0.5, 0.0, rng.exponential(size=n))])
    y = (x[:, 0] + 0.3 * x[:, 1] - x[:, 3] + rng.normal(size=n) > 1).astype(float)
    return [tuple(map(float, (*a, b))) for a, b in zip(x, y)]


def _frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "a double, b double, c double, d double, y double").repartition(parts)


def _p(model, df):
    return np.array([r["p"] for r in ml.probability(model, df).orderBy(*NAMES, "y").select("p").collect()])


@pytest.mark.parametrize("n", [2500, 15000])  # from 10,000 on the bins come from a sample
def test_trees_are_those_of_mllib(spark, n):
    train, test = _frame(spark, _rows(n)).cache(), _frame(spark, _rows(700, 6)).cache()
    asm = VectorAssembler(inputCols=NAMES, outputCol="features")
    theirs = GBTClassifier(labelCol="y", maxDepth=4, maxIter=8, stepSize=0.05, minInstancesPerNode=30, seed=42).fit(asm.transform(train))
    pipe = ml.boosted_trees(NAMES, "y", 8).fit(train)
    ours = pipe.stages[1]
    assert isinstance(ours, boost.HistClassifierModel)  # MLlib's own takes too long over many rows
    assert [t.numNodes for t in ours.trees] == [t.numNodes for t in theirs.trees]
    assert ours.treeWeights == theirs.treeWeights
    got = ours.transform(asm.transform(test)).orderBy(*NAMES, "y").select("prediction", vector_to_array("probability")[1], vector_to_array("rawPrediction")[1]).collect()
    want = theirs.transform(asm.transform(test)).orderBy(*NAMES, "y").select("prediction", vector_to_array("probability")[1], vector_to_array("rawPrediction")[1]).collect()
    np.testing.assert_allclose(np.array(got), np.array(want), atol=1e-6)
    np.testing.assert_allclose(ours.evaluateEachIteration(asm.transform(test)), theirs.evaluateEachIteration(asm.transform(test)), atol=1e-6)


def test_same_trees_however_dealt_and_kept(spark, tmp_path, monkeypatch):
    train = _frame(spark, _rows()).cache()
    one = ml.boosted_trees(NAMES, "y", 13).fit(train)
    monkeypatch.setattr(boost, "_BLOCK_ROWS", 100)
    monkeypatch.setattr(boost, "_TASK_ROWS", 150)
    other = ml.boosted_trees(NAMES, "y", 13).fit(train.repartition(7))
    shown = lambda m: [t.toDebugString for t in m.stages[1].trees]
    assert len(shown(one)) == 13 and shown(one) == shown(other)
    one.write().save(f"{tmp_path}/m")
    loaded = PipelineModel.load(f"{tmp_path}/m")
    assert shown(loaded) == shown(one)
    assert (_p(loaded, train) == _p(one, train)).all()


def test_a_round_costs_the_same_however_many_trees(spark, monkeypatch):
    jobs, passes = [], boost.HistClassifier._sums

    def counted(self, state, new, tree, nodes, ends, t):
        jobs.append((t, len(nodes), len(new)))
        return passes(self, state, new, tree, nodes, ends, t)

    monkeypatch.setattr(boost.HistClassifier, "_sums", counted)
    ml.boosted_trees(NAMES, "y", 10).fit(_frame(spark, _rows(1500)))
    assert max(sum(1 for t, *_ in jobs if t == r) for r in range(10)) <= 4
    assert all(n <= 4 and new < boost._NEW for _, n, new in jobs)  # of two children one is summed


def test_bad_labels_and_features(spark):
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        ml.boosted_trees(NAMES, "y", 2).fit(_frame(spark, [(1.0, 2.0, 3.0, 4.0, 2.0)] * 70))
    with pytest.raises(Exception, match="NaN or infinite"):
        ml.boosted_trees(NAMES, "y", 2).fit(_frame(spark, [(1.0, float("inf"), 3.0, 4.0, 1.0)] * 70))
    one = ml.boosted_trees(NAMES, "y", 2).fit(_frame(spark, [(1.0, 2.0, 3.0, 4.0, 1.0)]))  # a single row: leaves
    assert [t.numNodes for t in one.stages[1].trees] == [1, 1]
