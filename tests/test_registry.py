"""Registry: versions, load by name, too few rows, unknown type."""

import json
import random

from sparkbars.operators import ml, registry

FEATURES = ["a", "b"]


def _split(spark, n, flip=1):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append(("S", i, a, b, int(flip * a + 0.3 * rng.gauss(0, 1) > 0), "train" if i < 0.8 * n else "purge" if i < 0.8 * n + 5 else "test"))
    return spark.createDataFrame(rows, "symbol string, ts int, a double, b double, y int, split string")


def test_versions_and_load_by_name(spark, tmp_path):
    root = str(tmp_path)
    assert registry.load(spark, root, "logistic_20250101") == (None, None)
    one = registry.train_and_save(spark, root, _split(spark, 400), FEATURES, "y", snapshot_date="20250101").first()
    two = registry.train_and_save(spark, root, _split(spark, 500, flip=-1), FEATURES, "y", snapshot_date="20250101").first()
    other = registry.train_and_save(spark, root, _split(spark, 400), FEATURES, "y", snapshot_date="20250102").first()
    assert (one["version"], two["version"], other["version"]) == (1, 2, 1) and one["path"] != two["path"]
    assert json.loads(one["metrics"])["auc"] > 0.9 and (one["train_size"], one["test_size"]) == (320, 75)
    assert registry.entries(spark, root).count() == 3 and registry.newest(registry.entries(spark, root)).count() == 2
    model, row = registry.load(spark, root, "logistic_20250101")
    assert row["version"] == 2 and row["train_size"] == 400
    up = ml.probability(model, spark.createDataFrame([(2.0, 0.0), (-2.0, 0.0)], "a double, b double")).collect()
    assert up[0]["p"] < 0.5 < up[1]["p"]  # the second fit, whose labels are turned round


def test_errors_save_nothing(spark, tmp_path):
    root = str(tmp_path)
    few = registry.train_and_save(spark, root, _split(spark, 99), FEATURES, "y").first()
    odd = registry.train_and_save(spark, root, _split(spark, 200), FEATURES, "y", model_type="oracle").first()
    assert (few["error"], odd["error"]) == ("insufficient_data", "unknown_model_type") and few["path"] is None
    assert registry.entries(spark, root).count() == 0
