"""Model registry: an append-only Parquet table of versions beside the saved models.

A version is registered by one append after its model is wholly saved, so a
reader sees a version or does not; the newest version of a name is the one
loaded. Nothing is overwritten."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ml

SCHEMA = ("name string, version int, model_type string, snapshot_date string, features string, train_size bigint, "
          "test_size bigint, metrics string, path string, created_at string, error string")
#: Rows with features and label that a training needs.
LEAST_ROWS = 100


def entries(spark: SparkSession, root: str) -> DataFrame:
    """All registered versions; none if nothing was registered under ``root``."""
    try:
        return spark.read.schema(SCHEMA).parquet(f"{root}/registry")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def newest(registry: DataFrame) -> DataFrame:
    """The newest version of each name; of versions registered at once, the one saved under the greatest path."""
    last = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("version"), F.desc("path")))
    return registry.withColumn("_last", last).filter("_last = 1").drop("_last")


def train_and_save(spark: SparkSession, root: str, split: DataFrame, features: list[str], label: str, model_type: str = "logistic",
                   snapshot_date: str | None = None) -> DataFrame:
    """Fit on the rows of split 'train', score those of 'test', save the model, append its version; the
    registered row. ``error`` is set, and nothing saved, for fewer than LEAST_ROWS rows or another type."""
    day = snapshot_date or dt.date.today().strftime("%Y%m%d")
    name = f"{model_type}_{day}"
    train, test = split.filter(F.col("split") == "train"), split.filter(F.col("split") == "test")
    n_train, n_test = train.count(), test.count()
    row = dict(name=name, version=None, model_type=model_type, snapshot_date=day, features=json.dumps(features), train_size=n_train,
               test_size=n_test, metrics=None, path=None, created_at=dt.datetime.now(dt.timezone.utc).isoformat(), error=None)
    frame = lambda: spark.createDataFrame([row], SCHEMA)
    if split.count() < LEAST_ROWS or not n_train:
        row["error"] = "insufficient_data"
        return frame()
    makers = {"logistic": lambda: ml.logistic(features, label, n_train), "gbt": lambda: ml.boosted_trees(features, label)}
    if model_type not in makers:
        row["error"] = "unknown_model_type"
        return frame()
    model = makers[model_type]().fit(train)
    scored = ml.probability(model, test).select(F.col(label).alias("y"), "p")
    row["metrics"] = json.dumps(ml.score_metrics(scored).select("auc", "brier", "log_loss").first().asDict())
    last = entries(spark, root).filter(F.col("name") == name).agg(F.max("version")).first()[0]
    row["version"] = (last or 0) + 1
    row["path"] = f"{root}/models/{name}-{row['version']}-{uuid.uuid4().hex[:8]}"
    model.write().save(row["path"])
    frame().coalesce(1).write.mode("append").parquet(f"{root}/registry")
    return frame()


def load(spark: SparkSession, root: str, name: str) -> tuple[PipelineModel | None, dict | None]:
    """(model, registered row) of the newest version of ``name``, or (None, None)."""
    row = newest(entries(spark, root).filter(F.col("name") == name)).first()
    return (PipelineModel.load(row["path"]), row.asDict()) if row else (None, None)
