"""Queries: model data preparation, metrics, fits, scoring, forecasts, and the
streaming bar builder."""

from __future__ import annotations

import json

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import features_core, features_wide, labels, ml, registry
from ..params import DEFAULT
from ..session import scratch_path, shared_dir, written
from ..sources import fixtures
from ..streaming import bars_stream
from . import sqlparts as S
from .layout import layout
from .q_features import featured_panel
from .q_labels import ctes_meta
from .registry import query

FEATURES = features_core.columns()
TARGET = "meta_label"


def train_frame(spark, sf_dir) -> tuple[DataFrame, int]:
    """Features and target per bar, and rows that no symbol exceeds."""
    bars, most = fixtures.panel_histories(spark, sf_dir)
    pan = labels.meta_labels(featured_panel(bars, most=most, distinct=True))
    return ml.training_frame(pan.core(), FEATURES, TARGET), most


def ctes_train() -> list[str]:
    cond = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)
    return [S.ctes_bars_panel(), S.ctes_core_features("bars_panel"), ctes_meta("feat"),
            f"tf AS (SELECT symbol, ts, {', '.join(FEATURES)}, meta_label FROM ml WHERE {cond} AND meta_label IS NOT NULL)"]


@query("training_frame", lambda: S.with_(*ctes_train()) + (
    "SELECT symbol, ts, " + ", ".join(f"{S.R(c)} AS {c}" for c in FEATURES) + ", meta_label FROM tf"))
def q_training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: model features + target per bar, rows with nulls dropped."""
    frame, _ = train_frame(spark, sf_dir)
    return frame.select("symbol", "ts", *[rnd(c).alias(c) for c in FEATURES], TARGET)


@query("purged_split", lambda: S.with_(*ctes_train(), """sp AS (
  SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn,
         count(*) OVER (PARTITION BY symbol) AS n FROM tf)""") + (
    "SELECT symbol, ts, CASE WHEN rn < floor(n * 0.8) THEN 'train' WHEN rn < floor(n * 0.8) + 5 THEN 'purge' "
    "ELSE 'test' END AS split FROM sp"))
def q_purged_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: per symbol first 80 % of the cleaned rows train, 5 purged, rest test."""
    frame, most = train_frame(spark, sf_dir)
    return ml.purged_split(frame.select("symbol", "ts"), most=most).select("symbol", "ts", "split")


SCORE_P = "(((doc_id * 37) % 101) + 101) % 101 / 101.0"


@query("score_metrics", lambda: f"""WITH s AS (SELECT CAST(quality AS DOUBLE) AS y, {SCORE_P} AS p FROM labels),
g AS (SELECT p, sum(y) AS pos, sum(1.0 - y) AS neg FROM s GROUP BY p),
r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS nb FROM g)
SELECT (SELECT count(*) FROM s) AS rows,
       {S.R('(SELECT avg((p - y) * (p - y)) FROM s)', 8)} AS brier,
       {S.R('(SELECT -avg(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1.0 - y) * ln(1.0 - least(greatest(p, 1e-15), 1 - 1e-15))) FROM s)', 8)} AS log_loss,
       {S.R('(SELECT sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)) FROM r)', 8)} AS auc""")
def q_score_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: AUC (mid ranks), Brier score and log loss of a deterministic score against labels.quality."""
    lab = fixtures.table(spark, sf_dir, "labels")
    s = lab.select(F.col("quality").cast("double").alias("y"), (F.pmod(F.col("doc_id") * 37, F.lit(101)) / F.lit(
        101.0)).alias("p"))
    m = ml.score_metrics(s)
    return m.select(F.col("rows").cast("long").alias("rows"), rnd("brier", 8).alias("brier"),
                    rnd("log_loss", 8).alias("log_loss"), rnd("auc", 8).alias("auc"))


@query("scale_features", lambda: S.with_(*ctes_train(), """sp AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM tf),
tr AS (SELECT * FROM sp WHERE rn < floor(n * 0.8))""") + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {S.R(f'avg({c})')} AS mean, {S.R(f'stddev_pop({c})')} AS std FROM tr" for c in FEATURES))
def q_scale_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardisation statistics (mean, population std) fitted on the training rows only."""
    frame, most = train_frame(spark, sf_dir)
    sp = ml.purged_split(frame, most=most).filter(F.col("split") == "train")
    st = ml.scaling_stats(sp, FEATURES)
    return st.select("feature", rnd("mean").alias("mean"), rnd("std").alias("std"))


WIDE = features_wide.columns()


def wide_panel(spark, sf_dir):
    return features_wide.compute(layout(fixtures.bars_calm(spark, sf_dir)))


def windows_df(spark, sf_dir) -> DataFrame:
    return ml.sequence_windows(wide_panel(spark, sf_dir), WIDE, 60, 30)


def _seq_sql() -> str:
    from .q_wide import ctes_wide
    rs = " + ".join(f"(CASE WHEN isnan(CAST({c} AS DOUBLE)) OR isinf(CAST({c} AS DOUBLE)) OR {c} IS NULL THEN 0.0 "
                    f"ELSE CAST({c} AS DOUBLE) END)" for c in WIDE)
    return S.with_(S.ctes_bars_calm(), *ctes_wide("bars_calm"), f"""rsum AS (
  SELECT symbol, ts, rn, c, count(*) OVER (PARTITION BY symbol) AS n, {rs} AS row_sum FROM wide JOIN bars_calm USING (symbol, ts)),
sw AS (SELECT *, sum(row_sum) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS x_sum FROM rsum)""") + (
        f"SELECT symbol, ts, CAST({60 * len(WIDE)} AS BIGINT) AS x_len, {S.R('x_sum', 2)} AS x_sum, {S.R('c')} AS y "
        "FROM sw WHERE rn >= 60 AND rn < n - 30")


@query("sequence_windows", _seq_sql)
def q_sequence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previous 60 bars x 52 features flattened per bar (lengths and checksums), target close."""
    w = windows_df(spark, sf_dir)
    return w.select("symbol", "ts", F.size("x").cast("long").alias("x_len"),
                    rnd(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 2).alias("x_sum"), rnd("y").alias("y"))


def split_frame(spark, sf_dir) -> DataFrame:
    """The split training frame, written once to the shared folder: model fits iterate over it, and its
    features and labels are not computed again per pass."""
    frame, most = train_frame(spark, sf_dir)
    return written(ml.purged_split(frame, most=most).select(*frame.columns, "split"), "split")


def _fit_logistic(spark, sf_dir):
    sp = split_frame(spark, sf_dir)
    train, test = sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "test")
    n = train.count()
    model = ml.logistic(FEATURES, TARGET, n).fit(train)
    return model, train, test, n, sp


@query("logistic_meta")
def q_logistic_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 + M7: L2 logistic meta-model (C = 0.1, 500 iterations) fitted on the pooled training split;
    test metrics per symbol (rows-only check: a fitted model)."""
    model, _, test, _, _ = _fit_logistic(spark, sf_dir)
    scored = ml.probability(model, test).select("symbol", F.col(TARGET).alias("y"), "p")
    return ml.score_metrics(scored, keys=["symbol"])


@query("gbt_meta")
def q_gbt_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: boosted-tree meta-model (depth 4, 150 rounds, step 0.05, min 30 rows per leaf); test metrics."""
    sp = split_frame(spark, sf_dir)
    train, test = sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "test")
    tasks = ml.split_tasks(sp)
    model = ml.boosted_trees(FEATURES, TARGET, deal=lambda rows: ml.dealt_keys(rows, tasks)).fit(train)
    return ml.score_metrics(ml.probability(model, test).select(F.col(TARGET).alias("y"), "p"))


@query("model_registry")
def q_model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 + M9: fit, save and register the model under the shared folder, load the newest version by its
    name and score every bar; one row with the sizes, the test metrics and the number of scored bars."""
    root, sp = scratch_path(spark, "registry"), split_frame(spark, sf_dir)
    row = registry.train_and_save(spark, root, sp, FEATURES, TARGET).first()
    model, newest = registry.load(spark, root, row["name"])
    if model is None:
        return spark.createDataFrame([row], registry.SCHEMA).select("model_type", "version", "train_size", "test_size", "error")
    scored = ml.probability(model, sp).agg(F.count("p").alias("scored_bars"), F.avg("p").alias("mean_p"))
    metrics = json.loads(newest["metrics"])
    return scored.select(F.lit(newest["model_type"]).alias("model_type"), F.lit(newest["version"]).alias("version"),
                         F.lit(newest["train_size"]).alias("train_size"), F.lit(newest["test_size"]).alias("test_size"),
                         *[F.lit(metrics[m]).alias(m) for m in ("auc", "brier", "log_loss")], "scored_bars", "mean_p")


@query("score_bars")
def q_score_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: meta-model probability for every bar with complete features."""
    model, _, _, _, sp = _fit_logistic(spark, sf_dir)
    return ml.probability(model, sp).select("symbol", "ts", "p")


def _windows_split(spark, sf_dir):
    """(panel, scaled training windows, scaled test windows, scale): windows and scale written once, as fits read them often."""
    shared_dir(spark)
    pan = wide_panel(spark, sf_dir)
    train, test = ml.split_windows(ml.sequence_windows(pan, WIDE, 60, 30).checkpoint(eager=True))
    scale = ml.vector_scale(train).checkpoint(eager=True)
    vectors = lambda df: ml.standardised(df, scale).select(array_to_vector("x").alias("features"), "y")
    return pan, vectors(train).checkpoint(eager=True), vectors(test), scale


@query("regressor_ensemble")
def q_regressor_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four regressors on the first 80 % of each symbol's windows; root mean square error of each
    and of the weighted ensemble on the rest (rows-only check: fitted models)."""
    _, train, test, _ = _windows_split(spark, sf_dir)
    return ml.ensemble_rmse(ml.fit_models(train), test)


@query("forecast_steps")
def q_forecast_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30-step forecast per symbol from its last 60 bars, standardised as the training windows (the
    first 80 % per symbol, pooled) and rotated one element per step (closed form), by the weighted ensemble."""
    pan, train, _, scale = _windows_split(spark, sf_dir)
    return ml.forecast(ml.fit_models(train), scale, ml.last_windows(pan, WIDE, 60))


@query("forecast_band", lambda: S.with_(S.ctes_bars_calm(), """lst AS (SELECT symbol, max(ts) AS last_ts, arg_max(c, ts) AS last_close FROM bars_calm GROUP BY symbol),
st AS (SELECT symbol, last_ts, last_close, s AS step, last_close * (1.0 + 0.001 * s) AS pred FROM lst, range(30) t(s))""") + (
    f"SELECT symbol, CAST(step AS BIGINT) AS step, CAST(CAST(last_ts AS DATE) + CAST(step + 1 AS INTEGER) AS TIMESTAMP) AS date, "
    f"{S.R('pred')} AS pred, {S.R('pred * 0.9')} AS lower, {S.R('pred * 1.1')} AS upper, "
    f"{S.R('(pred - last_close) / last_close * 100.0')} AS change_pct, "
    "CASE WHEN pred > last_close THEN 'UP' ELSE 'DOWN' END AS direction FROM st"))
def q_forecast_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast band (dates, +-10 %, change %, direction) on a fixed drift forecast of each symbol's last close."""
    b = fixtures.bars_calm(spark, sf_dir)
    last = b.groupBy("symbol").agg(F.max("ts").alias("last_ts"), F.max_by("c", "ts").alias("last_close"))
    pred = last.select("symbol", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("step"), "last_close").select(
        "symbol", "step", (F.col("last_close") * (F.lit(1.0) + F.lit(0.001) * F.col("step"))).alias("pred"))
    fb = ml.forecast_band(pred, last)
    return fb.select("symbol", F.col("step").cast("long").alias("step"), F.col("date").cast("timestamp_ntz").alias("date"),
                     *[rnd(c).alias(c) for c in ("pred", "lower", "upper", "change_pct")], "direction")


@query("stream_bars", lambda: S.with_(S.ctes_bars_hour()) + (
    "SELECT symbol, ts, " + ", ".join(f"{S.R(c)} AS {c}" for c in ("o", "h", "l", "c", "vwap", "base_score"))
    + ", v FROM bars_hour"))
def q_stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars built by a Structured Streaming job (event-time windows, watermark, update mode,
    foreachBatch sink) over the events landed as files; final state equals the batch bars."""
    src = scratch_path(spark, "stream-src")
    fixtures.table(spark, sf_dir, "events").write.mode("overwrite").parquet(src)
    sink, ckpt = scratch_path(spark, "stream-sink"), scratch_path(spark, "stream-ckpt")
    bars_stream.run(spark, src, sink, ckpt, 60, "2 hours")
    b = bars_stream.current_bars(spark, sink)
    return b.select("symbol", "ts", *[rnd(c).alias(c) for c in ("o", "h", "l", "c", "vwap", "base_score")], "v")


@query("walk_forward_folds", lambda: S.with_(S.ctes_bars_panel(), """bi AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn, CAST(ts AS DATE) AS d FROM bars_panel),
bd AS (SELECT min(d) AS s, max(d) AS e FROM bi),
cal AS (SELECT k AS fold, s + CAST(k * 10 AS INTEGER) AS train_start, s + CAST(k * 10 + 60 AS INTEGER) AS test_start,
               s + CAST(k * 10 + 70 AS INTEGER) AS test_end
        FROM bd, range(0, CAST(floor(((e - s) - 70 + 1) / 10) AS BIGINT) + 1) t(k)),
j AS (SELECT c.fold, b.symbol, b.ts, b.rn, CASE WHEN b.d < c.test_start THEN 'train' ELSE 'test' END AS role
      FROM bi b JOIN cal c ON b.d >= c.train_start AND b.d < c.test_end),
lt AS (SELECT fold, symbol, max(rn) AS last_rn FROM j WHERE role = 'train' GROUP BY fold, symbol),
r AS (SELECT j.fold, CASE WHEN j.role = 'train' AND j.rn > lt.last_rn - 5 THEN 'purge' ELSE j.role END AS role
      FROM j LEFT JOIN lt USING (fold, symbol))""") + "SELECT CAST(fold AS BIGINT) AS fold, role, count(*) AS bars FROM r GROUP BY fold, role")
def q_walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: rolling 60-day train / 10-day test folds with a 5-bar purge; bars per (fold, role)."""
    from .layout import index

    bars = fixtures.bars_panel(spark, sf_dir)
    wf = ml.walk_forward(index(bars), dates=bars.filter("symbol IS NOT NULL"))
    return wf.groupBy(F.col("fold").cast("long").alias("fold"), "role").agg(F.count(F.lit(1)).alias("bars"))


@query("isotonic_calibration")
def q_isotonic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: 3-fold isotonic calibration of the logistic meta-model; test metrics (rows-only: fitted models)."""
    sp = split_frame(spark, sf_dir)
    train, test = sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "test")
    cal = ml.isotonic_calibrated(train, test, FEATURES, TARGET)
    return ml.score_metrics(written(cal.select(F.col(TARGET).alias("y"), "p"), "calibrated"))  # read several times
