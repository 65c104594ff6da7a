"""Model data preparation, metrics, fitting and forecasting with MLlib.

Data preparation (training frame, purged split, sequence windows, scaling
statistics, metrics) is DataFrame code; fitting is one distributed MLlib fit
pooled over all symbols (symbol statistics can enter as features), not one
local model per symbol."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import finite_or_zero
from ..params import DEFAULT
from ..plans.layout import TASK_ROWS, Panel, day_block, index, numbered
from ..session import written
from .boost import HistClassifier, HistTrees

EPS = 1e-15
AUC_BUCKETS = 4096


def training_frame(featured: DataFrame, features: list[str], target: str = "meta_label") -> DataFrame:
    """symbol, ts, features, target; rows with any null dropped.

    Columns that cannot be null are not looked at: the condition goes below their expressions, which would be computed twice."""
    frame = featured.select("symbol", "ts", *features, target)
    return frame.dropna(subset=[f.name for f in frame.schema.fields if f.nullable or f.dataType.typeName() in ("float", "double")])


def purged_split(frame: DataFrame, train_frac: float = 0.8, purge: int = 5, most: int | None = None) -> DataFrame:
    """Per symbol, on the cleaned frame: first floor(frac*n) rows 'train', next ``purge`` rows
    'purge', the rest 'test'.

    ``most``: rows that no symbol exceeds, if that is known. Where one task takes them, they are numbered where they lie
    and nothing is written. Otherwise indexing uses the skew-safe per-(symbol, day) numbering, which reads its input
    twice: the frame is written once to the shared folder, so that its features are computed once."""
    if most is not None and most <= DEFAULT.block_rows:
        idx = numbered(frame)
    else:
        frame = written(frame, "frame")
        # narrow rows compress well, so tasks are dealt by rows: by bytes, few would get most
        idx = index(frame, tasks=split_tasks(frame))
    cut = F.floor(F.col("n") * F.lit(train_frac))
    split = (F.when(F.col("rn") < cut, F.lit("train"))
             .when(F.col("rn") < cut + purge, F.lit("purge")).otherwise(F.lit("test")))
    return idx.withColumn("split", split)


def split_tasks(frame: DataFrame) -> int:
    """Tasks for the rows of a frame, counted."""
    return max(frame.sparkSession.sparkContext.defaultParallelism, -(-frame.count() // TASK_ROWS))


def dealt_keys(rows: DataFrame, tasks: int, key: str = "symbol", order: str = "ts") -> DataFrame:
    """The rows' keys by (key, day) and in order, as ``index`` deals rows into ``tasks``: places that do not depend on how rows are stored."""
    day = day_block(order)
    return rows.select(key, order, day.alias("_tb")).repartition(tasks, key, "_tb").sortWithinPartitions(key, "_tb", order).select(key, order)


def score_metrics(scored: DataFrame, y: str = "y", p: str = "p", keys: list[str] | None = None) -> DataFrame:
    """AUC (mid-rank Mann-Whitney), Brier score and log loss (p clipped to [1e-15, 1-1e-15]).

    AUC is computed from per-(keys, p) positive/negative counts: ties share a
    mid rank, and only the distinct scores are ordered (never the rows)."""
    keys = keys or []
    yv, pv = F.col(y).cast("double"), F.col(p).cast("double")
    pc = F.least(F.greatest(pv, F.lit(EPS)), F.lit(1 - EPS))
    base = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg((pv - yv) * (pv - yv)).alias("brier"),
        (-F.avg(yv * F.ln(pc) + (F.lit(1.0) - yv) * F.ln(F.lit(1.0) - pc))).alias("log_loss"),
    )
    g = scored.groupBy(*keys, pv.alias("_p")).agg(F.sum(yv).alias("_pos"), F.sum(F.lit(1.0) - yv).alias("_neg"))
    # negatives below each distinct score, two-level: inside score buckets, plus bucket offsets
    # (a table of at most AUC_BUCKETS rows per group), so no window spans all distinct scores
    g = g.withColumn("_b", F.least(F.greatest(F.floor(F.col("_p") * AUC_BUCKETS), F.lit(0)),
                                   F.lit(AUC_BUCKETS - 1)).cast("int"))
    tot = g.groupBy(*keys, "_b").agg(F.sum("_neg").alias("_bneg"))
    bw = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*keys, "_b", F.coalesce(F.sum("_bneg").over(bw), F.lit(0.0)).alias("_off"))
    w = Window.partitionBy(*keys, "_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_in_b", F.coalesce(F.sum("_neg").over(w), F.lit(0.0))).join(offs, [*keys, "_b"])
    g = g.withColumn("_neg_below", F.col("_off") + F.col("_in_b"))
    auc = g.groupBy(*keys).agg(
        (F.sum(F.col("_pos") * (F.col("_neg_below") + F.lit(0.5) * F.col("_neg"))) /
         (F.sum("_pos") * F.sum("_neg"))).alias("auc"))
    return base.join(auc, keys) if keys else base.crossJoin(auc)


def sequence_windows(panel: Panel, features: list[str], lookback: int = 60, horizon_skip: int = 30,
                     target: str = "c") -> DataFrame:
    """X = the previous ``lookback`` bars' features flattened (NaN/inf -> 0), y = target at the bar,
    for bars with lookback <= rn < n - horizon_skip. Exact over blocks thanks to the halo."""
    assert lookback <= panel.params.halo_back
    row = F.array(*[finite_or_zero(c) for c in features])
    prev = panel.w.rowsBetween(-lookback, -1)
    df = panel.df.withColumn("x", F.flatten(F.collect_list(row).over(prev)))
    df = panel.with_df(df).core()
    keep = (F.col("rn") >= lookback) & (F.col("rn") < F.col("n") - horizon_skip)
    return df.filter(keep).select("symbol", "ts", "rn", "n", "x", F.col(target).alias("y"))


def last_windows(panel: Panel, features: list[str], lookback: int = 60) -> DataFrame:
    """Forecast input: x = the features of each symbol's last ``lookback`` bars flattened (NaN/inf -> 0);
    symbols with fewer bars have none."""
    assert lookback <= panel.params.halo_back
    row = F.array(*[finite_or_zero(c) for c in features])
    df = panel.df.withColumn("x", F.flatten(F.collect_list(row).over(panel.w.rowsBetween(1 - lookback, 0))))
    last = (F.col("rn") == F.col("n") - 1) & (F.col("n") >= lookback)
    return panel.with_df(df).core().filter(last).select("symbol", "ts", "x")


def split_windows(windows: DataFrame, train_frac: float = 0.8, lookback: int = 60, horizon_skip: int = 30):
    """(train, test): per symbol the first floor(frac*m) of its m windows, and the rest."""
    first = F.col("rn") - lookback < F.floor((F.col("n") - lookback - horizon_skip) * F.lit(train_frac))
    return windows.filter(first), windows.filter(~first)


def vector_scale(train: DataFrame, x: str = "x") -> DataFrame:
    """One row: ``mean`` and ``scale`` (population standard deviation, 1 for a constant) of every element of x."""
    s = train.select(array_to_vector(x).alias("v")).select(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s"))
    s = s.select(vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("var"), F.col("s.count").alias("n"))
    n, eps = F.col("n").cast("double"), 2.0 ** -52

    def scale(mean, var):
        pop = var * (n - 1) / n
        constant = pop <= n * eps * pop + F.pow(n * mean * eps, F.lit(2.0))
        return F.when(constant, F.lit(1.0)).otherwise(F.sqrt(pop))

    return s.select("mean", F.zip_with("mean", "var", scale).alias("scale"))


def standardised(df: DataFrame, scale: DataFrame, x: str = "x") -> DataFrame:
    """``df`` with every element of x less the mean, over the scale, of the training windows."""
    z = F.zip_with(F.zip_with(x, "mean", lambda a, m: a - m), "scale", lambda a, s: a / s)
    return df.crossJoin(F.broadcast(scale)).withColumn(x, z).drop("mean", "scale")


def scaling_stats(train: DataFrame, features: list[str]) -> DataFrame:
    """Mean and population standard deviation of each feature on the training rows (long table)."""
    aggs = []
    for c in features:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    wide = train.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__mean").alias("mean"),
                              F.col(f"{c}__std").alias("std")) for c in features])
    return wide.select(F.explode(rows).alias("s")).select("s.*")


def logistic(features: list[str], label: str, n_train: int, C: float = 0.1, max_iter: int = 500,
             tol: float = 1e-4) -> Pipeline:
    """L2 logistic regression with sklearn's C: regParam = 1 / (C * n), no standardisation,
    sklearn's default convergence tolerance."""
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    lr = LogisticRegression(labelCol=label, featuresCol="features", regParam=1.0 / (C * max(n_train, 1)),
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol)
    return Pipeline(stages=[asm, lr])


def boosted_trees(features: list[str], label: str, rounds: int = 150, deal: Callable[[DataFrame], DataFrame] | None = None) -> Pipeline:
    """Gradient-boosted trees: depth 4, 150 rounds, step 0.05, at least 30 rows per leaf.

    The rules are those of MLlib's ``GBTClassifier``, which takes several times as long over many rows. ``deal``: see
    ``HistClassifier``."""
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    return Pipeline(stages=[asm, HistClassifier(labelCol=label, featuresCol="features", depth=4, rounds=rounds, rate=0.05, least=30, deal=deal)])


def rounds_kept(losses: list[float], patience: int = 50) -> int:
    """Rounds up to the lowest loss (the first of equal ones) that is seen before ``patience`` rounds
    bring no lower one. Without losses, or where none is a number: all rounds."""
    best = None
    for i, loss in enumerate(losses):
        if best is not None and i - best > patience:
            break
        if loss == loss and (best is None or loss < losses[best]):
            best = i
    return len(losses) if best is None else best + 1


def fit_boosted(train: DataFrame, valid: DataFrame, features: list[str], label: str, rounds: int = 150,
                patience: int = 50) -> PipelineModel:
    """``boosted_trees`` stopped early: the loss on ``valid`` after each round tells how many rounds are kept.

    The kept model is fitted with that number of rounds, which makes the same trees again. Without rows in
    ``valid`` all rounds are kept."""
    model = boosted_trees(features, label, rounds).fit(train)
    seen = model.stages[0].transform(valid)
    if seen.isEmpty():
        return model
    kept = rounds_kept(model.stages[1].evaluateEachIteration(seen), patience)
    return model if kept == rounds else boosted_trees(features, label, kept).fit(train)


def probability(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Model probability of the positive class per row."""
    return model.transform(df).withColumn("p", vector_to_array("probability")[1])


# Regressor ensemble weights and settings.
ENSEMBLE = [
    ("gbm", 0.4, lambda: HistTrees(rounds=200, rate=0.05, depth=7, leaves=31, least=20)),
    ("gb", 0.3, lambda: HistTrees(rounds=150, rate=0.1, depth=5)),
    ("rf", 0.2, lambda: HistTrees(rounds=100, depth=10, seed=42)),
    ("ridge", 0.1, None),  # made by ridge() from the number of rows
]


def ridge(n: int, alpha: float = 1.0) -> LinearRegression:
    """Penalty ``alpha`` on the sum of squares of ``n`` rows: the loss here is their mean."""
    return LinearRegression(regParam=alpha / max(n, 1), elasticNetParam=0.0, standardization=False)


def fit_models(train: DataFrame, x: str = "features", y: str = "y") -> dict:
    """The four fitted regressors by name, fitted side by side; each reads its input many times, so ``train`` should be checkpointed."""
    def fit(name, make):
        return (make() if make else ridge(train.count())).setFeaturesCol(x).setLabelCol(y).setPredictionCol(f"pred_{name}").fit(train)

    with ThreadPoolExecutor(len(ENSEMBLE)) as pool:
        running = {name: pool.submit(fit, name, make) for name, _, make in ENSEMBLE}
        return {name: f.result() for name, f in running.items()}


def predict_ensemble(models: dict, df: DataFrame) -> DataFrame:
    """``df`` plus pred_<name> of each regressor and their weighted sum ``pred``."""
    for m in models.values():
        df = m.transform(df)
    return df.withColumn("pred", sum(F.col(f"pred_{n}") * F.lit(w) for n, w, _ in ENSEMBLE))


def ensemble_rmse(models: dict, test: DataFrame, y: str = "y") -> DataFrame:
    """model, weight, rmse, rows: root mean square error on ``test`` of each regressor and of their weighted sum."""
    pred = predict_ensemble(models, test)
    names = [(n, w, f"pred_{n}") for n, w, _ in ENSEMBLE] + [("ensemble", sum(w for _, w, _ in ENSEMBLE), "pred")]
    sums = pred.agg(F.count("*").alias("rows"), *[F.sqrt(F.avg(F.pow(F.col(c) - F.col(y), 2))).alias(n) for n, _, c in names])
    each = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(round(w, 10)).alias("weight"), F.col(n).alias("rmse")) for n, w, _ in names])
    return sums.select(F.explode(each).alias("m"), "rows").select("m.*", "rows")


def rotations(vectors: DataFrame, steps: int, x: str = "x") -> DataFrame:
    """Forecast inputs: the flat vector rotated left by k elements for k = 0..steps-1 (closed form
    of repeatedly dropping the first element and appending it)."""
    ks = F.sequence(F.lit(0), F.lit(steps - 1))
    df = vectors.withColumn("step", F.explode(ks))
    n = F.size(x)
    rot = F.concat(F.slice(x, F.col("step") % n + 1, n), F.slice(x, F.lit(1), F.col("step") % n))
    return df.withColumn(x, F.when(F.col("step") % n == 0, F.col(x)).otherwise(rot))


def forecast(models: dict, scale: DataFrame, last: DataFrame, steps: int = 30) -> DataFrame:
    """symbol, step, pred: the ensemble on each symbol's last window, standardised, then rotated by ``step`` elements."""
    rot = rotations(standardised(last, scale).select("symbol", "x"), steps)
    return predict_ensemble(models, rot.withColumn("features", array_to_vector("x"))).select("symbol", "step", "pred")


def forecast_band(pred: DataFrame, last: DataFrame, band: float = 0.10) -> DataFrame:
    """Forecast dates (last date + step + 1 days), +-band bounds, change % vs last close, direction.

    ``pred``: symbol, step, pred; ``last``: symbol, last_ts, last_close."""
    j = pred.join(last, "symbol")
    return j.select(
        "symbol", "step",
        F.date_add(F.to_date("last_ts"), F.col("step") + 1).alias("date"),
        "pred",
        (F.col("pred") * F.lit(1 - band)).alias("lower"),
        (F.col("pred") * F.lit(1 + band)).alias("upper"),
        ((F.col("pred") - F.col("last_close")) / F.col("last_close") * F.lit(100.0)).alias("change_pct"),
        F.when(F.col("pred") > F.col("last_close"), F.lit("UP")).otherwise(F.lit("DOWN")).alias("direction"),
    )


def walk_forward(bars_idx: DataFrame, train_days: int = 60, test_days: int = 10, purge: int = 5, dates: DataFrame | None = None) -> DataFrame:
    """Rolling folds over the data's date range: fold k trains on [start + k*test_days, +train_days)
    and tests on the next ``test_days``; the last ``purge`` bars of each symbol's training window
    are purged (their labels look into the test window). A bar's folds follow from its day by
    arithmetic; a span too short for one fold has none. Returns (fold, symbol, ts, role).

    A training bar is among the last ``purge`` if the bar ``purge`` places on lies beyond the training window,
    so one ``lead`` over blocks of a symbol's bars tells it for all folds, before the bars are copied to them.
    ``dates``: a frame with the same ``ts``, if reading it is cheaper than reading the numbered bars."""
    d = F.to_date("ts")
    start, end = (bars_idx if dates is None else dates).agg(F.min(d), F.max(d)).first()
    folds = ((end - start).days - (train_days + test_days) + 1) // test_days if start else -1
    block, rn = F.lit(DEFAULT.block_rows), F.col("rn")
    own = F.floor(rn / block)
    b = bars_idx.select("symbol", "ts", "rn", F.datediff(d, F.lit(start)).alias("_day"))
    # the first bars of a block go with the block before it, too, which sees them as its bars to come
    b = b.withColumn("_blk", F.explode(F.sequence(F.greatest(F.floor((rn - purge) / block), F.lit(0)), own)))
    b = b.withColumn("_ahead", F.lead("_day", purge).over(Window.partitionBy("symbol", "_blk").orderBy("rn"))).filter(F.col("_blk") == own)
    day = F.col("_day")
    first = F.greatest(F.floor((day - train_days - test_days) / test_days) + 1, F.lit(0)).cast("int")
    last = F.least(F.floor(day / test_days), F.lit(folds)).cast("int")
    j = b.filter(first <= last).withColumn("fold", F.explode(F.sequence(first, last)))
    test_start = F.col("fold") * test_days + train_days
    role = (F.when(day >= test_start, F.lit("test"))
            .when(F.col("_ahead").isNull() | (F.col("_ahead") >= test_start), F.lit("purge")).otherwise(F.lit("train")))
    return j.select("fold", "symbol", "ts", role.alias("role"))


def isotonic_calibrated(train: DataFrame, test: DataFrame, features: list[str], label: str, folds: int = 3,
                        keys: tuple = ("symbol", "ts")) -> DataFrame:
    """Calibrated probabilities on ``test``: for each of ``folds`` held-out folds (by a hash of the
    row key), fit the logistic model on the other folds and an isotonic map on the held-out fold's
    probabilities; the test probability is the average of the fold models' calibrated outputs.

    The models score each test row one after another in one pass, so their outputs are not joined by key."""
    from pyspark.ml.regression import IsotonicRegression

    f = train.withColumn("_fold", F.pmod(F.xxhash64(*keys), F.lit(folds)))
    out = test.select(*keys, label, *[c for c in features if c not in (*keys, label)])
    for k in range(folds):  # a fixed number of folds (parameter), not a loop over data
        fit_part, cal_part = f.filter(F.col("_fold") != k), f.filter(F.col("_fold") == k)
        base = logistic(features, label, fit_part.count()).fit(fit_part)
        iso = IsotonicRegression(featuresCol="p", labelCol=label, predictionCol="p_cal").fit(
            probability(base, cal_part).select("p", F.col(label).cast("double").alias(label)))
        out = iso.transform(probability(base, out).select(*out.columns, "p")).select(*out.columns, F.col("p_cal").alias(f"p{k}"))
    parts = [f"p{k}" for k in range(folds)]
    return out.select(*keys, label, *parts).withColumn("p", sum(F.col(c) for c in parts) / F.lit(float(folds)))
