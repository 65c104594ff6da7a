"""Histories that fit a task: rows dealt by symbol once, numbered where they lie, little left on disk."""

import datetime as dt
import glob
import os
import random
import time

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sparkbars.operators import boost, features_core, ml
from sparkbars.plans import layout as lay
from sparkbars.plans import q_io, q_ml
from sparkbars.session import shared_dir, shuffles_removed
from sparkbars.sources import fixtures

LINE = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_shipdate timestamp_ntz")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Six suppliers and rows without one, some rows twice, some without a date."""
    r, rows = random.Random(7), []
    for i in range(2400):
        day = None if r.random() < 0.01 else dt.datetime(2024, 1, 1) + dt.timedelta(days=r.randrange(300))
        rows.append((i // 3, r.randrange(50), None if r.random() < 0.02 else r.choice([1, 2, 3, 4, 5, 5]), i % 3,
                     float(r.randrange(1, 50)), r.uniform(900, 90000), r.randrange(11) / 100, day))
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows + rows[:200], LINE).write.parquet(f"{d}/lineitem.parquet")
    return d


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def _final(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_same_bars_and_numbers_by_both_ways(spark, sf_dir, monkeypatch):
    bars = fixtures.bars_panel(spark, sf_dir)
    dealt, most = fixtures.panel_histories(spark, sf_dir)
    assert most >= 300
    want = lay.index(bars)
    assert _rows(lay.numbered(dealt)) == _rows(want) == _rows(lay.numbered(bars))
    monkeypatch.setattr(fixtures, "HISTORY_ROWS", 10)  # rows of a hot symbol are summed before they meet
    hot, exact = fixtures.panel_histories(spark, sf_dir)
    assert exact == bars.filter("symbol IS NOT NULL").groupBy("symbol").count().agg(F.max("count")).first()[0] <= most
    assert _rows(lay.numbered(hot)) == _rows(want)


def test_bars_of_one_time_and_without_time(spark):
    rows = [("A", t, float(p), 1) for t, p in ((None, 9), (dt.datetime(2024, 1, 1), 3), (dt.datetime(2024, 1, 1), 1), (dt.datetime(2024, 1, 2), 2))]
    df = spark.createDataFrame([*rows, (None, dt.datetime(2024, 1, 1), 5.0, 1)], "symbol string, ts timestamp_ntz, c double, v long")
    assert _rows(lay.numbered(df)) == _rows(lay.index(df))
    assert [(r.c, r.rn, r.n) for r in lay.numbered(df).orderBy("rn").collect()] == [(1.0, 1, 4), (3.0, 2, 4), (2.0, 3, 4)]


def test_distinct_times_need_no_order_of_their_own(spark, sf_dir):
    bars, most = fixtures.panel_histories(spark, sf_dir)
    one, other = (features_core.compute(lay.layout(bars, most=most, distinct=d)).core() for d in (True, False))
    blocks = features_core.compute(lay.layout(fixtures.bars_panel(spark, sf_dir))).core()
    assert _rows(one) == _rows(other) == _rows(blocks)


def test_split_and_scale_move_rows_once(spark, sf_dir):
    frame, most = q_ml.train_frame(spark, sf_dir)
    split = ml.purged_split(frame, most=most)
    whole = ml.purged_split(frame)
    assert _rows(split) == _rows(whole)
    files = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/*"))
    plan = _final(ml.purged_split(q_ml.train_frame(spark, sf_dir)[0], most=most).filter("split = 'train'"))
    assert plan.count("+- Exchange") == 1 and plan.count("FileScan") == 1 and "Join" not in plan
    assert plan.count(" Sort [") == 1  # of the rows, by symbol and time; bars stay in that order
    assert len(q_ml.q_scale_features(spark, sf_dir).collect()) == len(q_ml.FEATURES)
    assert set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/*")) == files  # nothing written


def _shuffled(spark, before=(), most=0):
    """Shuffle files on disk but those of ``before``; waits for their removal, which is not part of the action, until they have ``most`` bytes."""
    dirs = [d.getPath() for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    for _ in range(100):
        found = {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")} - set(before)
        if sum(os.path.getsize(f) for f in found if os.path.exists(f)) <= most:
            break
        time.sleep(0.1)
    return found


def test_split_frame_is_a_table_and_leaves_no_shuffle(spark, sf_dir):
    before = _shuffled(spark, most=1 << 60)
    sp = q_ml.split_frame(spark, sf_dir)
    left = _shuffled(spark, before, 20_000)
    assert sum(os.path.getsize(f) for f in left if os.path.exists(f)) <= 20_000  # of the count of rows a symbol; none of the split's rows
    assert sp.inputFiles() and "Scan ExistingRDD" not in _final(sp)  # a checkpoint has whole rows, a table is read by column
    assert sp.columns == ["symbol", "ts", *q_ml.FEATURES, q_ml.TARGET, "split"]


def test_shuffles_are_removed_and_the_setting_kept(spark, tmp_path):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = _shuffled(spark, most=1 << 60), spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), shuffles_removed(spark):
        spark.range(100).repartition(3, "id").write.parquet(str(tmp_path / "t"))
        assert not _shuffled(spark, before)
        1 / 0
    assert spark.conf.get(key) == was


def test_frame_drops_nulls_and_nans_without_a_second_label(spark):
    df = spark.createDataFrame([("A", 1, 1.0), ("A", 2, None), ("A", 3, float("nan")), (None, 4, 1.0)], "symbol string, ts int, x double")
    df = df.withColumn("y", F.when(F.col("ts") > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")).withColumn("z", F.lit(float("nan")))
    assert [r.ts for r in ml.training_frame(df, ["x"], "y").collect()] == [1]
    assert ml.training_frame(df, ["z"], "y").count() == 0  # never null, but no number
    assert ml.training_frame(df, ["x"], "y")._jdf.queryExecution().analyzed().toString().count("atleastnnonnulls(3") == 1


def test_window_functions_are_planned_once(spark, sf_dir):
    bars, most = fixtures.panel_histories(spark, sf_dir)
    text = features_core.compute(lay.layout(bars, most=most)).df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("lag(vwap#") == 1 and text.count("lag(c#") == 1


def test_export_is_packed_and_not_joined(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(q_io, "scratch_path", lambda *_: str(tmp_path / "export"))
    out = q_io.q_export_bars(spark, sf_dir)
    want = fixtures.bars_panel(spark, sf_dir).filter("symbol IS NOT NULL AND ts IS NOT NULL").select("symbol", "ts")
    assert _rows(out.select("symbol", "ts")) == _rows(want) and out.filter("regime IS NULL").count() == 0
    plan = _final(out)
    assert "Join" not in plan and "Exchange" not in plan
    parts = [f for f in os.listdir(tmp_path / "export") if f.startswith("part-")]
    assert parts and all(f.endswith(".csv.gz") for f in parts)


def test_calibrated_rows_are_not_joined(spark):
    r = random.Random(3)
    rows = [("S", i, x := r.gauss(0, 1), int(x + r.gauss(0, 1) > 0)) for i in range(300)]
    train = spark.createDataFrame(rows, "symbol string, ts int, a double, y int")
    test = spark.createDataFrame([("S", 1, 0.5, 1), ("S", 1, -0.5, 0), (None, 2, 0.1, 1)], train.schema)
    got = ml.isotonic_calibrated(train, test, ["a"], "y")
    assert got.columns == ["symbol", "ts", "y", "p0", "p1", "p2", "p"]
    assert got.count() == 3 and all(abs(x.p - (x.p0 + x.p1 + x.p2) / 3) < 1e-12 for x in got.collect())  # a row each, two of one key
    assert "Join" not in _final(got)


def test_bins_do_not_depend_on_how_rows_are_stored(spark, monkeypatch):
    monkeypatch.setattr(boost, "BIN_ROWS", 100)
    r = random.Random(5)
    rows = [(f"S{i % 7}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), r.gauss(0, 1)) for i in range(1500)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, a double").withColumn("y", (F.col("a") > 0.3).cast("int"))
    df = df.withColumn("features", array_to_vector(F.array("a")))
    dealt = boost.HistClassifier(labelCol="y", rounds=1, deal=lambda x: ml.dealt_keys(x, 6))
    one, two = (dealt._ends(df.repartition(n), 32, 1500).tolist() for n in (1, 9))
    assert one == two
    # as drawn from the rows themselves where they lie as ``index`` deals them
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lie = lay.index(df, tasks=6).checkpoint()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert boost.HistClassifier(labelCol="y", rounds=1)._ends(lie, 32, 1500).tolist() == one


def test_only_the_last_checkpoint_stays(spark, monkeypatch):
    monkeypatch.setattr(boost, "_NEW", 1)
    monkeypatch.setattr(boost, "_KEEP", 2)
    kept, forget = [], boost._forget
    monkeypatch.setattr(boost, "_forget", lambda rdd, path: (forget(rdd, path), path and kept.append(path.removeprefix("file:"))))
    r = random.Random(6)
    df = spark.createDataFrame([(x := r.gauss(0, 1), int(x + r.gauss(0, 1) > 0)) for _ in range(400)], "a double, y int")
    model = ml.boosted_trees(["a"], "y", 9).fit(df)
    assert len(model.stages[1].trees) == 9
    assert len(kept) == 4 and not any(os.path.exists(p) for p in kept)
