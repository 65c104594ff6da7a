"""The split computes its frame once; folds are told from the bars to come."""

import datetime as dt
import random

from pyspark.sql import functions as F

from sparkbars.operators import ml
from sparkbars.params import Params


def test_frame_is_computed_once(spark):
    rows = [("AB"[i % 2], dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(80)]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def keep(x):
        seen.add(1)
        return True

    frame = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double").filter(keep("x"))
    got = {(r.symbol, r.split): r["count"] for r in ml.purged_split(frame).groupBy("symbol", "split").count().collect()}
    assert got == {(s, k): n for s in "AB" for k, n in (("train", 32), ("purge", 5), ("test", 3))}
    assert seen.value == len(rows)


def _bars(spark):
    r = random.Random(4)
    rows = []
    for s, step in (("A", 1), ("B", 3), ("C", 40)):  # C has fewer bars in a window than are purged
        days = sorted(r.sample(range(0, 200, step), min(90, 200 // step)) + ([7, 7, 66] if s == "A" else []))
        rows += [(s, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), k) for k, d in enumerate(days)]
    rows.append(("A", dt.datetime(2024, 1, 1) + dt.timedelta(days=250), 93))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, rn long"), rows


def test_folds_against_brute_force(spark, monkeypatch):
    df, rows = _bars(spark)
    day0 = min(t for _, t, _ in rows)
    want = []
    for fold in range(((max(t for _, t, _ in rows) - day0).days - 70 + 1) // 10 + 1):
        at = {k: [(s, t, rn) for s, t, rn in rows if lo <= (t - day0).days - 10 * fold < hi] for k, lo, hi in (("train", 0, 60), ("test", 60, 70))}
        last = {s: max(rn for x, _, rn in at["train"] if x == s) for s, _, _ in at["train"]}
        want += [(fold, s, t, "purge" if rn > last[s] - 5 else "train") for s, t, rn in at["train"]]
        want += [(fold, s, t, "test") for s, t, _ in at["test"]]
    for block in (65536, 16, 3):
        monkeypatch.setattr(ml, "DEFAULT", Params(block_rows=block))
        wf = ml.walk_forward(df.repartition(4))
        assert sorted(tuple(r) for r in wf.collect()) == sorted(want)
    plan = wf._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # copies of bars in folds are not shuffled
