"""Review files by date and the marks of trades: rewritten days, days read alone, missing lines."""

import datetime as dt

from sparkbars.operators.grid import best_policy_of
from sparkbars.operators.joins import trade_marks
from sparkbars.sources import files

SCHEMA = "ts timestamp_ntz, symbol string, c double, exit_reason string"


def _rows(spark, days, c):
    at = [dt.datetime(2024, 3, d, 9, 15, 0, 250) for d in days]
    return spark.createDataFrame([(t, s, c, 'say "x, y"') for t in at for s in ("A", "B")], SCHEMA)


def test_a_rewritten_day_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "review")
    files.write_review(_rows(spark, [1, 2, 3], 1.5), path)
    files.write_review(_rows(spark, [2], 2.5), path)
    files.write_review(_rows(spark, [2], 2.5), path)
    back = files.read_review(spark, path, _rows(spark, [], 0.0).schema)
    got = sorted((r.review_date, r.symbol, r.c) for r in back.collect())
    assert got == [(f"2024-03-0{d}", s, 2.5 if d == 2 else 1.5) for d in (1, 2, 3) for s in ("A", "B")]
    assert {(r.ts, r.exit_reason) for r in back.filter("symbol = 'A'").collect()} == {
        (dt.datetime(2024, 3, d, 9, 15, 0, 250), 'say "x, y"') for d in (1, 2, 3)}
    one = files.read_review(spark, path, _rows(spark, [], 0.0).schema, ["2024-03-03"])
    assert one.count() == 2 and "PartitionFilters: [isnotnull(review_date" in one._jdf.queryExecution().executedPlan().toString()


def test_marks(spark):
    t = dt.datetime(2024, 3, 1, 9, 15)
    df = spark.createDataFrame([(1, "A", t, 10.0, 11.0, 9.0), (2, "A", t, 10.0, None, 0.0), (3, "B", None, 10.0, 11.0, 9.0),
                                (4, "B", t, None, 0.0, 9.0)],
                               "trade_id long, symbol string, bar_ts timestamp_ntz, entry_px double, tp double, sl double")
    got = sorted(trade_marks(df).collect(), key=lambda r: (r.trade_id, r.kind))
    assert [(r.trade_id, r.kind, r.ts, r.price) for r in got] == [
        (1, "entry", t, 10.0), (1, "stop", None, 9.0), (1, "target", None, 11.0), (2, "entry", t, 10.0),
        (4, "entry", t, None), (4, "stop", None, 9.0)]
    assert trade_marks(df.limit(0)).count() == 0


def test_best_policy_by_mean_ties_to_the_first(spark):
    rows = [("A", t, s, "tp_sl", 0, 1.0, 1.0, pnl) for t, s, pnl in
            [(1, 0, 0.1), (2, 0, 0.2), (3, 0, 0.3), (1, 1, 0.3), (2, 1, 0.2), (3, 1, 0.1), (1, 2, 0.5), (2, 2, 0.0), (3, 2, 0.0)]]
    rows += [("B", 4, 7, "time_5", 1, 2.0, 0.5, -0.5), ("B", 4, 5, "time_5", 1, 2.0, 0.5, -0.5)]
    df = spark.createDataFrame(rows, "symbol string, trade_id long, scenario_id long, exit_mode string, entry_shift int, "
                                     "tp_mult double, sl_mult double, pnl_pct double")
    got = sorted((r.symbol, r.scenario_id, r.mean_pnl, r.trades) for r in best_policy_of(df.repartition(5), "symbol").collect())
    assert got == [("A", 0, 0.2, 3), ("B", 5, -0.5, 1)]
    assert best_policy_of(df.limit(0), "symbol").count() == 0
