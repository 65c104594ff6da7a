"""Hand-made edge tables: every branch of labels, grid, joins, features, rules, logs, streaming."""

import datetime as dt
import time

from pyspark.sql import functions as F

from sparkbars.operators import analysis, features_core, features_wide, grid, joins, labels, normalize
from sparkbars.params import DEFAULT
from sparkbars.plans.layout import index, layout
from sparkbars.session import scratch_path
from sparkbars.sources import logs
from sparkbars.streaming import bars_stream
from tests.helpers import bars, flat

K = DEFAULT.cost


def _label(spark, rows, side="long"):
    return sorted(labels.triple_barrier(layout(bars(spark, rows)), side).core().collect(), key=lambda r: r.rn)


def test_tp_and_sl_in_same_bar_tp_wins(spark):
    r = _label(spark, [(100, 100, 100, 100, 1), (100, 102, 98, 100, 1)] + flat(3))
    assert r[0].exit_reason == "tp" and r[0].exit_rn == 1
    assert abs(r[0].realized_return - ((100 * (1 + 0.015 - K) - 100) / 100 - K)) < 1e-12


def test_entry_on_last_bar_no_exit(spark):
    r = _label(spark, flat(4))
    assert (r[-1].exit_reason, r[-1].realized_return, r[-1].exit_rn) == ("no_exit", 0.0, 3)


def test_timeout_short_tail_exits_at_last_close(spark):
    r = _label(spark, flat(5))
    assert r[0].exit_reason == "timeout" and r[0].exit_rn == 4
    assert abs(r[0].realized_return + K) < 1e-15


def test_short_mirror(spark):
    r = _label(spark, [(100, 100, 100, 100, 1), (100, 100.5, 98, 99, 1)] + flat(3), side="short")
    assert r[0].exit_reason == "tp"


def test_meta_labels_only_on_signal_bars(spark):
    rows = [(100, 100, 100, 100, 1, 0.9), (100, 102, 99.9, 101, 1, 0.5)] + [(101, 101, 101, 101, 1, 0.0)] * 3
    m = sorted(labels.meta_labels(layout(bars(spark, rows))).core().collect(), key=lambda r: r.rn)
    assert m[0].meta_label == 1 and m[0].exit_reason == "tp"
    assert m[1].exit_reason == "no_signal" and m[1].realized_return == 0.0


def _grid(spark, rows, e, side="long", shifts_only=None):
    b = bars(spark, rows)
    pan = grid.with_forward(features_core.compute(layout(b)))
    core = pan.core()
    n = len(rows)
    t = spark.createDataFrame([(1, "X", side, e, n)], "trade_id long, symbol string, side string, e long, n long")
    return grid.evaluate(grid.entries(t), core, grid.scenarios(spark))


def test_grid_path_runs_out_timeout_at_entry(spark):
    res = _grid(spark, flat(6), 4).filter(F.col("exit_mode") == "tp_sl").collect()
    assert res and all(r.exit_reason == "timeout" and r.bars_held == 0 for r in res)
    assert all(abs(r.pnl_pct + K) < 1e-15 for r in res)


def test_grid_entry_clamp(spark):
    res = _grid(spark, flat(6), 0).select("entry_shift", "entry_idx").distinct().collect()
    got = {r.entry_shift: r.entry_idx for r in res}
    assert got[-2] == 0 and got[3] == 3
    res = _grid(spark, flat(6), 5).select("entry_shift", "entry_idx").distinct().collect()
    assert {r.entry_idx for r in res} <= {3, 4}


def test_grid_tie_keeps_grid_order(spark):
    best = grid.best(_grid(spark, flat(40), 10)).collect()[0]
    assert best.scenario_id == 0


def test_grid_time_exit_and_trailing_ratchet(spark):
    up = [(100 + i, 100.2 + i, 99.9 + i, 100 + i, 1) for i in range(10)] + [(109, 109, 100, 100, 1)] * 5
    res = _grid(spark, up, 2).filter((F.col("entry_shift") == 0) & (F.col("tp_mult") == 1.25) &
                                     (F.col("sl_mult") == 1.25)).collect()
    by_mode = {r.exit_mode: r for r in res}
    assert by_mode["time_8"].exit_reason in ("tp", "time")
    assert by_mode["atr_trail"].exit_reason in ("tp", "sl")


def test_nearest_bar_tie_goes_to_earlier_bar(spark):
    b = index(bars(spark, flat(3), step_min=10))
    t = spark.createDataFrame([(1, "X", dt.datetime(2024, 1, 2, 9, 20)), (2, "X", dt.datetime(2024, 1, 1, 9, 0)),
                               (3, "X", dt.datetime(2024, 1, 9, 9, 0))],
                              "trade_id long, symbol string, ts_open timestamp_ntz")
    got = {r.trade_id: r.bar_rn for r in joins.nearest_bar(b, t).collect()}
    assert got == {1: 0, 2: 0, 3: 2}


def test_two_symbols_do_not_leak(spark):
    a = bars(spark, [(100 + i, 101 + i, 99 + i, 100 + i, 10) for i in range(40)], symbol="A")
    z = bars(spark, [(5, 5, 5, 5, 1)] * 40, symbol="Z")
    f = features_core.compute(layout(a.unionByName(z))).core()
    za = features_core.compute(layout(z)).core()
    cols = ["atr", "realized_vol", "volume_ratio_5"]
    assert f.filter("symbol = 'Z'").orderBy("ts").select(*cols).collect() == za.orderBy("ts").select(*cols).collect()


def test_flat_prices_rsi_nan_becomes_zero_in_features(spark):
    w = features_wide.compute(layout(bars(spark, flat(30)))).core()
    assert {r.rsi_14 for r in w.collect()} <= {0.0, None}


def test_zero_volume_ratios(spark):
    rows = [(1, 1, 1, 1, 0)] * 40
    f = features_core.compute(layout(bars(spark, rows))).core().orderBy("ts").collect()
    assert f[-1].volume_ratio_2 == 0.0  # 0/0 -> NaN -> 0


def test_guards_regime_and_features(spark):
    f = features_core.compute(layout(bars(spark, flat(33)))).core()
    assert f.filter(F.col("atr").isNotNull()).count() == 0
    f = features_core.compute(layout(bars(spark, flat(34)))).core()
    assert f.filter(F.col("atr").isNotNull()).count() > 0


def test_metrics_momentum_nan_rsi_is_not_overbought(spark):
    pan = analysis.bar_inputs(layout(bars(spark, flat(30)))).core()
    m = analysis.advanced_metrics(pan).collect()[0]
    assert m.momentum_state == "NEUTRAL"


def test_bad_integrity_counts(spark):
    rows = [(10, 9, 10, 9.5, 5), (10, 10, 9, 11, 5), (10, 11, 10.5, 10, 5), (-1, 11, 9, 10, 5), (10, 11, 9, 10, 0)]
    r = normalize.integrity(bars(spark, rows)).collect()[0]
    assert (r.high_below_low, r.high_below_close, r.low_above_close, r.negative_prices, r.zero_volume) == (1, 2, 2, 1, 1)
    assert r.valid is False


def test_alias_mix_defaults(spark):
    raw = spark.createDataFrame([("2024-01-02 09:15:00", 10.0, "ABC", 100), ("bad", 11.0, "ABC", 100)],
                                "Time string, ltp double, symbol string, volume long")
    out = normalize.bars(raw).collect()
    assert len(out) == 1 and out[0].o == out[0].h == out[0].l == 10.0 and out[0].symbol == "ABC"
    assert normalize.detect(["Open", "HIGH"], "o") == "Open"
    assert normalize.detect(["opening_range"], "o") is None


def test_log_edges(spark):
    lines = spark.createDataFrame([
        ("Worker[NSE-ABC] starting: entry=272.9 stop_t=266.05 stop_l=266.0 target=279.75",),
        ("2025-11-06 12:23:44,020 INFO Top scanned (symbol,score,ltp,atr%,vwap_dev,vol): "
         "[(\"NSE-R\", 0.132, 40.94, 0.0015, -0.0024, 139), ('NSE-Q', 1.5, 2.0, 0.1, 0.2, 7)]",),
        ("Worker[NSE-X] starting: nothing here",),
        ("random text",),
    ], "value string")
    e = logs.trade_entries(lines).collect()
    assert len(e) == 1 and e[0].timestamp is None and e[0].qty is None and e[0].entry == 272.9
    s = sorted(logs.scanner_rows(lines).collect(), key=lambda r: r.symbol)
    assert [r.symbol for r in s] == ["NSE-Q", "NSE-R"] and s[1].vwap_dev == -0.0024
    t = {r.value[:6]: r.line_type for r in logs.line_types(lines).collect()}
    assert t["2025-1"] == "scan" and t["random"] == "unparsed"


def test_streaming_late_tick_dropped_allowed_tick_updates(spark):
    src, sink, ck = (scratch_path(spark, x) for x in ("st-src", "st-sink", "st-ck"))
    sch = bars_stream.EVENT_SCHEMA

    def ev(i, h, m, v):
        return (i, dt.datetime(2024, 1, 1, h, m), 1, "X", float(v), '{"k": 1}')

    spark.createDataFrame([ev(1, 10, 0, 5), ev(2, 10, 30, 7), ev(3, 12, 30, 1)], sch).coalesce(1).write.mode("append").parquet(src)
    bars_stream.run(spark, src, sink, ck, 60, "1 hour", max_files_per_trigger=1)
    time.sleep(1.1)
    spark.createDataFrame([ev(4, 10, 15, 100), ev(5, 12, 45, 3)], sch).coalesce(1).write.mode("append").parquet(src)
    bars_stream.run(spark, src, sink, ck, 60, "1 hour", max_files_per_trigger=1)
    got = {r.ts.hour: r for r in bars_stream.current_bars(spark, sink).collect()}
    assert got[10].v == 2 and got[10].h == 7.0  # the 10:15 tick arrived after the watermark: dropped
    assert got[12].v == 2 and got[12].c == 3.0  # the 12:45 tick was in time: close updated


def test_auc_mid_ranks_against_pair_count(spark):
    from sparkbars.operators import ml

    rows = [(1.0, 0.9), (0.0, 0.1), (1.0, 0.5), (0.0, 0.5), (0.0, 0.95), (1.0, 0.0001)]
    got = ml.score_metrics(spark.createDataFrame(rows, "y double, p double")).collect()[0].auc
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    brute = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(got - brute) < 1e-12
