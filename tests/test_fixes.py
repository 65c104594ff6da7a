"""Hand-made cases: nearest bar, fill across blocks, timestamps, folds, zero prices, empty KPIs."""

import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F

from sparkbars.operators import analysis, features_core, joins, kpis, ml, normalize
from sparkbars.params import DEFAULT
from sparkbars.plans.layout import index, layout
from sparkbars.sources import files
from tests.helpers import bars, flat

T0 = dt.datetime(2024, 1, 2, 9, 0)


def _nearest(b, trades):
    """Brute force: least distance, ties to the earlier bar."""
    out = {}
    for i, s, t in trades:
        near = min((abs((t - ts).total_seconds()), ts, rn) for sym, ts, rn in b if sym == s) if any(x[0] == s for x in b) else None
        out[i] = near[2] if near else None
    return out


def test_nearest_bar_against_brute_force(spark):
    b = [("A", T0 + dt.timedelta(minutes=37 * i + (i % 3)), i) for i in range(60)] + [("B", T0 + dt.timedelta(days=9), 0)]
    trades = [(i, "A", T0 + dt.timedelta(minutes=11 * i - 200)) for i in range(240)]
    trades += [(500, "B", T0), (501, "B", T0 + dt.timedelta(days=30)), (502, "C", T0), (503, "A", b[7][1]), (504, "A", b[7][1] + (b[8][1] - b[7][1]) / 2)]
    bdf = spark.createDataFrame(b, "symbol string, ts timestamp_ntz, rn long")
    tdf = spark.createDataFrame(trades, "trade_id long, symbol string, ts_open timestamp_ntz")
    for slot in (600, 3600, 86400 * 40):
        got = {r["trade_id"]: r["bar_rn"] for r in joins.nearest_bar(bdf, tdf, slot=slot).collect()}
        assert got == _nearest(b, trades)


def test_bars_of_one_time_keep_an_order(spark):
    rows = [("A", T0, float(p), float(p), float(p), float(p), 1) for p in (3, 1, 2)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, o double, h double, l double, c double, v long")
    for n in (1, 3):
        assert [r["c"] for r in index(df.repartition(n)).orderBy("rn").collect()] == [1.0, 2.0, 3.0]


def test_fill_reaches_over_blocks(spark):
    b = bars(spark, flat(700)).withColumn("base_score", F.when(F.col("ts") == F.lit(dt.datetime(2024, 1, 2, 9, 15)), 0.75))
    for rows in (64, 150, 5000):
        p = replace(DEFAULT, block_rows=rows, halo_back=40, halo_ahead=8)
        got = features_core.compute(layout(b, p), p).core()
        assert got.filter("base_score is null or base_score != 0.75").count() == 0, rows
        assert got.count() == 700


def test_timestamps_with_fractions_and_offsets(spark):
    texts = ["2025-01-15 10:30:00", "2025-01-15T10:30:00.25", "2025-01-15 10:30:00.123456", "2025-01-15T05:00:00Z",
             "2025-01-15T10:30:00+05:30", "2025-01-15 10:30", "2025-01-15", "soon", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["ts"] for r in df.select("i", normalize.parse_ts("t").alias("ts")).orderBy("i").collect()]
    at = dt.datetime(2025, 1, 15, 10, 30)
    assert got == [at, at.replace(microsecond=250000), at.replace(microsecond=123456), at, at, at, dt.datetime(2025, 1, 15), None, None]


def test_exported_csv_reads_back_whole(spark, tmp_path):
    b = bars(spark, flat(30))
    files.write_csv(b.select("symbol", "ts", "o", "h", "l", "c", "v"), str(tmp_path / "out"))
    assert files.read_bars(spark, str(tmp_path / "out")).count() == 30
    raw = spark.createDataFrame([("2025-01-15", 1.0), ("never", 2.0)], "ts string, close double")
    assert normalize.load_counts(raw, "X").first().asDict() == {"rows_read": 2, "rows_kept": 1, "rows_rejected": 1}


def test_folds_of_short_and_long_spans(spark):
    def daily(days):
        rows = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), i) for i in range(days)]
        return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, rn long")

    assert ml.walk_forward(daily(40)).count() == 0
    got = {(r["fold"], r["role"]): r["count"] for r in ml.walk_forward(daily(85)).groupBy("fold", "role").count().collect()}
    assert got == {(f, r): n for f in (0, 1) for r, n in (("train", 55), ("purge", 5), ("test", 10))}


def test_zero_prices_and_empty_kpis(spark):
    rows = flat(60)
    rows[30] = (0.0, 5.0, 0.0, 0.0, 0)
    rows[0] = (0.0, 0.0, 0.0, 0.0, 0)
    got = analysis.advanced_metrics(analysis.bar_inputs(layout(bars(spark, rows))).core()).first()
    assert got["bars"] == 60 and got["price_change_pct"] == float("inf")
    young = analysis.bar_inputs(layout(bars(spark, flat(60)))).core().withColumn("rsi", F.lit(None).cast("double"))
    assert analysis.advanced_metrics(young).first()["rsi"] == 50.0
    none = spark.createDataFrame([], "pnl_pct double, bars_held long")
    row = kpis.trade_kpis(none, []).first().asDict()
    assert set(row.values()) == {0}


def test_trades_file_by_header_name(spark, tmp_path):
    path = tmp_path / "trades.csv"
    path.write_text("ts_open,ts_close,Symbol,side,qty,entry_px,exit_px,tp,sl,base_score,reason,notes\n"
                    '2025-03-04 10:30:00,2025-03-04 11:45:00,ABC,long,100,2500.00,2537.50,,oops,0.75,tp,"a, ""b"""\n')
    [r] = files.read_trades(spark, str(path)).collect()
    assert r.asDict() == dict(trade_id=None, ts_open=dt.datetime(2025, 3, 4, 10, 30), ts_close=dt.datetime(2025, 3, 4, 11, 45),
                              symbol="ABC", side="long", qty=100, entry_px=2500.0, exit_px=2537.5, tp=None, sl=None,
                              base_score=0.75, reason="tp", notes='a, "b"')
