"""Queries: sources and sinks (round trips through files under the shared
folder), normalisation and data quality, logs, resampling, slices, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import normalize, resample
from ..params import DEFAULT, DURATION_LIMITS
from ..session import scratch_path, shuffles_removed
from ..sources import files, fixtures, logs
from . import sqlparts as S
from .layout import index
from .registry import query

BAR_D = ["o", "h", "l", "c", "vwap"]


def _bars_out(df: DataFrame, *more: str) -> DataFrame:
    return df.select("symbol", "ts", *[rnd(c).alias(c) for c in BAR_D], F.col("v").cast("long").alias("v"), *more)


def _bars_sql(src: str, symbol: str = "symbol", ts: str = "ts") -> str:
    return (f"SELECT {symbol} AS symbol, {ts} AS ts, " + ", ".join(f"{S.R(c)} AS {c}" for c in BAR_D)
            + f", CAST(v AS BIGINT) AS v FROM {src}")


# ------------------------------------------------------------------ sources

@query("src_csv_bars", lambda: S.with_(S.ctes_bars_calm()) + _bars_sql("bars_calm", "upper(replace(symbol, '_', '-'))"))
def q_src_csv_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + S5 + P1/P2: bars written as CSV with capitalised headers (Time, Open, High, Low, ltp, vol),
    one directory per symbol, read back as text and normalised; symbol taken from the path."""
    path = scratch_path(spark, "csv-bars")
    b = fixtures.bars_calm(spark, sf_dir)
    out = b.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Time"), F.col("o").alias("Open"),
                   F.col("h").alias("High"), F.col("l").alias("Low"), F.col("c").alias("ltp"),
                   F.col("v").alias("vol"))
    files.write_csv(out, path, ["symbol"])
    return _bars_out(files.read_bars(spark, path, "csv"))


@query("src_parquet_bars", lambda: S.with_(S.ctes_bars_panel()) + _bars_sql("bars_panel"))
def q_src_parquet_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 + P2: bars stored as Parquet with long names and a ticker column, read back and normalised."""
    path = scratch_path(spark, "pq-bars")
    b = fixtures.bars_panel(spark, sf_dir)
    b.select(F.col("ts").alias("timestamp"), F.col("o").alias("open"), F.col("h").alias("high"),
             F.col("l").alias("low"), F.col("c").alias("close"), F.col("v").alias("volume"),
             F.col("symbol").alias("ticker")).write.mode("overwrite").parquet(path)
    return _bars_out(files.read_bars(spark, path, "parquet"))


@query("src_candle_json", lambda: S.with_(S.ctes_bars_calm()) + _bars_sql(
    "bars_calm", ts="ts + INTERVAL 330 MINUTES"))
def q_src_candle_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: candle payloads (epoch seconds) landed as JSON, exploded to bars in exchange time (UTC+5:30)."""
    path = scratch_path(spark, "candles")
    files.write_candles(fixtures.bars_calm(spark, sf_dir), path)
    return _bars_out(files.read_candles(spark, path))


@query("src_trades_csv", lambda: S.with_(S.ctes_events(), S.ctes_trades()) + f"""
SELECT trade_id, ts_open, ts_open + INTERVAL 75 MINUTES AS ts_close, symbol, side, qty, {S.R('entry_px')} AS entry_px,
       {S.R('entry_px + 1.5')} AS exit_px, {S.R('entry_px + 2.0')} AS tp, {S.R('entry_px - 1.0')} AS sl,
       {S.R('qty / 100.0')} AS base_score, CASE WHEN qty > 50 THEN 'tp' END AS reason, symbol || ', "' || side || '"' AS notes
FROM trades""")
def q_src_trades_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with all columns of a trades file, written as CSV in another order and read back by header name."""
    path = scratch_path(spark, "trades")
    t = fixtures.trades(spark, sf_dir)
    px = F.col("entry_px")
    files.write_csv(t.select(
        "ts_open", (F.col("ts_open") + F.expr("INTERVAL 75 MINUTES")).alias("ts_close"), "symbol", "side", "qty", "entry_px",
        (px + 1.5).alias("exit_px"), (px + 2.0).alias("tp"), (px - 1.0).alias("SL"), (F.col("qty") / 100.0).alias("base_score"),
        F.when(F.col("qty") > 50, "tp").alias("reason"), F.concat("symbol", F.lit(', "'), "side", F.lit('"')).alias("notes"), "trade_id"), path)
    prices = ("entry_px", "exit_px", "tp", "sl", "base_score")
    return files.read_trades(spark, path).withColumns({c: rnd(c) for c in prices})


def _store(spark, sf_dir):
    path = scratch_path(spark, "store")
    bars = fixtures.bars_panel(spark, sf_dir)
    files.store_write(bars, path)
    return files.store_read(spark, path, schema=bars.schema)


@query("store_roundtrip", lambda: S.with_(S.ctes_bars_panel()) + _bars_sql("bars_panel"))
def q_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-symbol store (Parquet partitioned by symbol) written and read back whole."""
    return _bars_out(_store(spark, sf_dir))


@query("store_catalog", lambda: S.with_(S.ctes_bars_panel()) + (
    "SELECT symbol, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, sum(v) % 2 = 0 AS has_model "
    "FROM bars_panel GROUP BY symbol"))
def q_store_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, first and last bar time and model flag per stored symbol. The registry joined is a written
    table; as a fixture it names the symbols of an even total volume."""
    stored = _store(spark, sf_dir)
    path = scratch_path(spark, "symbol-models")
    stored.groupBy("symbol").agg(F.sum("v").alias("v")).filter(F.col("v") % 2 == 0).select("symbol").write.parquet(path)
    return files.catalog(stored, spark.read.schema("symbol string").parquet(path)).select("symbol", F.col("rows").cast("long").alias("rows"),
                                                        "first_ts", "last_ts", "has_model")


# ------------------------------------------------------------------ normalisation / quality

@query("normalize_bars", lambda: S.with_(S.ctes_bars_hour()) + _bars_sql("bars_hour"))
def q_normalize_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short-name layout (timestamp, o, h, l, price, volume, ticker) to the canonical schema."""
    b = fixtures.bars_hour(spark, sf_dir)
    raw = b.select(F.col("ts").alias("timestamp"), "o", "h", "l", F.col("c").alias("price"),
                   F.col("v").alias("volume"), F.col("symbol").alias("ticker"))
    return _bars_out(normalize.bars(raw))


@query("parse_ts", lambda: S.with_(S.ctes_events()) + (
    "SELECT event_id, date_trunc('second', ts) AS ts FROM ev WHERE event_id % 7 <> 0"))
def q_parse_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps written in mixed text formats (and some junk) parsed back; junk rows dropped."""
    ev = fixtures.table(spark, sf_dir, "events")
    txt = (F.when(F.col("event_id") % 7 == 0, F.lit("n/a"))
           .when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
           .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")))
    return ev.select("event_id", normalize.parse_ts(txt).alias("ts")).dropna()


@query("ohlc_integrity", lambda: S.with_(S.ctes_bars_user()) + """
SELECT symbol, count(*) AS bars, count(*) FILTER (WHERE h < l) AS high_below_low,
       count(*) FILTER (WHERE h < c) AS high_below_close, count(*) FILTER (WHERE l > c) AS low_above_close,
       count(*) FILTER (WHERE o < 0 OR h < 0 OR l < 0 OR c < 0) AS negative_prices,
       count(*) FILTER (WHERE v = 0) AS zero_volume,
       count(*) FILTER (WHERE o < 0 OR h < 0 OR l < 0 OR c < 0) = 0 AS valid
FROM bars_user GROUP BY symbol""")
def q_ohlc_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: integrity counts per symbol in one aggregate."""
    return normalize.integrity(fixtures.bars_user(spark, sf_dir))


INTERVALS = [1, 2, 3, 5, 7, 10, 15, 30, 60, 240, 1440]


def _clamp_sql() -> str:
    lim = " ".join(f"WHEN {k} THEN {v}" for k, v in sorted(DURATION_LIMITS.items()))
    arr = ", ".join(str(x) for x in INTERVALS)
    return S.with_(S.ctes_events(), S.ctes_trades(), f"""rq AS (
  SELECT trade_id, ts_open - to_days(CAST(qty AS INTEGER)) AS start, ts_open AS "end",
         [{arr}][CAST(trade_id % {len(INTERVALS)} AS INTEGER) + 1] AS interval_minutes FROM trades),
rq1 AS (SELECT *, CAST(floor((epoch_us("end") - epoch_us(start)) / 86400000000.0) AS BIGINT) AS span_days,
        CASE interval_minutes {lim} ELSE 30 END AS max_days FROM rq)""") + """
SELECT trade_id, span_days, CAST(max_days AS BIGINT) AS max_days, span_days > max_days AS clamped,
       CASE WHEN span_days > max_days THEN "end" - to_days(max_days) ELSE start END AS start_clamped FROM rq1"""


@query("clamp_duration", _clamp_sql)
def q_clamp_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request windows (one per trade: qty days back, interval by trade) clamped to the interval's limit."""
    t = fixtures.trades(spark, sf_dir)
    arr = F.array(*[F.lit(x) for x in INTERVALS])
    rq = t.select("trade_id", (F.col("ts_open") - F.make_dt_interval(days=F.col("qty").cast("int")))
                  .cast("timestamp_ntz").alias("start"), F.col("ts_open").alias("end"),
                  F.get(arr, (F.col("trade_id") % len(INTERVALS)).cast("int")).alias("interval_minutes"))
    c = normalize.clamp_duration(rq, normalize.limits_table(spark))
    return c.select("trade_id", "span_days", F.col("max_days").cast("long").alias("max_days"), "clamped",
                    "start_clamped")


@query("session_filter", lambda: S.with_(S.ctes_bars_user()) + (
    "SELECT symbol, count(*) AS bars FROM bars_user WHERE hour(ts) * 60 + minute(ts) BETWEEN 555 AND 930 "
    "GROUP BY symbol"))
def q_session_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars inside the 09:15-15:30 session, counted per symbol."""
    s = normalize.session_filter(fixtures.bars_user(spark, sf_dir))
    return s.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))


def _windows_sql() -> str:
    return S.with_(S.ctes_bars_calm(), """bd AS (SELECT CAST(min(ts) AS DATE) AS s, CAST(max(ts) AS DATE) AS e FROM bars_calm),
days AS (SELECT CAST(d AS DATE) AS d FROM bd, generate_series(bd.s, bd.e, INTERVAL 1 DAY) g(d)),
wk AS (SELECT CAST(d AS DATE) AS ws FROM bd, generate_series(bd.s, bd.e, INTERVAL 7 DAY) g(d)),
cal AS (
  SELECT 'daily' AS freq, d AS window_start, d AS window_end FROM days
  UNION ALL SELECT 'weekly', ws, least(CAST(ws + INTERVAL 6 DAY AS DATE), (SELECT e FROM bd)) FROM wk
  UNION ALL SELECT 'monthly', d, least(CAST(last_day(d) AS DATE), (SELECT e FROM bd)) FROM days
    WHERE d = (SELECT s FROM bd) OR day(d) = 1)""") + """
SELECT c.freq, CAST(c.window_start AS TIMESTAMP) AS window_start, CAST(c.window_end AS TIMESTAMP) AS window_end,
       count(*) AS bars
FROM bars_calm b JOIN cal c ON CAST(b.ts AS DATE) BETWEEN c.window_start AND c.window_end
GROUP BY c.freq, c.window_start, c.window_end"""


@query("review_windows", _windows_sql)
def q_review_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily / weekly / monthly review windows over the data's date range; bars per window
    (range join of bars to a small broadcast calendar)."""
    b = fixtures.bars_calm(spark, sf_dir)
    bd = b.agg(F.to_date(F.min("ts")).alias("s"), F.to_date(F.max("ts")).alias("e"))
    days = bd.select("s", "e", F.explode(F.sequence("s", "e")).alias("d"))
    daily = days.select(F.lit("daily").alias("freq"), F.col("d").alias("window_start"), F.col("d").alias("window_end"))
    wk = bd.select("e", F.explode(F.sequence("s", "e", F.expr("INTERVAL 7 DAYS"))).alias("ws"))
    weekly = wk.select(F.lit("weekly").alias("freq"), F.col("ws").alias("window_start"),
                       F.least(F.date_add("ws", 6), F.col("e")).alias("window_end"))
    monthly = days.filter((F.col("d") == F.col("s")) | (F.dayofmonth("d") == 1)).select(
        F.lit("monthly").alias("freq"), F.col("d").alias("window_start"),
        F.least(F.last_day("d"), F.col("e")).alias("window_end"))
    cal = daily.unionByName(weekly).unionByName(monthly)
    j = normalize.assign_windows(b, cal)
    g = j.groupBy("freq", "window_start", "window_end").agg(F.count(F.lit(1)).alias("bars"))
    return g.select("freq", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                    F.col("window_end").cast("timestamp_ntz").alias("window_end"), "bars")


@query("signal_bars", lambda: S.with_(S.ctes_bars_panel()) + (
    f"SELECT symbol, ts, {S.R('base_score')} AS base_score FROM bars_panel WHERE base_score > {DEFAULT.signal_threshold}"))
def q_signal_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal candidates (base_score > 0.5, pushed down to the scan after the bar aggregate)."""
    b = fixtures.bars_panel(spark, sf_dir)
    return b.filter(F.col("base_score") > DEFAULT.signal_threshold).select("symbol", "ts", rnd("base_score").alias(
        "base_score"))


@query("base_score_passthrough", lambda: S.with_(S.ctes_bars_user()) + "SELECT symbol, ts, 0.7 AS base_score FROM bars_user")
def q_base_score_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constant base score attached to every bar."""
    return fixtures.bars_user(spark, sf_dir).select("symbol", "ts", F.lit(0.7).alias("base_score"))


@query("bar_index", lambda: S.with_(S.ctes_bars_panel()) + (
    "SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn, "
    "count(*) OVER (PARTITION BY symbol) AS n FROM bars_panel"))
def q_bar_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of every bar in its symbol's history, computed without a whole-symbol window."""
    return index(fixtures.bars_panel(spark, sf_dir)).select("symbol", "ts", "rn", "n")


@query("last_n", lambda: S.with_(S.ctes_bars_panel()) + (
    "SELECT symbol, ts, c FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k "
    "FROM bars_panel) WHERE k <= 20"))
def q_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 bars of every symbol (rn >= n - 20 on the index; a tail report)."""
    b = index(fixtures.bars_panel(spark, sf_dir))
    return b.filter(F.col("rn") >= F.col("n") - 20).select("symbol", "ts", "c")


@query("sample_bars", lambda: S.with_(S.ctes_bars_panel()) + """
SELECT symbol, ts, c FROM (
  SELECT symbol, ts, c, count(*) OVER (PARTITION BY symbol) AS n,
         row_number() OVER (PARTITION BY symbol ORDER BY md5(symbol || '|' || CAST(epoch_us(ts) AS VARCHAR))) AS k FROM bars_panel)
WHERE k <= least(10, n // 10)""")
def q_sample_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: deterministic sample of min(10, n // 10) bars per symbol, ordered by a hash of (symbol, ts).

    The constant bound 10 lets Spark limit each group before the shuffle."""
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("string")
    b = index(fixtures.bars_panel(spark, sf_dir)).withColumn("_h", F.md5(F.concat_ws("|", "symbol", at)))
    w = Window.partitionBy("symbol").orderBy("_h")
    s = b.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= 10)
    return s.filter(F.col("_k") <= F.least(F.lit(10), F.floor(F.col("n") / 10))).select("symbol", "ts", "c")


@query("head_preview", lambda: S.with_(S.ctes_bars_panel()) + (
    "SELECT symbol, ts, c FROM bars_panel ORDER BY symbol, ts LIMIT 10"))
def q_head_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: first 10 bars in (symbol, ts) order (distributed top-k, no global sort)."""
    return fixtures.bars_panel(spark, sf_dir).orderBy("symbol", "ts").limit(10).select("symbol", "ts", "c")


# ------------------------------------------------------------------ resampling, limits

@query("resample_bars", lambda: S.with_(S.ctes_bars_user()) + f"""
SELECT symbol, time_bucket(INTERVAL 15 MINUTES, ts) AS ts, {S.R('arg_min(o, ts)')} AS o, {S.R('max(h)')} AS h,
       {S.R('min(l)')} AS l, {S.R('arg_max(c, ts)')} AS c, CAST(sum(v) AS BIGINT) AS v,
       {S.R('CASE WHEN sum(v) <> 0 THEN sum(vwap * v) / sum(v) END')} AS vwap_true,
       {S.R('(max(h) + min(l) + arg_max(c, ts)) / 3.0')} AS vwap, count(*) AS bars
FROM bars_user GROUP BY symbol, time_bucket(INTERVAL 15 MINUTES, ts)""")
def q_resample_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 + D5: 15-minute bars per symbol (first open, last close, true volume-weighted vwap)."""
    r = resample.resample(fixtures.bars_user(spark, sf_dir), 15)
    return r.select("symbol", "ts", *[rnd(c).alias(c) for c in ("o", "h", "l", "c")], "v",
                    rnd("vwap_true").alias("vwap_true"), rnd("vwap").alias("vwap"), "bars")


@query("position_limits", lambda: S.with_(S.ctes_events(), S.ctes_trades()) + f"""
SELECT CAST(CAST(ts_open AS DATE) AS TIMESTAMP) AS day, count(*) AS trades,
       {S.R('max(qty * entry_px / 1000000.0 * 100.0)')} AS max_position_pct,
       count(*) FILTER (WHERE qty * entry_px / 1000000.0 * 100.0 > {DEFAULT.max_position_pct}) AS oversized_positions,
       count(*) > {DEFAULT.max_daily_trades} AS too_many_trades
FROM trades GROUP BY 1""")
def q_position_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: trades per day and position size against the limits (capital 1,000,000)."""
    r = resample.position_limits(fixtures.trades(spark, sf_dir), 1_000_000.0)
    return r.select(F.col("day").cast("timestamp_ntz").alias("day"), "trades", rnd("max_position_pct").alias("max_position_pct"), "oversized_positions",
                    "too_many_trades")


# ------------------------------------------------------------------ logs

def _log_lines(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "logs")
    lines = logs.render_fixture_lines(fixtures.trades(spark, sf_dir))
    lines.write.mode("overwrite").partitionBy("symbol").text(path)
    return logs.read_lines(spark, path).withColumnRenamed("symbol", "source")


@query("log_trade_entries", lambda: S.with_(S.ctes_events(), S.ctes_trades()) + """
SELECT symbol, CASE WHEN trade_id % 3 <> 0 THEN date_trunc('second', ts_open) END AS timestamp, entry_px AS entry,
       entry_px - 5.0 AS stop_trailing, entry_px - 6.0 AS stop_loss, entry_px + 10.0 AS target, qty FROM trades""")
def q_log_trade_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade entries parsed from log lines (timestamp when present)."""
    e = logs.trade_entries(_log_lines(spark, sf_dir))
    return e.select("symbol", "timestamp", "entry", "stop_trailing", "stop_loss", "target", "qty")


@query("log_scanner_rows", lambda: S.with_(S.ctes_events(), S.ctes_trades()) + """
SELECT symbol, qty / 100.0 AS score, entry_px AS ltp, 0.0015 AS atr_pct, (qty - 50) / 100.0 AS vwap_dev, qty AS volume
FROM trades UNION ALL
SELECT 'ALT-' || symbol, qty / 10.0, entry_px + 1.0, 0.002, (50 - qty) / 100.0, qty FROM trades""")
def q_log_scanner_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per scanned tuple (both quote styles, signed deviations)."""
    s = logs.scanner_rows(_log_lines(spark, sf_dir))
    return s.select(F.col("symbol"), "score", "ltp", "atr_pct", "vwap_dev", "volume")


@query("log_line_types", lambda: S.with_(S.ctes_events(), S.ctes_trades()) + """
SELECT line_type, symbol, count(*) AS lines FROM (
  SELECT CASE WHEN trade_id % 3 <> 0 THEN 'other' ELSE 'unparsed' END AS line_type, NULL AS symbol FROM trades
  UNION ALL SELECT 'scan', NULL FROM trades
  UNION ALL SELECT 'execution', symbol FROM trades
  UNION ALL SELECT 'unparsed', NULL FROM trades) GROUP BY line_type, symbol""")
def q_log_line_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by type (execution / scan / other / unparsed), executions per symbol."""
    t = logs.line_types(_log_lines(spark, sf_dir))
    return t.groupBy("line_type", F.col("symbol").alias("symbol")).agg(F.count(F.lit(1)).alias("lines")).select(
        "line_type", "symbol", "lines")


@query("log_counts", lambda: S.with_(S.ctes_events(), S.ctes_trades()) + (
    "SELECT symbol, 2 * count(*) AS scans, count(*) AS entries FROM trades GROUP BY symbol"))
def q_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned tuples and entries per log directory (one per symbol)."""
    c = logs.counts(_log_lines(spark, sf_dir), key="source")
    return c.select(F.col("source").alias("symbol"), F.col("scans").cast("long").alias("scans"), F.col("entries").cast("long").alias("entries"))


# ------------------------------------------------------------------ review sinks

def _review_rows(spark, sf_dir, bars=fixtures.bars_panel) -> DataFrame:
    return _reviewed(bars(spark, sf_dir))


def _reviewed(bars: DataFrame, **known) -> DataFrame:
    from ..operators import labels
    from .q_features import regime_panel

    return labels.meta_labels(regime_panel(bars, **known)).core()


def _review_ctes(bars: str = "bars_panel") -> list[str]:
    from .q_labels import ctes_meta

    source = {"bars_panel": S.ctes_bars_panel, "bars_user": S.ctes_bars_user}[bars]
    return [source(), S.ctes_core_features(bars), S.ctes_regime(), ctes_meta("reg")]


@query("export_bars", lambda: S.with_(*_review_ctes()) + (
    "SELECT symbol, ts, " + ", ".join(f"{S.R(c)} AS {c}" for c in BAR_D) + ", CAST(v AS BIGINT) AS v, regime FROM ml"))
def q_export_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with their regime exported as CSV (ts, symbol, o, h, l, c, v, vwap, regime), gzipped, and read back."""
    path = scratch_path(spark, "export")
    bars, most = fixtures.panel_histories(spark, sf_dir)
    with shuffles_removed(spark):
        files.write_csv(_reviewed(bars, most=most, distinct=True).select("ts", "symbol", *["o", "h", "l", "c", "v", "vwap"], "regime"),
                        path, compression="gzip")
    back = (spark.read.option("header", True).option("timestampNTZFormat", files.TS_TEXT)
            .schema("ts timestamp_ntz, symbol string, o double, h double, l double, c double, v long, vwap double, "
                    "regime string").csv(path))
    return _bars_out(back, "regime")


@query("sink_trades_review", lambda: S.with_(*_review_ctes()) + (
    f"SELECT symbol, ts, regime, meta_label, exit_reason, {S.R('realized_return', 8)} AS realized_return, "
    f"{S.R('atr_pct')} AS atr_pct FROM ml"))
def q_sink_trades_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review rows (features, regime, labels per bar) written as CSV partitioned by review month, read back."""
    path = scratch_path(spark, "review")
    rows = _review_rows(spark, sf_dir).withColumn("review_month", F.date_format("ts", "yyyy-MM"))
    cols = ["symbol", "ts", "regime", "meta_label", "exit_reason", "realized_return", "atr_pct"]
    files.write_csv(rows.select(*cols, "review_month"), path, ["review_month"])
    back = (spark.read.option("header", True).option("timestampNTZFormat", files.TS_TEXT)
            .schema("symbol string, ts timestamp_ntz, regime string, meta_label long, exit_reason string, "
                    "realized_return double, atr_pct double, review_month string").csv(path))
    return back.select("symbol", "ts", "regime", "meta_label", "exit_reason",
                       rnd("realized_return", 8).alias("realized_return"), rnd("atr_pct").alias("atr_pct"))


#: Columns of a review file, in its order.
REVIEW_COLUMNS = [
    "ts", "symbol", "o", "h", "l", "c", "v", "vwap", "vwap_dist", "vwap_slope", "tr", "atr", "atr_pct", "returns",
    "realized_vol", "volume_ratio_2", "volume_ratio_5", "volume_ratio_10", "hour", "minute", "hour_sin", "hour_cos",
    "session_phase", "base_score", "up_bar", "directional_count", "atr_expansion", "regime", "meta_label",
    "realized_return", "exit_reason", "label", "pnl_pct", "bars_held"]
REVIEW_LONG = {"v", "hour", "minute", "session_phase", "up_bar", "directional_count", "meta_label", "label", "bars_held"}
REVIEW_TEXT = {"ts", "symbol", "regime", "exit_reason"}


def _review_column_sql(c: str) -> str:
    src = {"label": "meta_label", "pnl_pct": "realized_return"}.get(c, c)
    if c in REVIEW_TEXT:
        return c
    return f"CAST({src} AS BIGINT) AS {c}" if c in REVIEW_LONG else f"{S.R(src)} AS {c}"


def review_file_rows(rows: DataFrame) -> DataFrame:
    """Labelled bars with all columns of a review file: label is the meta-label, pnl_pct the realised return."""
    return rows.withColumns({"label": F.col("meta_label"), "pnl_pct": F.col("realized_return")}).select(*REVIEW_COLUMNS)


@query("review_by_date", lambda: S.with_(*_review_ctes("bars_user")) + (
    "SELECT " + ", ".join(_review_column_sql(c) for c in REVIEW_COLUMNS) + ", CAST(CAST(ts AS DATE) AS VARCHAR) AS review_date FROM ml"))
def q_review_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole review rows (34 columns) of the intraday bars as CSV by review date; then the latest day is
    read alone and written once more, which replaces it and leaves the others. Read back."""
    path = scratch_path(spark, "review-by-date")
    rows = review_file_rows(_review_rows(spark, sf_dir, fixtures.bars_user))
    files.write_review(rows, path)
    latest = fixtures.bars_user(spark, sf_dir).agg(F.date_format(F.max("ts"), "yyyy-MM-dd")).first()[0]
    if latest is not None:
        again = files.read_review(spark, path, rows.schema, [latest]).drop("review_date")
        files.write_review(again.checkpoint(), path)
    back = files.read_review(spark, path, rows.schema)
    return back.select("review_date", *[c if c in REVIEW_TEXT | REVIEW_LONG else rnd(c).alias(c) for c in REVIEW_COLUMNS])


REGIME_NAMES = ["trend", "chop", "breakout", "unknown"]


def summary_select(keys: str = "symbol", src: str = "ml") -> str:
    thr = DEFAULT.signal_threshold
    pcts = ", ".join(f"{S.R(f'count(*) FILTER (WHERE regime = {chr(39)}{r}{chr(39)}) / count(*) * 100.0')} AS {r}_pct"
                     for r in REGIME_NAMES)
    x = "realized_return"
    return f"""
SELECT {keys}, count(*) AS bars, count(*) FILTER (WHERE base_score > {thr}) AS signals,
  {S.R(f'coalesce(count(*) FILTER (WHERE base_score > {thr} AND {x} > 0) / nullif(count(*) FILTER (WHERE base_score > {thr}), 0), 0.0)', 8)} AS win_rate,
  {S.R(f'coalesce(avg({x} / {DEFAULT.risk_per_trade!r}) FILTER (WHERE base_score > {thr}), 0.0)', 8)} AS avg_r,
  {S.R(f'''CASE WHEN sum({x}) FILTER (WHERE base_score > {thr} AND {x} <= 0) != 0
       THEN abs(coalesce(sum({x}) FILTER (WHERE base_score > {thr} AND {x} > 0), 0.0) / sum({x}) FILTER (WHERE base_score > {thr} AND {x} <= 0)) ELSE 0.0 END''', 8)} AS profit_factor,
  {pcts}
FROM {src} GROUP BY {keys}"""


def review_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Bars, signals, win rate, avg R, profit factor and regime shares of labelled bars for each of ``keys``."""
    x, sig = F.col("realized_return"), F.col("base_score") > DEFAULT.signal_threshold
    n_sig = F.count_if(sig)
    loss_sum = F.sum(F.when(sig & (x <= 0), x))
    win_sum = F.coalesce(F.sum(F.when(sig & (x > 0), x)), F.lit(0.0))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars"), n_sig.alias("signals"),
        F.coalesce(F.count_if(sig & (x > 0)) / F.nullif(n_sig, F.lit(0)), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.avg(F.when(sig, x / F.lit(DEFAULT.risk_per_trade))), F.lit(0.0)).alias("avg_r"),
        F.when(F.coalesce(loss_sum, F.lit(0.0)) != 0, F.abs(win_sum / loss_sum)).otherwise(F.lit(0.0))
        .alias("profit_factor"),
        *[(F.count_if(F.col("regime") == r) / F.count(F.lit(1)) * F.lit(100.0)).alias(f"{r}_pct")
          for r in REGIME_NAMES],
    )


SUMMARY_DOUBLES = ["win_rate", "avg_r", "profit_factor"]


def summary_out(df: DataFrame, *others) -> DataFrame:
    return df.select(*others, "bars", "signals", *[rnd(c, 8).alias(c) for c in SUMMARY_DOUBLES],
                     *[rnd(f"{r}_pct").alias(f"{r}_pct") for r in REGIME_NAMES])


@query("sink_review_summary", lambda: S.with_(*_review_ctes()) + summary_select())
def q_sink_review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-symbol review summary (bars, signals, win rate, avg R, profit factor, regime %),
    written as a Parquet table and read back."""
    path = scratch_path(spark, "summary")
    review_summary(_review_rows(spark, sf_dir), "symbol").write.mode("overwrite").parquet(path)
    return summary_out(spark.read.parquet(path), "symbol")


@query("scan_symbol_join", lambda: S.with_(S.ctes_bars_calm(), S.ctes_trades(), """sm AS (
  SELECT symbol, count(*) AS bars, arg_max(c, ts) AS last_close, max(h) AS high FROM bars_calm GROUP BY symbol)""") + f"""
SELECT t.symbol, t.qty / 100.0 AS score, {S.R('t.entry_px')} AS ltp, t.qty AS volume, sm.bars, {S.R('sm.last_close')} AS last_close,
       {S.R('sm.high')} AS high
FROM trades t JOIN sm ON sm.symbol = t.symbol""")
def q_scan_symbol_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanner rows parsed from the logs attached to their symbol's bar summary (equi-join on symbol;
    the per-symbol summary is one aggregate row per symbol)."""
    scans = logs.scanner_rows(_log_lines(spark, sf_dir))
    b = fixtures.bars_calm(spark, sf_dir)
    sm = b.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.max_by("c", "ts").alias("last_close"),
                                 F.max("h").alias("high"))
    j = scans.join(sm, "symbol")
    return j.select("symbol", "score", rnd("ltp").alias("ltp"), "volume", "bars", rnd("last_close").alias("last_close"),
                    rnd("high").alias("high"))
