"""Queries: the wide feature set and MACD."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import ema as ema_ops
from ..operators import features_wide
from ..params import DEFAULT, Params
from ..sources import fixtures
from . import sqlparts as S
from .layout import layout
from .registry import query

# decimals per output column for value comparison (magnitude-aware)
DECIMALS = {"vwap_proxy_5": 2, "pv_product": 4}


def wide_panel(bars: DataFrame, p: Params = DEFAULT):
    return features_wide.compute(layout(bars, p), p)


def _select(df: DataFrame, cols: list[str]) -> DataFrame:
    out = []
    for c in cols:
        if c in features_wide.INT_COLUMNS:
            out.append(F.col(c).cast("long").alias(c))
        else:
            out.append(rnd(c, DECIMALS.get(c, 6)).alias(c))
    return df.select("symbol", "ts", *out)


def ctes_ema(src: str, x: str, span: float, out: str, col: str) -> str:
    d = repr(ema_ops.decay(span))
    return f"""{out} AS (
  SELECT r.symbol, r.rn, sum(l.{x} * pow({d}, r.rn - l.rn)) / sum(pow({d}, r.rn - l.rn)) AS {col}
  FROM {src} r JOIN {src} l ON l.symbol = r.symbol AND l.rn <= r.rn GROUP BY r.symbol, r.rn)"""


def ctes_wide(src: str) -> list[str]:
    w = "(PARTITION BY symbol ORDER BY ts)"
    fr = S.full_roll
    smas = ",\n         ".join(f"{fr('avg', 'c', k)} AS sma_{k}" for k in features_wide.SMA_PERIODS)
    p2s = ",\n         ".join(f"c / sma_{k} AS price_to_sma_{k}" for k in features_wide.SMA_PERIODS)
    upto = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def filled(c):
        f = f"last_value({c} IGNORE NULLS) OVER {upto}"
        if c not in features_wide.INT_COLUMNS:
            f = f"(CASE WHEN isnan({f}) THEN 0.0 ELSE {f} END)"
        return f"{f} AS {c}"

    fill = ",\n         ".join(filled(c) for c in features_wide.columns())
    return [
        f"""wf0 AS (
  SELECT *, row_number() OVER {w} - 1 AS rn, lag(c) OVER {w} AS c_1, lag(c, 5) OVER {w} AS c_5,
         lag(c, 10) OVER {w} AS c_10, lag(v) OVER {w} AS v_1 FROM {src}),
wf1 AS (
  SELECT *, (c - c_1) / c_1 AS returns, (c - c_5) / c_5 AS returns_5, (c - c_10) / c_10 AS returns_10,
         ln(c / c_1) AS log_returns, h - l AS range, (h - l) / c AS range_pct, c - o AS body, (c - o) / c AS body_pct,
         o - c_1 AS gap, (o - c_1) / c_1 AS gap_pct,
         CAST(v - v_1 AS DOUBLE) / CAST(v_1 AS DOUBLE) AS volume_change,
         CAST(v AS DOUBLE) / {fr('avg', 'v', 5)} AS volume_ratio_5,
         CAST(v AS DOUBLE) / {fr('avg', 'v', 10)} AS volume_ratio_10,
         CAST(v AS DOUBLE) / {fr('avg', 'v', 20)} AS volume_ratio_20,
         greatest(h - l, abs(h - c_1), abs(l - c_1)) AS true_range, c - c_1 AS delta,
         CAST(c > o AS BIGINT) AS bullish_candle, CAST(c < o AS BIGINT) AS bearish_candle,
         CAST(hour(ts) AS BIGINT) AS hour, CAST(day(ts) AS BIGINT) AS day, CAST(isodow(ts) AS BIGINT) AS weekday,
         CAST(month(ts) AS BIGINT) AS month, (h - l) / ((h + l) / 2.0) AS hl_spread, c / o AS efficiency,
         c * v AS cv
  FROM wf0),
wf2 AS (
  SELECT *, returns * v AS pv_product,
         {fr('stddev_samp', 'returns', 5)} AS volatility_5, {fr('stddev_samp', 'returns', 10)} AS volatility_10,
         {fr('stddev_samp', 'returns', 20)} AS volatility_20, {fr('avg', 'true_range', 14)} AS atr_14,
         CASE WHEN delta IS NULL THEN NULL WHEN delta < 0 THEN 0.0 ELSE delta END AS gain,
         CASE WHEN delta IS NULL THEN NULL WHEN -delta < 0 THEN 0.0 ELSE -delta END AS loss,
         {smas},
         CAST({fr('sum', 'bullish_candle', 3)} AS BIGINT) AS consecutive_bull_3,
         CAST({fr('sum', 'bearish_candle', 3)} AS BIGINT) AS consecutive_bear_3,
         sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos,
         sin(2 * pi() * weekday / 7) AS weekday_sin, cos(2 * pi() * weekday / 7) AS weekday_cos,
         {fr('sum', 'cv', 5)} AS vwap_proxy_5
  FROM wf1),
wf3 AS (
  SELECT *, atr_14 / c AS atr_pct_14,
         100.0 - 100.0 / (1.0 + {fr('avg', 'gain', 14)} / {fr('avg', 'loss', 14)}) AS rsi_14,
         {p2s}
  FROM wf2)""",
        ctes_ema("wf0", "c", 12, "e12", "ema12"),
        ctes_ema("wf0", "c", 26, "e26", "ema26"),
        "mc AS (SELECT e12.symbol, e12.rn, ema12 - ema26 AS macd FROM e12 JOIN e26 USING (symbol, rn))",
        ctes_ema("mc", "macd", 9, "e9", "macd_signal"),
        f"""wf4 AS (
  SELECT wf3.*, mc.macd, e9.macd_signal, mc.macd - e9.macd_signal AS macd_histogram
  FROM wf3 JOIN mc USING (symbol, rn) JOIN e9 USING (symbol, rn)),
wide AS (
  SELECT symbol, ts, rn,
         {fill}
  FROM wf4)""",
    ]


def _wide_sql(src: str) -> str:
    cols = []
    for c in features_wide.columns():
        cols.append(c if c in features_wide.INT_COLUMNS else f"{S.R(c, DECIMALS.get(c, 6))} AS {c}")
    return S.with_(S.FIXTURE_CTES[src](), *ctes_wide(src)) + "SELECT symbol, ts, " + ", ".join(cols) + " FROM wide"


@query("wide_features", lambda: _wide_sql("bars_calm"))
def q_wide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 52 wide features of every bar of bars_calm."""
    return _select(wide_panel(fixtures.bars_calm(spark, sf_dir)).core(), features_wide.columns())


MACD_COLS = ["macd", "macd_signal", "macd_histogram"]


@query("macd", lambda: S.with_(S.FIXTURE_CTES["bars_hour"](), *ctes_wide("bars_hour")) + (
    "SELECT symbol, ts, " + ", ".join(f"{S.R(c, 6)} AS {c}" for c in MACD_COLS) + " FROM wf4"))
def q_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MACD (EMA 12 - EMA 26, signal EMA 9, histogram) by an associative scan, on wild hourly prices."""
    pan = ema_ops.macd(layout(fixtures.bars_hour(spark, sf_dir)).spread(), "c")
    return pan.core().select("symbol", "ts", *[rnd(c, 6).alias(c) for c in MACD_COLS])
