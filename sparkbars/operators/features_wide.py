"""Wide feature set (52 columns): returns, ranges, gaps, volume ratios,
volatility, ATR, RSI, MACD, moving averages, candle patterns, calendar and
microstructure features. Same fill rule as the core set (forward fill, then
NaN -> 0), no minimum-row guard."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import clip_lower0, full_roll, ieee_div, nan_to_zero, pct_change, two_pi
from ..params import DEFAULT, Params
from ..plans.layout import Panel
from . import ema as ema_ops
from .features_core import true_range

SMA_PERIODS = (5, 10, 20, 50, 100, 200)


def columns() -> list[str]:
    cols = ["returns", "returns_5", "returns_10", "log_returns", "range", "range_pct", "body", "body_pct", "gap",
            "gap_pct", "volume_change", "volume_ratio_5", "volume_ratio_10", "volume_ratio_20", "pv_product",
            "volatility_5", "volatility_10", "volatility_20", "true_range", "atr_14", "atr_pct_14", "rsi_14",
            "macd", "macd_signal", "macd_histogram"]
    for k in SMA_PERIODS:
        cols += [f"sma_{k}", f"price_to_sma_{k}"]
    cols += ["bullish_candle", "bearish_candle", "consecutive_bull_3", "consecutive_bear_3", "hour", "day",
             "weekday", "month", "hour_sin", "hour_cos", "weekday_sin", "weekday_cos", "hl_spread", "efficiency",
             "vwap_proxy_5"]
    return cols


INT_COLUMNS = {"bullish_candle", "bearish_candle", "consecutive_bull_3", "consecutive_bear_3", "hour", "day",
               "weekday", "month"}


def compute(panel: Panel, p: Params = DEFAULT) -> Panel:
    w = panel.w
    c, o, h, l, v = (F.col(x) for x in ("c", "o", "h", "l", "v"))
    c1 = F.lag("c").over(w)
    df = panel.df.select(
        "*",
        pct_change("c", w).alias("returns"),
        pct_change("c", w, 5).alias("returns_5"),
        pct_change("c", w, 10).alias("returns_10"),
        F.ln(ieee_div(c, c1)).alias("log_returns"),
        (h - l).alias("range"),
        ieee_div(h - l, c).alias("range_pct"),
        (c - o).alias("body"),
        ieee_div(c - o, c).alias("body_pct"),
        (o - c1).alias("gap"),
        ieee_div(o - c1, c1).alias("gap_pct"),
        pct_change("v", w).alias("volume_change"),
        *[ieee_div(v, full_roll(F.avg, "v", w, k)).alias(f"volume_ratio_{k}") for k in (5, 10, 20)],
        true_range(w).alias("true_range"),
        (c - c1).alias("_delta"),
        (c > o).cast("long").alias("bullish_candle"),
        (c < o).cast("long").alias("bearish_candle"),
        F.hour("ts").cast("long").alias("hour"),
        F.dayofmonth("ts").cast("long").alias("day"),
        (F.weekday("ts") + 1).cast("long").alias("weekday"),
        F.month("ts").cast("long").alias("month"),
        ieee_div(h - l, (h + l) / F.lit(2.0)).alias("hl_spread"),
        ieee_div(c, o).alias("efficiency"),
        (c * v).alias("_cv"),
    )
    df = df.select(
        "*",
        (F.col("returns") * v).alias("pv_product"),
        *[full_roll(F.stddev_samp, "returns", w, k).alias(f"volatility_{k}") for k in (5, 10, 20)],
        full_roll(F.avg, "true_range", w, 14).alias("atr_14"),
        clip_lower0(F.col("_delta")).alias("_gain"),
        clip_lower0(-F.col("_delta")).alias("_loss"),
        *[full_roll(F.avg, "c", w, k).alias(f"sma_{k}") for k in SMA_PERIODS],
        full_roll(F.sum, "bullish_candle", w, 3).cast("long").alias("consecutive_bull_3"),
        full_roll(F.sum, "bearish_candle", w, 3).cast("long").alias("consecutive_bear_3"),
        F.sin(two_pi() * F.col("hour") / F.lit(24)).alias("hour_sin"),
        F.cos(two_pi() * F.col("hour") / F.lit(24)).alias("hour_cos"),
        F.sin(two_pi() * F.col("weekday") / F.lit(7)).alias("weekday_sin"),
        F.cos(two_pi() * F.col("weekday") / F.lit(7)).alias("weekday_cos"),
        full_roll(F.sum, "_cv", w, 5).alias("vwap_proxy_5"),
    )
    rs = ieee_div(full_roll(F.avg, "_gain", w, 14), full_roll(F.avg, "_loss", w, 14))
    df = df.select(
        "*",
        ieee_div("atr_14", "c").alias("atr_pct_14"),
        (F.lit(100.0) - ieee_div(F.lit(100.0), F.lit(1.0) + rs)).alias("rsi_14"),
        *[ieee_div(c, F.col(f"sma_{k}")).alias(f"price_to_sma_{k}") for k in SMA_PERIODS],
    )
    pan = ema_ops.macd(panel.with_df(df), "c", p=p)
    df = pan.df.drop("_delta", "_gain", "_loss", "_cv")
    base = list(panel.df.columns)
    df = df.select(*base, *columns())
    dbl = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    cols = [c for c in df.columns if c not in ("symbol", "ts", "rn", "n", "blk", "core")]
    df = panel.with_df(df).filled(cols)
    df = df.select(*[nan_to_zero(c).alias(c) if c in dbl and c in cols else F.col(c) for c in df.columns])
    return panel.with_df(df)
