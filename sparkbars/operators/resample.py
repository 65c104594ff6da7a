"""Bar resampling (e.g. 5-minute -> 15/30-minute), bars from ticks, true VWAP,
and position-limit checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT, Params


def resample(bars_df: DataFrame, minutes: int) -> DataFrame:
    """Coarser bars per (symbol, window): open = first, close = last by time, high/low = max/min,
    v = sum, vwap = volume-weighted typical price (sum(vwap*v)/sum(v)). One partial+final aggregate."""
    w = F.window("ts", f"{minutes} minutes")
    agg = bars_df.groupBy("symbol", w.alias("w")).agg(
        F.min_by("o", "ts").alias("o"),
        F.max("h").alias("h"),
        F.min("l").alias("l"),
        F.max_by("c", "ts").alias("c"),
        F.sum("v").cast("long").alias("v"),
        F.sum(F.col("vwap") * F.col("v")).alias("_pv"),
        F.count(F.lit(1)).alias("bars"),
    )
    return agg.select(
        "symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "o", "h", "l", "c", "v",
        F.when(F.col("v") != 0, F.col("_pv") / F.col("v")).alias("vwap_true"),
        ((F.col("h") + F.col("l") + F.col("c")) / F.lit(3.0)).alias("vwap"),
        F.col("bars").cast("long").alias("bars"),
    )


def bars_from_ticks(ticks: DataFrame, minutes: int, price: str = "price", size: str = "size") -> DataFrame:
    """OHLCV bars from ticks (symbol, ts, price, size); vwap_true = sum(p*q)/sum(q)."""
    w = F.window("ts", f"{minutes} minutes")
    agg = ticks.groupBy("symbol", w.alias("w")).agg(
        F.min_by(price, "ts").alias("o"), F.max(price).alias("h"), F.min(price).alias("l"),
        F.max_by(price, "ts").alias("c"), F.sum(size).cast("long").alias("v"),
        F.sum(F.col(price) * F.col(size)).alias("_pv"), F.sum(size).alias("_q"),
    )
    return agg.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "o", "h", "l", "c", "v",
                      F.when(F.col("_q") != 0, F.col("_pv") / F.col("_q")).alias("vwap_true"))


def position_limits(trades: DataFrame, capital: float, p: Params = DEFAULT) -> DataFrame:
    """Per trading day: trades, max position % of capital, and the limit breaches."""
    day = F.to_date("ts_open")
    pos_pct = F.col("qty") * F.col("entry_px") / F.lit(capital) * F.lit(100.0)
    agg = trades.groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("trades"),
        F.max(pos_pct).alias("max_position_pct"),
        F.count_if(pos_pct > p.max_position_pct).alias("oversized_positions"),
    )
    return agg.withColumn("too_many_trades", F.col("trades") > p.max_daily_trades)
