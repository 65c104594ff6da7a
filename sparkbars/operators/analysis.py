"""Per-symbol analysis: price action and advanced metrics.

Every "first / last / last-N bars" quantity is a conditional aggregate keyed
on the bar index (``rn`` against ``n``), so the whole set is one hash
aggregate per symbol with partial aggregation before the shuffle (a hot
symbol is pre-aggregated in every task). The only collection is of the
last 50 highs/lows, bounded by 50 per symbol.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip_lower0, full_roll, ieee_div, pct_change
from ..params import DEFAULT, Params
from ..plans.layout import Panel
from . import ema as ema_ops


def bar_inputs(panel: Panel, p: Params = DEFAULT) -> Panel:
    """Per-bar inputs: returns, |dc|, true range, raw RSI-14, signed volume, MACD."""
    w = panel.w
    c, h, l, v = (F.col(x) for x in ("c", "h", "l", "v"))
    c1 = F.lag("c").over(w)
    df = panel.df.select(
        "*",
        pct_change("c", w).alias("returns"),
        F.abs(c - c1).alias("absdc"),
        F.greatest(h - l, F.abs(h - c1), F.abs(l - c1)).alias("tr"),
        (c - c1).alias("_delta"),
        F.when(c > c1, v).when(c < c1, -v).when(c1.isNotNull(), F.lit(0)).alias("signed_v"),
    )
    rs = ieee_div(full_roll(F.avg, clip_lower0(F.col("_delta")), w, 14),
                  full_roll(F.avg, clip_lower0(-F.col("_delta")), w, 14))
    df = df.withColumn("rsi", F.lit(100.0) - ieee_div(F.lit(100.0), F.lit(1.0) + rs)).drop("_delta")
    return ema_ops.macd(panel.with_df(df), "c", p=p)


def price_action(bars: DataFrame) -> DataFrame:
    """Change %, volatility, recent momentum, VWAP side/distance, volume trend, 20-bar levels."""
    rn, n = F.col("rn"), F.col("n")
    recent = rn >= n - 20
    a = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"),
        F.min_by("c", "rn").alias("first_c"),
        F.max_by("c", "rn").alias("current_price"),
        F.stddev_samp("returns").alias("volatility"),
        F.min_by("c", F.when(recent, rn)).alias("recent_first_c"),
        F.max_by("vwap", "rn").alias("last_vwap"),
        F.avg("v").alias("avg_volume"),
        F.avg(F.when(recent, F.col("v"))).alias("recent_volume"),
        F.max(F.when(recent, F.col("h"))).alias("resistance"),
        F.min(F.when(recent, F.col("l"))).alias("support"),
    )
    cp, lv = F.col("current_price"), F.col("last_vwap")
    return a.select(
        "symbol", "bars",
        (ieee_div(cp - F.col("first_c"), "first_c") * F.lit(100.0)).alias("price_change_pct"),
        F.when(cp > F.col("recent_first_c"), F.lit("BULLISH")).otherwise(F.lit("BEARISH")).alias("momentum"),
        "volatility",
        F.when(cp > lv, F.lit("ABOVE")).otherwise(F.lit("BELOW")).alias("vwap_position"),
        (ieee_div(cp - lv, lv) * F.lit(100.0)).alias("vwap_distance_pct"),
        F.when(F.col("recent_volume") > F.col("avg_volume") * F.lit(1.2), F.lit("INCREASING"))
        .when(F.col("recent_volume") < F.col("avg_volume") * F.lit(0.8), F.lit("DECREASING"))
        .otherwise(F.lit("STABLE")).alias("volume_trend"),
        "current_price", "resistance", "support", "avg_volume", "last_vwap",
    )


def advanced_metrics(bars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Price, volatility, momentum, volume, OBV, VWAP bands, support/resistance, ADX proxy,
    sentiment and momentum state per symbol; symbols with < ``metrics_min_bars`` bars are left out."""
    rn, n = F.col("rn"), F.col("n")
    last = lambda x: F.max_by(x, "rn")
    a = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"),
        F.min_by("c", "rn").alias("first_c"),
        last("c").alias("last_c"),
        F.max("h").alias("max_h"),
        F.min("l").alias("min_l"),
        F.stddev_samp("returns").alias("daily_volatility"),
        F.sum(F.pow(F.ln(ieee_div("h", "l")), 2)).alias("_ln2"),
        F.coalesce(last("rsi"), F.lit(50.0)).alias("rsi"),  # none yet: neutral
        last("macd").alias("macd"),
        last("macd_signal").alias("macd_signal"),
        F.avg("v").alias("avg_volume"),
        F.stddev_samp("v").alias("volume_stddev"),
        F.avg(F.when(rn >= n - 10, F.col("v"))).alias("_recent_v"),
        F.sum("signed_v").alias("obv"),
        F.sum(F.when(rn >= n - 9, F.col("signed_v"))).alias("_obv_recent"),
        last("vwap").alias("_last_vwap"),
        F.stddev_samp("vwap").alias("_vwap_std"),
        F.sort_array(F.collect_list(F.when(rn >= n - 50, F.col("h"))), asc=False).alias("_highs"),
        F.sort_array(F.collect_list(F.when(rn >= n - 50, F.col("l")))).alias("_lows"),
        F.sum(F.when(rn >= n - 14, F.col("absdc"))).alias("_adc14"),
        F.sum(F.when(rn >= n - 14, F.col("tr"))).alias("_tr14"),
        F.count_if(F.col("c") > F.col("o")).alias("_bull"),
        F.count_if(F.col("c") < F.col("o")).alias("_bear"),
    ).filter(F.col("bars") >= p.metrics_min_bars)
    nb = F.col("bars")
    lv = F.col("_last_vwap")
    atr = F.col("_tr14") / F.lit(14.0)
    tc = F.col("_adc14") / F.lit(14.0)
    adx = F.when(atr > 0, F.least(F.lit(100.0), tc / atr * F.lit(100.0))).otherwise(F.lit(25.0))
    m = a.select(
        "symbol", "bars",
        (ieee_div(F.col("last_c") - F.col("first_c"), "first_c") * F.lit(100.0)).alias("price_change_pct"),
        (ieee_div(F.col("max_h") - F.col("min_l"), "min_l") * F.lit(100.0)).alias("price_range_pct"),
        "daily_volatility",
        (F.col("daily_volatility") * F.lit(math.sqrt(252))).alias("annualized_volatility"),
        F.sqrt(F.lit(1.0) / (F.lit(4.0) * nb * F.lit(math.log(2))) * F.col("_ln2")).alias("parkinson_volatility"),
        "rsi", "macd", "macd_signal",
        (F.col("macd") - F.col("macd_signal")).alias("macd_histogram"),
        "avg_volume", "volume_stddev",
        (ieee_div("_recent_v", "avg_volume") - F.lit(1.0)).alias("volume_trend"),
        F.col("obv").cast("long").alias("obv"),
        F.when(F.col("_obv_recent") > 0, F.lit("BULLISH")).otherwise(F.lit("BEARISH")).alias("obv_trend"),
        (ieee_div(F.col("last_c") - lv, lv) * F.lit(100.0)).alias("vwap_distance_pct"),
        (lv + F.lit(2.0) * F.col("_vwap_std")).alias("vwap_upper_band"),
        (lv - F.lit(2.0) * F.col("_vwap_std")).alias("vwap_lower_band"),
        F.col("_highs")[0].alias("resistance_1"),
        F.coalesce(F.get(F.col("_highs"), 1), F.col("_highs")[0]).alias("resistance_2"),
        F.col("_lows")[0].alias("support_1"),
        F.coalesce(F.get(F.col("_lows"), 1), F.col("_lows")[0]).alias("support_2"),
        adx.alias("adx"),
        (F.col("_bull") / nb * F.lit(100.0)).alias("bullish_pct"),
        (F.col("_bear") / nb * F.lit(100.0)).alias("bearish_pct"),
        F.col("last_c").alias("current_price"),
    )
    rsi, hist, adx_c = F.col("rsi"), F.col("macd_histogram"), F.col("adx")
    ok = ~F.isnan(rsi)  # NaN RSI (flat prices) fails every comparison
    state = (
        F.when(ok & (rsi > 70), F.lit("OVERBOUGHT"))
        .when(ok & (rsi < 30), F.lit("OVERSOLD"))
        .when((hist > 0) & (adx_c > 25), F.lit("STRONG_BULLISH"))
        .when((hist < 0) & (adx_c > 25), F.lit("STRONG_BEARISH"))
        .otherwise(F.lit("NEUTRAL"))
    )
    return m.withColumn("momentum_state", state)
