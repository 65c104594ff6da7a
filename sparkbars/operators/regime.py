"""Market regime of every bar (trend / chop / breakout / unknown) and the
per-(symbol, regime) statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import full_roll, ieee_div
from ..params import DEFAULT, Params
from ..plans.layout import Panel

# Regime names in their precedence / tie-break order.
REGIMES = ["trend", "chop", "breakout", "unknown"]


def classify(panel: Panel, p: Params = DEFAULT) -> Panel:
    """Append up_bar, directional_count, atr_expansion and regime to featured bars."""
    w = panel.w
    ok = F.col("n") >= max(p.regime_min_bars, p.feature_min_bars)
    df = panel.df.withColumn(
        "up_bar", F.when(ok, (F.col("c") > F.lag("c").over(w)).cast("long"))
    )
    df = df.select(
        "*",
        F.when(ok, full_roll(F.sum, "up_bar", w, p.trend_min_bars)).cast("long").alias("directional_count"),
        F.when(ok, ieee_div("atr_pct", full_roll(F.avg, "atr_pct", w, 10))).alias("atr_expansion"),
    )
    dc = F.col("directional_count")
    trend = (F.abs(F.col("vwap_slope")) > p.trend_min_slope) & (
        (dc >= p.trend_min_bars) | (dc <= p.trend_min_bars - p.trend_min_bars)
    )
    chop = (F.col("realized_vol") < p.chop_max_vol) & (F.col("atr_pct") < p.chop_max_atr)
    breakout = (F.col("volume_ratio_5") > p.breakout_min_volume_ratio) & (
        F.col("atr_expansion") > p.breakout_min_atr_expansion
    )
    regime = (
        F.when(~ok, F.lit("unknown"))
        .when(trend, F.lit("trend"))
        .when(chop, F.lit("chop"))
        .when(breakout, F.lit("breakout"))
        .otherwise(F.lit("unknown"))
    )
    return panel.with_df(df.withColumn("regime", regime))


def stats(bars: DataFrame) -> DataFrame:
    """count, % of the symbol's bars, mean realized_vol and mean atr_pct per (symbol, regime)."""
    agg = bars.groupBy("symbol", "regime").agg(
        F.count(F.lit(1)).alias("bars"),
        F.avg("realized_vol").alias("avg_vol"),
        F.avg("atr_pct").alias("avg_atr"),
    )
    total = F.sum("bars").over(Window.partitionBy("symbol"))
    return agg.withColumn("pct", F.col("bars") / total * F.lit(100.0))


def dominant(stats_df: DataFrame) -> DataFrame:
    """The regime with most bars per symbol; ties go to the earlier regime in REGIMES."""
    order = F.create_map(*[x for i, r in enumerate(REGIMES) for x in (F.lit(r), F.lit(i))])
    rank_key = F.struct(F.col("bars"), (-order[F.col("regime")]).alias("neg_order"))
    return stats_df.groupBy("symbol").agg(
        F.max_by("regime", rank_key).alias("dominant_regime"),
        F.max("bars").alias("dominant_bars"),
    )
