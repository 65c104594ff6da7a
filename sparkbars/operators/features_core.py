"""Core bar features (vwap distance/slope, true range, ATR, returns, realized
volatility, volume ratios, time of day, session phase) for all symbols at once.

All windows share one spec, (symbol, blk) ordered by ts, so Catalyst plans a
single Exchange + Sort for the whole set.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.exprs import full_roll, ieee_div, nan_to_zero, two_pi
from ..params import DEFAULT, Params
from ..plans.layout import Panel

KEYS = ["symbol", "ts"]


def columns(p: Params = DEFAULT) -> list[str]:
    """Model feature columns: 7 + one per volume lookback + base_score."""
    cols = ["vwap_dist", "vwap_slope", "atr_pct", "realized_vol", "hour_sin", "hour_cos", "session_phase"]
    cols += [f"volume_ratio_{k}" for k in p.vol_lookbacks]
    return cols + ["base_score"]


def output_columns(p: Params = DEFAULT) -> list[str]:
    return ["vwap_dist", "vwap_slope", "tr", "atr", "atr_pct", "returns", "realized_vol"] + [
        f"volume_ratio_{k}" for k in p.vol_lookbacks
    ] + ["hour", "minute", "hour_sin", "hour_cos", "session_phase"]


def true_range(w: Window, h="h", l="l", c="c", before: str | None = None) -> Column:
    """max(h-l, |h-c_prev|, |l-c_prev|); the first bar (no c_prev) gives h-l. ``before``: a column that has c_prev."""
    c1 = F.col(before) if before else F.lag(F.col(c)).over(w)
    return F.greatest(F.col(h) - F.col(l), F.abs(F.col(h) - c1), F.abs(F.col(l) - c1))


def session_phase(hour: Column, minute: Column) -> Column:
    return (
        F.when(hour < 9, 0)
        .when((hour == 9) & (minute < 30), 1)
        .when(hour < 14, 2)
        .when(hour >= 15, 3)
        .otherwise(2)
    )


def compute(panel: Panel, p: Params = DEFAULT) -> Panel:
    """Append the core features; symbols with fewer than ``p.feature_min_bars`` bars get nulls."""
    w = panel.w
    # a window function that an expression names twice is computed twice: those used several times get a column
    df = panel.df.select("*", F.lag("vwap", p.vwap_slope_bars).over(w).alias("_vwap_then"), F.lag("c").over(w).alias("_c_then"))
    df = df.select(
        "*",
        ieee_div(F.col("c") - F.col("vwap"), F.col("vwap")).alias("vwap_dist"),
        ieee_div(F.col("vwap") - F.col("_vwap_then"), "_vwap_then").alias("vwap_slope"),
        true_range(w, before="_c_then").alias("tr"),
        ieee_div(F.col("c") - F.col("_c_then"), "_c_then").alias("returns"),
        F.hour("ts").cast("long").alias("hour"),
        F.minute("ts").cast("long").alias("minute"),
    )
    k = p.atr_period
    df = df.select(
        "*",
        full_roll(F.avg, "tr", w, k).alias("atr"),
        full_roll(F.stddev_samp, "returns", w, k).alias("realized_vol"),
        *[full_roll(F.avg, "v", w, lb).alias(f"_volume_{lb}") for lb in p.vol_lookbacks],
        F.sin(two_pi() * F.col("hour") / F.lit(24)).alias("hour_sin"),
        F.cos(two_pi() * F.col("hour") / F.lit(24)).alias("hour_cos"),
        session_phase(F.col("hour"), F.col("minute")).cast("long").alias("session_phase"),
    )
    df = df.select("*", ieee_div("atr", "c").alias("atr_pct"),
                   *[ieee_div("v", f"_volume_{lb}").alias(f"volume_ratio_{lb}") for lb in p.vol_lookbacks])
    feats = output_columns(p)
    enough = F.col("n") >= p.feature_min_bars
    base = [c for c in panel.df.columns]
    df = df.select(*base, *[F.when(enough, F.col(c)).alias(c) for c in feats])
    # forward fill, then NaN -> 0, only where the features were computed
    dbl = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    cols = [c for c in df.columns if c not in ("symbol", "ts", "rn", "n", "blk", "core")]
    df = panel.with_df(df).filled(cols, enough)
    df = df.select(*[F.when(enough, nan_to_zero(c)).otherwise(F.col(c)).alias(c) if c in cols and c in dbl else F.col(c) for c in df.columns])
    return panel.with_df(df)
