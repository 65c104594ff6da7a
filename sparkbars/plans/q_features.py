"""Queries: core features, regime, regime statistics, dominant regime."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import features_core, regime
from ..params import DEFAULT, Params
from ..sources import fixtures
from . import sqlparts as S
from .layout import Panel, layout
from .registry import query


def featured_panel(bars: DataFrame, p: Params = DEFAULT, **known) -> Panel:
    """``known``: what ``layout`` may know of the bars (``most``, ``distinct``)."""
    return features_core.compute(layout(bars, p, **known), p)


def regime_panel(bars: DataFrame, p: Params = DEFAULT, **known) -> Panel:
    return regime.classify(featured_panel(bars, p, **known), p)


DOUBLE_FEATURES = ["vwap_dist", "vwap_slope", "tr", "atr", "atr_pct", "returns", "realized_vol",
                   "volume_ratio_2", "volume_ratio_5", "volume_ratio_10", "hour_sin", "hour_cos"]
INT_FEATURES = ["hour", "minute", "session_phase"]


def _core_select(df: DataFrame) -> DataFrame:
    return df.select(
        "symbol", "ts",
        *[rnd(c, 6).alias(c) for c in DOUBLE_FEATURES],
        *[F.col(c).cast("long").alias(c) for c in INT_FEATURES],
    )


def _core_sql(src: str) -> str:
    cols = ", ".join([S.R(c, 6) + f" AS {c}" for c in DOUBLE_FEATURES] + INT_FEATURES)
    return S.with_(S.FIXTURE_CTES[src](), S.ctes_core_features(src)) + f"SELECT symbol, ts, {cols} FROM feat"


@query("core_features", lambda: _core_sql("bars_panel"))
def q_core_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core features of every bar of bars_panel."""
    return _core_select(featured_panel(fixtures.bars_panel(spark, sf_dir)).core())


@query("core_features_short", lambda: _core_sql("bars_user"))
def q_core_features_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1-W11 on short per-user histories: the 34-bar guard leaves features null."""
    return _core_select(featured_panel(fixtures.bars_user(spark, sf_dir)).core())


REGIME_COLS_D = ["atr_expansion"]


def _regime_select(df: DataFrame) -> DataFrame:
    return df.select(
        "symbol", "ts", F.col("up_bar").cast("long").alias("up_bar"),
        F.col("directional_count").cast("long").alias("directional_count"),
        rnd("atr_expansion", 6).alias("atr_expansion"), "regime",
    )


def _regime_sql(src: str) -> str:
    return (
        S.with_(S.FIXTURE_CTES[src](), S.ctes_core_features(src), S.ctes_regime())
        + f"SELECT symbol, ts, up_bar, directional_count, {S.R('atr_expansion')} AS atr_expansion, regime FROM reg"
    )


@query("regime", lambda: _regime_sql("bars_panel"))
def q_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: regime of every bar of bars_panel."""
    return _regime_select(regime_panel(fixtures.bars_panel(spark, sf_dir)).core())


@query("regime_hour", lambda: _regime_sql("bars_hour"))
def q_regime_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 on hourly bars with wild prices (breakout cases, five hot symbols)."""
    return _regime_select(regime_panel(fixtures.bars_hour(spark, sf_dir)).core())


def _stats_sql(src: str) -> str:
    return S.with_(
        S.FIXTURE_CTES[src](), S.ctes_core_features(src), S.ctes_regime(),
        """st AS (SELECT symbol, regime, count(*) AS bars, avg(realized_vol) AS avg_vol, avg(atr_pct) AS avg_atr
  FROM reg GROUP BY symbol, regime)""",
    ) + (
        f"SELECT symbol, regime, bars, {S.R('bars / sum(bars) OVER (PARTITION BY symbol) * 100.0')} AS pct, "
        f"{S.R('avg_vol', 8)} AS avg_vol, {S.R('avg_atr', 8)} AS avg_atr FROM st"
    )


def regime_stats_df(bars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return regime.stats(regime_panel(bars, p).core())


@query("regime_stats", lambda: _stats_sql("bars_panel"))
def q_regime_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars, % of bars, mean realized_vol and mean atr_pct per (symbol, regime)."""
    st = regime_stats_df(fixtures.bars_panel(spark, sf_dir))
    return st.select(
        "symbol", "regime", F.col("bars").cast("long").alias("bars"), rnd("pct", 6).alias("pct"),
        rnd("avg_vol", 8).alias("avg_vol"), rnd("avg_atr", 8).alias("avg_atr"),
    )


def _dominant_sql() -> str:
    return S.with_(
        S.ctes_bars_panel(), S.ctes_core_features("bars_panel"), S.ctes_regime(),
        """st AS (SELECT symbol, regime, count(*) AS bars FROM reg GROUP BY symbol, regime),
ordered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bars DESC,
    CASE regime WHEN 'trend' THEN 0 WHEN 'chop' THEN 1 WHEN 'breakout' THEN 2 ELSE 3 END) AS k FROM st)""",
    ) + "SELECT symbol, regime AS dominant_regime, bars AS dominant_bars FROM ordered WHERE k = 1"


@query("dominant_regime", _dominant_sql)
def q_dominant_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regime with most bars per symbol (ties: trend, chop, breakout, unknown)."""
    d = regime.dominant(regime_stats_df(fixtures.bars_panel(spark, sf_dir)))
    return d.select("symbol", "dominant_regime", F.col("dominant_bars").cast("long").alias("dominant_bars"))
