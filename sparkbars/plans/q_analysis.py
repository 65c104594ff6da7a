"""Queries: per-symbol price action and advanced metrics, trading signals,
risk grades, insights and the text report (all on bars_panel)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import analysis, regime, rules
from ..params import DEFAULT
from ..sources import fixtures
from . import sqlparts as S
from .layout import layout
from .q_features import regime_stats_df
from .q_wide import ctes_ema
from .registry import query


def inputs_df(spark, sf_dir) -> DataFrame:
    return analysis.bar_inputs(layout(fixtures.bars_panel(spark, sf_dir)).spread()).core()


def metrics_df(spark, sf_dir) -> DataFrame:
    return analysis.advanced_metrics(inputs_df(spark, sf_dir))


def price_action_df(spark, sf_dir) -> DataFrame:
    return analysis.price_action(inputs_df(spark, sf_dir))


# ---------------------------------------------------------------- oracle SQL

def ctes_inputs() -> list[str]:
    w = "(PARTITION BY symbol ORDER BY ts)"
    fr = S.full_roll
    return [
        S.ctes_bars_panel(),
        f"""ai0 AS (
  SELECT *, row_number() OVER {w} - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n, lag(c) OVER {w} AS c_1
  FROM bars_panel),
ai1 AS (
  SELECT *, (c - c_1) / c_1 AS returns, abs(c - c_1) AS absdc, greatest(h - l, abs(h - c_1), abs(l - c_1)) AS tr,
         CASE WHEN c > c_1 THEN v WHEN c < c_1 THEN -v WHEN c_1 IS NOT NULL THEN 0 END AS signed_v,
         CASE WHEN c - c_1 IS NULL THEN NULL WHEN c - c_1 < 0 THEN 0.0 ELSE c - c_1 END AS gain,
         CASE WHEN c - c_1 IS NULL THEN NULL WHEN -(c - c_1) < 0 THEN 0.0 ELSE -(c - c_1) END AS loss
  FROM ai0),
ai2 AS (SELECT *, 100.0 - 100.0 / (1.0 + {fr('avg', 'gain', 14)} / {fr('avg', 'loss', 14)}) AS rsi FROM ai1)""",
        ctes_ema("ai0", "c", 12, "e12", "ema12"),
        ctes_ema("ai0", "c", 26, "e26", "ema26"),
        "mc AS (SELECT e12.symbol, e12.rn, ema12 - ema26 AS macd FROM e12 JOIN e26 USING (symbol, rn))",
        ctes_ema("mc", "macd", 9, "e9", "macd_signal"),
        "ai AS (SELECT ai2.*, mc.macd, e9.macd_signal FROM ai2 JOIN mc USING (symbol, rn) JOIN e9 USING (symbol, rn))",
    ]


def ctes_metrics() -> list[str]:
    ln2, s252 = repr(math.log(2)), repr(math.sqrt(252))
    return ctes_inputs() + [f"""met0 AS (
  SELECT symbol, count(*) AS bars, arg_min(c, rn) AS first_c, arg_max(c, rn) AS last_c, max(h) AS max_h,
         min(l) AS min_l, stddev_samp(returns) AS daily_volatility, sum(pow(ln(h / l), 2)) AS ln2,
         arg_max(rsi, rn) AS rsi, arg_max(macd, rn) AS macd, arg_max(macd_signal, rn) AS macd_signal,
         avg(v) AS avg_volume, stddev_samp(v) AS volume_stddev, avg(v) FILTER (WHERE rn >= n - 10) AS recent_v,
         CAST(sum(signed_v) AS BIGINT) AS obv, sum(signed_v) FILTER (WHERE rn >= n - 9) AS obv_recent,
         arg_max(vwap, rn) AS last_vwap, stddev_samp(vwap) AS vwap_std,
         list_sort(list(h) FILTER (WHERE rn >= n - 50), 'DESC') AS highs,
         list_sort(list(l) FILTER (WHERE rn >= n - 50), 'ASC') AS lows,
         sum(absdc) FILTER (WHERE rn >= n - 14) AS adc14, sum(tr) FILTER (WHERE rn >= n - 14) AS tr14,
         count(*) FILTER (WHERE c > o) AS bull, count(*) FILTER (WHERE c < o) AS bear
  FROM ai GROUP BY symbol HAVING count(*) >= {DEFAULT.metrics_min_bars}),
met1 AS (
  SELECT symbol, bars, (last_c - first_c) / first_c * 100.0 AS price_change_pct,
         (max_h - min_l) / min_l * 100.0 AS price_range_pct, daily_volatility,
         daily_volatility * {s252} AS annualized_volatility,
         sqrt(1.0 / (4.0 * bars * {ln2}) * ln2) AS parkinson_volatility,
         rsi, macd, macd_signal, macd - macd_signal AS macd_histogram, avg_volume, volume_stddev,
         recent_v / avg_volume - 1.0 AS volume_trend, obv,
         CASE WHEN obv_recent > 0 THEN 'BULLISH' ELSE 'BEARISH' END AS obv_trend,
         (last_c - last_vwap) / last_vwap * 100.0 AS vwap_distance_pct,
         last_vwap + 2.0 * vwap_std AS vwap_upper_band, last_vwap - 2.0 * vwap_std AS vwap_lower_band,
         highs[1] AS resistance_1, coalesce(highs[2], highs[1]) AS resistance_2,
         lows[1] AS support_1, coalesce(lows[2], lows[1]) AS support_2,
         CASE WHEN tr14 / 14.0 > 0 THEN least(100.0, (adc14 / 14.0) / (tr14 / 14.0) * 100.0) ELSE 25.0 END AS adx,
         bull / bars * 100.0 AS bullish_pct, bear / bars * 100.0 AS bearish_pct, last_c AS current_price
  FROM met0),
met AS (
  SELECT *, CASE WHEN NOT isnan(rsi) AND rsi > 70 THEN 'OVERBOUGHT' WHEN NOT isnan(rsi) AND rsi < 30 THEN 'OVERSOLD'
                 WHEN macd_histogram > 0 AND adx > 25 THEN 'STRONG_BULLISH'
                 WHEN macd_histogram < 0 AND adx > 25 THEN 'STRONG_BEARISH' ELSE 'NEUTRAL' END AS momentum_state
  FROM met1)"""]


# output column -> decimals (None = not a double)
METRIC_COLS = {
    "bars": None, "price_change_pct": 6, "price_range_pct": 6, "daily_volatility": 8, "annualized_volatility": 8,
    "parkinson_volatility": 8, "rsi": 6, "macd": 3, "macd_signal": 3, "macd_histogram": 3, "avg_volume": 6,
    "volume_stddev": 6, "volume_trend": 8, "obv": None, "obv_trend": None, "vwap_distance_pct": 6,
    "vwap_upper_band": 6, "vwap_lower_band": 6, "resistance_1": 6, "resistance_2": 6, "support_1": 6,
    "support_2": 6, "adx": 6, "bullish_pct": 6, "bearish_pct": 6, "momentum_state": None,
}

GROUPS = {
    "price_metrics": ["price_change_pct", "price_range_pct"],
    "volatility_metrics": ["daily_volatility", "annualized_volatility", "parkinson_volatility"],
    "rsi_last": ["rsi"],
    "macd_last": ["macd", "macd_signal", "macd_histogram"],
    "volume_metrics": ["avg_volume", "volume_stddev", "volume_trend"],
    "obv": ["obv", "obv_trend"],
    "vwap_bands": ["vwap_distance_pct", "vwap_upper_band", "vwap_lower_band"],
    "support_resistance": ["resistance_1", "resistance_2", "support_1", "support_2"],
    "adx_proxy": ["adx"],
    "sentiment_pct": ["bullish_pct", "bearish_pct"],
    "momentum_state": ["momentum_state"],
    "advanced_metrics": list(METRIC_COLS),
}


def _spark_cols(cols):
    out = []
    for c in cols:
        d = METRIC_COLS[c]
        out.append(rnd(c, d).alias(c) if d else (F.col(c).cast("long").alias(c) if c in ("bars", "obv") else F.col(c)))
    return out


def _sql_cols(cols):
    out = []
    for c in cols:
        d = METRIC_COLS[c]
        out.append(f"{S.R(c, d)} AS {c}" if d else (f"CAST({c} AS BIGINT) AS {c}" if c in ("bars", "obv") else c))
    return ", ".join(out)


def _register_metric_group(name: str, cols: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return metrics_df(spark, sf_dir).select("symbol", *_spark_cols(cols))

    run.__doc__ = f"A2-A13: {name} per symbol (symbols with fewer than 20 bars are left out)."
    query(name, lambda: S.with_(*ctes_metrics()) + f"SELECT symbol, {_sql_cols(cols)} FROM met")(run)


for _name, _cols in GROUPS.items():
    _register_metric_group(_name, _cols)


PA_D = {"price_change_pct": 6, "volatility": 8, "vwap_distance_pct": 6, "current_price": 6, "resistance": 6,
        "support": 6, "avg_volume": 6}


def ctes_price_action() -> str:
    return """pa AS (
  SELECT symbol, count(*) AS bars, (arg_max(c, rn) - arg_min(c, rn)) / arg_min(c, rn) * 100.0 AS price_change_pct,
         CASE WHEN arg_max(c, rn) > arg_min(c, CASE WHEN rn >= n - 20 THEN rn END) THEN 'BULLISH' ELSE 'BEARISH' END AS momentum,
         stddev_samp(returns) AS volatility,
         CASE WHEN arg_max(c, rn) > arg_max(vwap, rn) THEN 'ABOVE' ELSE 'BELOW' END AS vwap_position,
         (arg_max(c, rn) - arg_max(vwap, rn)) / arg_max(vwap, rn) * 100.0 AS vwap_distance_pct,
         CASE WHEN avg(v) FILTER (WHERE rn >= n - 20) > avg(v) * 1.2 THEN 'INCREASING'
              WHEN avg(v) FILTER (WHERE rn >= n - 20) < avg(v) * 0.8 THEN 'DECREASING' ELSE 'STABLE' END AS volume_trend,
         arg_max(c, rn) AS current_price, max(h) FILTER (WHERE rn >= n - 20) AS resistance,
         min(l) FILTER (WHERE rn >= n - 20) AS support, avg(v) AS avg_volume, arg_max(vwap, rn) AS last_vwap
  FROM ai1 GROUP BY symbol)"""


@query("price_action", lambda: S.with_(*ctes_inputs(), ctes_price_action()) + (
    "SELECT symbol, CAST(bars AS BIGINT) AS bars, momentum, vwap_position, volume_trend, "
    + ", ".join(f"{S.R(c, d)} AS {c}" for c, d in PA_D.items()) + " FROM pa"))
def q_price_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: change %, volatility, momentum, VWAP side/distance, volume trend, 20-bar levels per symbol."""
    pa = price_action_df(spark, sf_dir)
    return pa.select("symbol", F.col("bars").cast("long").alias("bars"), "momentum", "vwap_position", "volume_trend",
                     *[rnd(c, d).alias(c) for c, d in PA_D.items()])


@query("trading_signals", lambda: S.with_(*ctes_metrics(), """sg AS (
  SELECT symbol, unnest(CASE WHEN len(f) > 0 THEN f ELSE [{'rule_id': 0, 'type': 'HOLD', 'strength': 'NEUTRAL',
         'reason': 'No strong signals detected', 'confidence': 50}] END, recursive := true)
  FROM (SELECT symbol, list_filter([""" + ",\n".join(
    f"""CASE WHEN {cond} THEN {{'rule_id': {r[0]}, 'type': '{r[1]}', 'strength': '{r[2]}', 'reason': '{r[3]}', 'confidence': {r[4]}}} END"""
    for r, cond in zip(rules.SIGNAL_RULES, [
        "NOT isnan(rsi) AND rsi < 30 AND macd_histogram > 0",
        "vwap_lower_band > 0 AND current_price <= vwap_lower_band * 1.005",
        "adx > 25 AND momentum_state = 'STRONG_BULLISH'",
        "NOT isnan(rsi) AND rsi > 70",
        "resistance_1 > 0 AND current_price >= resistance_1 * 0.995",
        "macd_histogram < 0 AND macd < macd_signal",
    ])) + """], lambda x: x IS NOT NULL) AS f FROM met))""") + (
    "SELECT symbol, CAST(rule_id AS BIGINT) AS rule_id, type, strength, reason, CAST(confidence AS BIGINT) AS confidence FROM sg"))
def q_trading_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fired signal rules per symbol (HOLD when none)."""
    s = rules.signals(metrics_df(spark, sf_dir))
    return s.select("symbol", F.col("rule_id").cast("long").alias("rule_id"), "type", "strength", "reason",
                    F.col("confidence").cast("long").alias("confidence"))


@query("risk_grades", lambda: S.with_(*ctes_metrics(), """rk0 AS (
  SELECT symbol,
    CASE WHEN daily_volatility > 0.03 THEN 'HIGH' WHEN daily_volatility > 0.015 THEN 'MEDIUM' ELSE 'LOW' END AS volatility_risk,
    CASE WHEN momentum_state IN ('OVERBOUGHT', 'OVERSOLD') THEN 'HIGH'
         WHEN momentum_state IN ('STRONG_BULLISH', 'STRONG_BEARISH') THEN 'MEDIUM' ELSE 'LOW' END AS momentum_risk,
    CASE WHEN abs(volume_trend) > 0.5 THEN 'HIGH' WHEN abs(volume_trend) > 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS volume_risk
  FROM met),
rk1 AS (SELECT *, ((CASE volatility_risk WHEN 'LOW' THEN 2 WHEN 'MEDIUM' THEN 5 ELSE 8 END)
    + (CASE momentum_risk WHEN 'LOW' THEN 2 WHEN 'MEDIUM' THEN 5 ELSE 8 END)
    + (CASE volume_risk WHEN 'LOW' THEN 2 WHEN 'MEDIUM' THEN 5 ELSE 8 END)) / 3.0 AS overall_score FROM rk0)""") + (
    f"SELECT symbol, volatility_risk, momentum_risk, volume_risk, {S.R('overall_score')} AS overall_score, "
    "CASE WHEN overall_score > 6 THEN 'HIGH' WHEN overall_score > 4 THEN 'MEDIUM' ELSE 'LOW' END AS overall FROM rk1"))
def q_risk_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: volatility, momentum and volume risk, overall score and grade per symbol."""
    r = rules.risk(metrics_df(spark, sf_dir))
    return r.select("symbol", "volatility_risk", "momentum_risk", "volume_risk",
                    rnd("overall_score").alias("overall_score"), "overall")


def insights_df(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    pa = price_action_df(spark, sf_dir)
    dom = regime.dominant(regime_stats_df(fixtures.bars_panel(spark, sf_dir)))
    pa = pa.join(dom.select("symbol", "dominant_regime"), "symbol", "left")
    return pa, rules.insights(pa)


def _insights_sql() -> str:
    from .q_features import _dominant_sql  # noqa: F401
    conds = {
        1: "abs(price_change_pct) > 2", 2: "abs(vwap_distance_pct) > 1 AND vwap_position = 'ABOVE'",
        3: "abs(vwap_distance_pct) > 1 AND vwap_position <> 'ABOVE'", 4: "NOT abs(vwap_distance_pct) > 1",
        5: "volatility > 0.02", 6: "NOT volatility > 0.02 AND volatility < 0.01",
        7: "volume_trend = 'INCREASING'", 8: "volume_trend = 'DECREASING'",
        9: "(resistance - current_price) / current_price * 100.0 < 1",
        10: "(current_price - support) / current_price * 100.0 < 1",
        11: "dominant_regime = 'trend'", 12: "dominant_regime = 'trend' AND momentum = 'BULLISH'",
        13: "dominant_regime = 'trend' AND momentum <> 'BULLISH'", 14: "dominant_regime = 'chop'",
        15: "dominant_regime = 'chop'", 16: "dominant_regime = 'breakout'", 17: "dominant_regime = 'breakout'",
    }
    vals = {1: "abs(price_change_pct)", 2: "abs(vwap_distance_pct)", 3: "abs(vwap_distance_pct)", 5: "volatility",
            6: "volatility", 9: "resistance", 10: "support", 15: "support"}
    items = ",\n".join(f"CASE WHEN {c} THEN {{'rule_id': {i}, 'value': CAST({vals.get(i, 'NULL')} AS DOUBLE)}} END"
                       for i, c in conds.items())
    return S.with_(
        *ctes_inputs(), ctes_price_action(), S.ctes_core_features("bars_panel"), S.ctes_regime(),
        """st AS (SELECT symbol, regime, count(*) AS bars FROM reg GROUP BY symbol, regime),
ordered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bars DESC,
    CASE regime WHEN 'trend' THEN 0 WHEN 'chop' THEN 1 WHEN 'breakout' THEN 2 ELSE 3 END) AS k FROM st),
dom AS (SELECT symbol, regime AS dominant_regime FROM ordered WHERE k = 1),
pad AS (SELECT pa.*, dom.dominant_regime FROM pa LEFT JOIN dom USING (symbol)),
ins AS (SELECT symbol, unnest(list_filter([""" + items + """], lambda x: x IS NOT NULL), recursive := true) FROM pad)""",
    ) + f"SELECT symbol, CAST(rule_id AS BIGINT) AS rule_id, {S.R('value')} AS value FROM ins"


@query("insights", _insights_sql)
def q_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insight rules fired per symbol, with the number each one shows."""
    _, ins = insights_df(spark, sf_dir)
    return ins.select("symbol", F.col("rule_id").cast("long").alias("rule_id"), rnd("value").alias("value"))


@query("analysis_report")
def q_analysis_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-symbol markdown summary (text; rows-only check)."""
    pa, ins = insights_df(spark, sf_dir)
    return rules.report(pa, ins)
