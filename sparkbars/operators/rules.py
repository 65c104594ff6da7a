"""Rule tables over the per-symbol metrics: trading signals, risk grades,
insights and a text report. Rules are evaluated as columns and turned into
long tables with ``explode`` (no Python)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ieee_div

# Signal rules (rule_id, type, strength, reason, confidence), in order.
SIGNAL_RULES = [
    (1, "BUY", "STRONG", "RSI Oversold + MACD Bullish Crossover", 85),
    (2, "BUY", "MEDIUM", "Price near VWAP lower band (mean reversion)", 70),
    (3, "BUY", "STRONG", "Strong uptrend with high ADX", 80),
    (4, "SELL", "MEDIUM", "RSI Overbought (> 70)", 65),
    (5, "SELL", "MEDIUM", "Price at resistance level", 70),
    (6, "SELL", "MEDIUM", "MACD Bearish Crossover", 75),
]
HOLD_RULE = (0, "HOLD", "NEUTRAL", "No strong signals detected", 50)

# Risk scores per grade.
RISK_SCORES = {"LOW": 2, "MEDIUM": 5, "HIGH": 8}

# Insight texts ({} = number formatted with two or three decimals).
INSIGHTS = {
    1: "🎯 Strong {dir}ward movement: {x}% change",
    2: "📈 Price trading {x}% above VWAP - Bullish signal",
    3: "📉 Price trading {x}% below VWAP - Bearish pressure",
    4: "⚖️ Price near VWAP - Balanced market",
    5: "⚠️ High volatility detected ({x}) - Use wider stops",
    6: "🔒 Low volatility ({x}) - Tight range, breakout potential",
    7: "📊 Volume increasing - Confirms price movement",
    8: "📉 Volume declining - Weak momentum, caution advised",
    9: "🚧 Near resistance at ₹{x} - Watch for rejection or breakout",
    10: "🛡️ Near support at ₹{x} - Potential bounce zone",
    11: "🚀 TREND regime detected - Momentum strategies favored",
    12: "✅ Bullish trend - Consider long positions on pullbacks",
    13: "⚠️ Bearish trend - Avoid longs, consider shorts",
    14: "〰️ CHOP regime detected - Range-bound, mean-reversion strategies",
    15: "🎯 Trade between support (₹{s}) and resistance (₹{r})",
    16: "💥 BREAKOUT regime detected - High volume + volatility",
    17: "⚡ Quick exits recommended - High risk/reward setup",
}


def _fmt(template: str, **kw):
    """format_string version of a template with {name} placeholders (in the given order)."""
    fmt, args = template.replace("%", "%%"), []
    for name, (spec, colexpr) in kw.items():
        fmt = fmt.replace("{" + name + "}", spec)
        args.append(colexpr)
    return F.format_string(fmt, *args) if args else F.lit(template)


def signals(m: DataFrame) -> DataFrame:
    """One row per fired rule (HOLD when none) per symbol."""
    rsi, hist = F.col("rsi"), F.col("macd_histogram")
    ok = ~F.isnan(rsi)
    price = F.col("current_price")
    lower, res = F.col("vwap_lower_band"), F.col("resistance_1")
    conds = {
        1: ok & (rsi < 30) & (hist > 0),
        2: (lower > 0) & (price <= lower * F.lit(1.005)),
        3: (F.col("adx") > 25) & (F.col("momentum_state") == "STRONG_BULLISH"),
        4: ok & (rsi > 70),
        5: (res > 0) & (price >= res * F.lit(0.995)),
        6: (hist < 0) & (F.col("macd") < F.col("macd_signal")),
    }

    def row(r):
        return F.struct(F.lit(r[0]).alias("rule_id"), F.lit(r[1]).alias("type"), F.lit(r[2]).alias("strength"),
                        F.lit(r[3]).alias("reason"), F.lit(r[4]).alias("confidence"))

    fired = F.filter(F.array(*[F.when(conds[r[0]], row(r)) for r in SIGNAL_RULES]), lambda x: x.isNotNull())
    sig = F.when(F.size(fired) > 0, fired).otherwise(F.array(row(HOLD_RULE)))
    return m.select("symbol", F.explode(sig).alias("s")).select("symbol", "s.*")


def risk(m: DataFrame) -> DataFrame:
    vol, st = F.col("daily_volatility"), F.col("momentum_state")
    vt = F.abs(F.col("volume_trend"))
    vol_r = F.when(vol > 0.03, "HIGH").when(vol > 0.015, "MEDIUM").otherwise("LOW")
    mom_r = F.when(st.isin("OVERBOUGHT", "OVERSOLD"), "HIGH").when(
        st.isin("STRONG_BULLISH", "STRONG_BEARISH"), "MEDIUM").otherwise("LOW")
    volu_r = F.when(vt > 0.5, "HIGH").when(vt > 0.2, "MEDIUM").otherwise("LOW")
    score = F.create_map(*[x for k, v in RISK_SCORES.items() for x in (F.lit(k), F.lit(v))])
    out = m.select("symbol", vol_r.alias("volatility_risk"), mom_r.alias("momentum_risk"),
                   volu_r.alias("volume_risk"))
    total = score[F.col("volatility_risk")] + score[F.col("momentum_risk")] + score[F.col("volume_risk")]
    out = out.withColumn("overall_score", total / F.lit(3.0))
    return out.withColumn("overall", F.when(F.col("overall_score") > 6, "HIGH")
                          .when(F.col("overall_score") > 4, "MEDIUM").otherwise("LOW"))


def insights(pa: DataFrame, regime_col: str = "dominant_regime") -> DataFrame:
    """One row per insight (symbol, rule_id, text), from price action and the symbol's regime."""
    chg, vd, vol = F.col("price_change_pct"), F.col("vwap_distance_pct"), F.col("volatility")
    cur, res, sup = F.col("current_price"), F.col("resistance"), F.col("support")
    reg = F.col(regime_col)
    T = INSIGHTS
    two = lambda c: ("%.2f", c)
    three = lambda c: ("%.3f", c)
    items = [
        (1, F.abs(chg) > 2, _fmt(T[1], dir=("%s", F.when(chg > 0, "up").otherwise("down")), x=two(F.abs(chg)))),
        (2, (F.abs(vd) > 1) & (F.col("vwap_position") == "ABOVE"), _fmt(T[2], x=two(F.abs(vd)))),
        (3, (F.abs(vd) > 1) & (F.col("vwap_position") != "ABOVE"), _fmt(T[3], x=two(F.abs(vd)))),
        (4, ~(F.abs(vd) > 1), F.lit(T[4])),
        (5, vol > 0.02, _fmt(T[5], x=three(vol))),
        (6, ~(vol > 0.02) & (vol < 0.01), _fmt(T[6], x=three(vol))),
        (7, F.col("volume_trend") == "INCREASING", F.lit(T[7])),
        (8, F.col("volume_trend") == "DECREASING", F.lit(T[8])),
        (9, ieee_div(res - cur, cur) * F.lit(100.0) < 1, _fmt(T[9], x=two(res))),
        (10, ieee_div(cur - sup, cur) * F.lit(100.0) < 1, _fmt(T[10], x=two(sup))),
        (11, reg == "trend", F.lit(T[11])),
        (12, (reg == "trend") & (F.col("momentum") == "BULLISH"), F.lit(T[12])),
        (13, (reg == "trend") & (F.col("momentum") != "BULLISH"), F.lit(T[13])),
        (14, reg == "chop", F.lit(T[14])),
        (15, reg == "chop", _fmt(T[15], s=two(sup), r=two(res))),
        (16, reg == "breakout", F.lit(T[16])),
        (17, reg == "breakout", F.lit(T[17])),
    ]
    values = {1: F.abs(chg), 2: F.abs(vd), 3: F.abs(vd), 5: vol, 6: vol, 9: res, 10: sup, 15: sup}
    arr = F.array(*[F.when(cond, F.struct(F.lit(i).alias("rule_id"), text.alias("text"),
                                          values.get(i, F.lit(None).cast("double")).cast("double").alias("value")))
                    for i, cond, text in items])
    arr = F.filter(arr, lambda x: x.isNotNull())
    return pa.select("symbol", F.explode(arr).alias("x")).select("symbol", "x.rule_id", "x.text", "x.value")


def report(pa: DataFrame, ins: DataFrame, regime_col: str = "dominant_regime") -> DataFrame:
    """Per-symbol text summary (markdown) built from price action and the numbered insights.

    The insight list of a symbol is bounded by the number of rules (17)."""
    lines = ins.groupBy("symbol").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rule_id", "text"))),
                                 lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["text"])),
                     "\n").alias("insight_lines"))
    j = pa.join(lines, "symbol", "left")
    text = F.concat_ws(
        "\n",
        F.format_string("# 📊 Stock Analysis: %s", F.col("symbol")),
        F.lit("## 📈 Price Action"),
        F.format_string("- **Current Price:** ₹%.2f", F.col("current_price")),
        F.format_string("- **Period Change:** %.2f%%", F.col("price_change_pct")),
        F.format_string("- **Momentum:** %s", F.col("momentum")),
        F.format_string("- **Volatility:** %.3f", F.col("volatility")),
        F.lit("## 🎯 Key Levels"),
        F.format_string("- **Resistance:** ₹%.2f", F.col("resistance")),
        F.format_string("- **Support:** ₹%.2f", F.col("support")),
        F.format_string("- **VWAP:** ₹%.2f (%s)", F.col("last_vwap"), F.col("vwap_position")),
        F.lit("## 📊 Volume Analysis"),
        F.format_string("- **Avg Volume:** %,d", F.col("avg_volume").cast("long")),
        F.format_string("- **Trend:** %s", F.col("volume_trend")),
        F.lit("## 🎯 Market Regime"),
        F.upper(F.coalesce(F.col(regime_col), F.lit("unknown"))),
        F.lit("## 💡 Actionable Insights"),
        F.coalesce(F.col("insight_lines"), F.lit("")),
        F.format_string("*Analysis based on %d candles*", F.col("bars")),
    )
    return j.select("symbol", text.alias("report"))
