"""Trading cost and triple-barrier labels.

The barrier scan looks at most ``timeout_bars`` bars ahead, so it is a
fixed-width forward frame: one ``lead`` per offset and a CASE that returns
the first offset whose bar touches a barrier (take profit tested before stop
loss within a bar). Everything stays in one codegen'd projection over the
shared (symbol, blk) window; no join, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import col, ieee_div
from ..params import DEFAULT, Params
from ..plans.layout import Panel


def cost(avg_volume=None, order_qty=None, p: Params = DEFAULT) -> Column:
    """(fees + base slippage + min(impact * sqrt(qty / max(avg_volume, 1)), cap)) / 1e4.

    Impact is added only when both inputs are given, non-null and non-zero.
    """
    base = F.lit(p.fees_bps + p.slippage_base_bps)
    if avg_volume is None or order_qty is None:
        return base / F.lit(10000.0)
    av, q = col(avg_volume).cast("double"), col(order_qty).cast("double")
    impact = F.lit(p.impact_coef) * F.sqrt(q / F.greatest(av, F.lit(1.0)))
    has = av.isNotNull() & q.isNotNull() & (av != 0) & (q != 0)
    total = F.when(has, base + F.least(impact, F.lit(p.max_slippage_bps))).otherwise(base)
    return total / F.lit(10000.0)


def barrier_multipliers(side: str, tp_pct: float, sl_pct: float, cost_: float) -> tuple[float, float]:
    """Price multipliers of the take-profit and stop-loss barriers."""
    if side == "long":
        return 1 + tp_pct - cost_, 1 - sl_pct - cost_
    return 1 - tp_pct - cost_, 1 + sl_pct + cost_


def triple_barrier(panel: Panel, side: str = "long", p: Params = DEFAULT, entry: str = "c",
                   prefix: str = "") -> Panel:
    """Label every bar as an entry at its close: exit offset, return and reason.

    Adds ``{prefix}exit_rn``, ``{prefix}realized_return``, ``{prefix}exit_reason``
    ('tp', 'sl', 'timeout', or 'no_exit' on a symbol's last bar).
    """
    w = panel.w
    k = p.cost
    H = p.timeout_bars
    m_tp, m_sl = barrier_multipliers(side, p.tp_pct, p.sl_pct, k)
    e = F.col(entry)
    tp_px, sl_px = e * F.lit(m_tp), e * F.lit(m_sl)
    hit = None
    for i in range(1, H + 1):
        h_i, l_i = F.lead("h", i).over(w), F.lead("l", i).over(w)
        if side == "long":
            tp_hit, sl_hit = h_i >= tp_px, l_i <= sl_px
        else:
            tp_hit, sl_hit = l_i <= tp_px, h_i >= sl_px
        hit = (F.when(tp_hit, F.lit(i)) if hit is None else hit.when(tp_hit, F.lit(i))).when(sl_hit, F.lit(-i))
    last_close = F.coalesce(*[F.lead("c", i).over(w) for i in range(H, 0, -1)])
    df = panel.df.select("*", hit.alias("_hit"), last_close.alias("_last_c"))
    rn, n = F.col("rn"), F.col("n")
    hit = F.col("_hit")  # bars until the first touch, below 0 of the stop loss
    last_off = F.least(F.lit(H), n - 1 - rn)
    exit_px = F.when(hit > 0, tp_px).when(hit < 0, sl_px).otherwise(F.col("_last_c"))
    if side == "long":
        ret = ieee_div(exit_px - e, e) - F.lit(k)
    else:
        ret = ieee_div(e - exit_px, e) - F.lit(k)
    at_end = rn >= n - 1
    df = df.select(
        *panel.df.columns,
        F.when(at_end, rn).when(hit.isNotNull(), rn + F.abs(hit)).otherwise(rn + last_off)
        .alias(f"{prefix}exit_rn"),
        F.when(at_end, F.lit(0.0)).otherwise(ret).alias(f"{prefix}realized_return"),
        F.when(at_end, F.lit("no_exit")).when(hit > 0, F.lit("tp")).when(hit < 0, F.lit("sl")).otherwise(F.lit("timeout"))
        .alias(f"{prefix}exit_reason"),
    )
    return panel.with_df(df)


def meta_labels(panel: Panel, p: Params = DEFAULT) -> Panel:
    """Long labels for signal bars (base_score > threshold); other bars 0 / 0.0 / 'no_signal'."""
    lab = triple_barrier(panel, "long", p, prefix="_tb_")
    sig = F.col("base_score") > F.lit(p.signal_threshold)
    df = lab.df.select(
        *panel.df.columns,
        F.when(sig & (F.col("_tb_realized_return") > 0), F.lit(1)).otherwise(F.lit(0)).cast("long")
        .alias("meta_label"),
        F.when(sig, F.col("_tb_realized_return")).otherwise(F.lit(0.0)).alias("realized_return"),
        F.when(sig, F.col("_tb_exit_reason")).otherwise(F.lit("no_signal")).alias("exit_reason"),
        F.when(sig, F.col("_tb_exit_rn") - F.col("rn")).cast("long").alias("bars_held"),
    )
    return panel.with_df(df)
