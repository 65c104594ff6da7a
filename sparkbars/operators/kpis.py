"""Trade KPIs, exit breakdown, per-regime KPIs and counterfactual uplift.

Each is one hash aggregate with conditional sums (partial aggregation before
the shuffle), grouped by whatever keys the caller passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT, Params

KPI_COLS = ["total_trades", "win_rate", "total_pnl_pct", "avg_pnl_pct", "avg_win_pct", "avg_loss_pct",
            "profit_factor", "avg_r_multiple", "avg_bars_held"]


def trade_kpis(trades: DataFrame, keys: list[str], pnl: str = "pnl_pct", held: str = "bars_held",
               p: Params = DEFAULT) -> DataFrame:
    """total, win rate (pnl > 0), total/avg pnl, avg win, avg loss (pnl <= 0),
    profit factor |sum win / sum loss| (0 when undefined), avg R (pnl / risk), avg bars held."""
    x = F.col(pnl)
    win, loss = x > 0, x <= 0
    agg = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.count_if(win).alias("_wins"),
        F.count_if(loss).alias("_losses"),
        F.sum(x).alias("total_pnl_pct"),
        F.avg(x).alias("avg_pnl_pct"),
        F.sum(F.when(win, x)).alias("_sum_win"),
        F.sum(F.when(loss, x)).alias("_sum_loss"),
        F.avg(F.when(win, x)).alias("_avg_win"),
        F.avg(F.when(loss, x)).alias("_avg_loss"),
        F.avg(x / F.lit(p.risk_per_trade)).alias("avg_r_multiple"),
        F.avg(F.col(held)).alias("avg_bars_held"),
    )
    sum_win = F.coalesce(F.col("_sum_win"), F.lit(0.0))
    pf = F.when((F.col("_losses") > 0) & (F.col("_sum_loss") != 0), F.abs(sum_win / F.col("_sum_loss"))).otherwise(
        F.lit(0.0)
    )
    return agg.select(
        *keys,
        F.col("total_trades").cast("long").alias("total_trades"),
        # without keys there is a row for no trades too: all zeros
        F.coalesce(F.col("_wins") / F.nullif("total_trades", F.lit(0)), F.lit(0.0)).alias("win_rate"),
        F.coalesce("total_pnl_pct", F.lit(0.0)).alias("total_pnl_pct"),
        F.coalesce("avg_pnl_pct", F.lit(0.0)).alias("avg_pnl_pct"),
        F.coalesce(F.col("_avg_win"), F.lit(0.0)).alias("avg_win_pct"),
        F.coalesce(F.col("_avg_loss"), F.lit(0.0)).alias("avg_loss_pct"),
        pf.alias("profit_factor"),
        F.coalesce("avg_r_multiple", F.lit(0.0)).alias("avg_r_multiple"),
        F.coalesce(F.col("avg_bars_held"), F.lit(0.0)).alias("avg_bars_held"),
    )


def exit_breakdown(trades: DataFrame, keys: list[str], reason: str = "exit_reason") -> DataFrame:
    """Count of trades per exit reason."""
    return trades.groupBy(*keys, reason).agg(F.count(F.lit(1)).alias("trades"))


def uplift(deltas: DataFrame, keys: list[str], delta: str = "delta_pnl", p: Params = DEFAULT) -> DataFrame:
    """avoidable loss (sum of positive deltas), expected uplift (sum), avg delta R, improvable count."""
    d = F.col(delta)
    return deltas.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(d > 0, d)), F.lit(0.0)).alias("avoidable_loss"),
        F.sum(d).alias("expected_uplift"),
        F.avg(d / F.lit(p.risk_per_trade)).alias("avg_delta_r"),
        F.count_if(d > 0).cast("long").alias("improvable_trades"),
    )
