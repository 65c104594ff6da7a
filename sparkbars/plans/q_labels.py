"""Queries: trading cost, triple-barrier labels, meta labels, label balance, KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import kpis, labels
from ..params import DEFAULT, Params
from ..sources import fixtures
from . import sqlparts as S
from .layout import layout
from .q_features import regime_panel
from .registry import query


def ctes_index(src: str, out: str = "idx") -> str:
    return f"""{out} AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn,
         count(*) OVER (PARTITION BY symbol) AS n FROM {src})"""


def ctes_barrier(src: str, side: str = "long", out: str = "tb", p: Params = DEFAULT) -> str:
    m_tp, m_sl = labels.barrier_multipliers(side, p.tp_pct, p.sl_pct, p.cost)
    k, H = repr(p.cost), p.timeout_bars
    if side == "long":
        tp_c, sl_c = "b.h >= e.tp_px", "b.l <= e.sl_px"
        ret = "({px} - e.e) / e.e - " + k
    else:
        tp_c, sl_c = "b.l <= e.tp_px", "b.h >= e.sl_px"
        ret = "(e.e - {px}) / e.e - " + k
    return f"""{out}_e AS (
  SELECT symbol, ts, rn, n, c AS e, c * {m_tp!r} AS tp_px, c * {m_sl!r} AS sl_px FROM {src}),
{out}_j AS (
  SELECT e.symbol, e.rn, min(b.rn) FILTER (WHERE {tp_c} OR {sl_c}) AS hit_rn, max(b.rn) AS last_rn
  FROM {out}_e e JOIN {src} b ON b.symbol = e.symbol AND b.rn BETWEEN e.rn + 1 AND e.rn + {H}
  GROUP BY e.symbol, e.rn),
{out} AS (
  SELECT e.symbol, e.ts, e.rn,
         CASE WHEN e.rn >= e.n - 1 THEN e.rn WHEN j.hit_rn IS NOT NULL THEN j.hit_rn ELSE j.last_rn END AS exit_rn,
         CASE WHEN e.rn >= e.n - 1 THEN 0.0
              WHEN j.hit_rn IS NULL THEN {ret.format(px='lb.c')}
              WHEN {tp_c.replace('b.', 'hb.')} THEN {ret.format(px='e.tp_px')}
              ELSE {ret.format(px='e.sl_px')} END AS realized_return,
         CASE WHEN e.rn >= e.n - 1 THEN 'no_exit' WHEN j.hit_rn IS NULL THEN 'timeout'
              WHEN {tp_c.replace('b.', 'hb.')} THEN 'tp' ELSE 'sl' END AS exit_reason
  FROM {out}_e e LEFT JOIN {out}_j j ON j.symbol = e.symbol AND j.rn = e.rn
  LEFT JOIN {src} hb ON hb.symbol = e.symbol AND hb.rn = j.hit_rn
  LEFT JOIN {src} lb ON lb.symbol = e.symbol AND lb.rn = j.last_rn)"""


def _barrier_sql(side: str) -> str:
    return S.with_(S.ctes_bars_panel(), ctes_index("bars_panel"), ctes_barrier("idx", side)) + (
        f"SELECT symbol, ts, CAST(exit_rn - rn AS BIGINT) AS bars_held, {S.R('realized_return', 8)} AS realized_return,"
        " exit_reason FROM tb"
    )


def _barrier(spark, sf_dir, side):
    pan = labels.triple_barrier(layout(fixtures.bars_panel(spark, sf_dir)), side)
    return pan.core().select(
        "symbol", "ts", (F.col("exit_rn") - F.col("rn")).cast("long").alias("bars_held"),
        rnd("realized_return", 8).alias("realized_return"), "exit_reason",
    )


@query("triple_barrier_long", lambda: _barrier_sql("long"))
def q_triple_barrier_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: long triple-barrier outcome of an entry at every bar's close."""
    return _barrier(spark, sf_dir, "long")


@query("triple_barrier_short", lambda: _barrier_sql("short"))
def q_triple_barrier_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: short triple-barrier outcome of an entry at every bar's close."""
    return _barrier(spark, sf_dir, "short")


def ctes_meta(src: str = "idx", out: str = "ml", p: Params = DEFAULT) -> str:
    return ctes_barrier(src, "long", out + "_tb") + f""",
{out} AS (
  SELECT s.*, CAST(CASE WHEN s.base_score > {p.signal_threshold} AND t.realized_return > 0 THEN 1 ELSE 0 END AS BIGINT) AS meta_label,
         CASE WHEN s.base_score > {p.signal_threshold} THEN t.realized_return ELSE 0.0 END AS realized_return,
         CASE WHEN s.base_score > {p.signal_threshold} THEN t.exit_reason ELSE 'no_signal' END AS exit_reason,
         CASE WHEN s.base_score > {p.signal_threshold} THEN CAST(t.exit_rn - t.rn AS BIGINT) END AS bars_held
  FROM {src} s JOIN {out}_tb t ON t.symbol = s.symbol AND t.rn = s.rn)"""


def meta_df(spark, sf_dir, p: Params = DEFAULT) -> DataFrame:
    return labels.meta_labels(layout(fixtures.bars_panel(spark, sf_dir), p), p).core()


@query("meta_labels", lambda: S.with_(S.ctes_bars_panel(), ctes_index("bars_panel"), ctes_meta()) + (
    f"SELECT symbol, ts, meta_label, {S.R('realized_return', 8)} AS realized_return, exit_reason, bars_held FROM ml"))
def q_meta_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar with its meta label (signal bars labelled, others 'no_signal')."""
    return meta_df(spark, sf_dir).select(
        "symbol", "ts", "meta_label", rnd("realized_return", 8).alias("realized_return"), "exit_reason", "bars_held"
    )


REASONS = ["tp", "sl", "timeout", "no_exit"]


@query("label_balance", lambda: S.with_(S.ctes_bars_panel(), ctes_index("bars_panel"), ctes_meta()) + (
    "SELECT symbol, count(*) AS labelled, CAST(sum(meta_label) AS BIGINT) AS positives, "
    + ", ".join(f"count(*) FILTER (WHERE exit_reason = '{r}') AS n_{r}" for r in REASONS)
    + f" FROM ml WHERE base_score > {DEFAULT.signal_threshold} GROUP BY symbol"))
def q_label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled signal bars, positives and exit reasons per symbol."""
    m = meta_df(spark, sf_dir).filter(F.col("base_score") > DEFAULT.signal_threshold)
    return m.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("labelled"),
        F.sum("meta_label").cast("long").alias("positives"),
        *[F.count_if(F.col("exit_reason") == r).alias(f"n_{r}") for r in REASONS],
    )


def _cost_sql(p: Params = DEFAULT) -> str:
    base = p.fees_bps + p.slippage_base_bps
    return S.with_(S.ctes_bars_calm(), S.ctes_trades(),
                   "av AS (SELECT symbol, avg(v) AS avg_volume FROM bars_calm GROUP BY symbol)") + f"""
SELECT t.trade_id, {S.R(f'''CASE WHEN a.avg_volume IS NOT NULL AND t.qty IS NOT NULL AND a.avg_volume != 0 AND t.qty != 0
   THEN {base!r} + least({p.impact_coef!r} * sqrt(CAST(t.qty AS DOUBLE) / greatest(a.avg_volume, 1.0)), {p.max_slippage_bps!r})
   ELSE {base!r} END / 10000.0''', 10)} AS cost
FROM trades t LEFT JOIN av a ON a.symbol = t.symbol"""


@query("trade_cost", _cost_sql)
def q_trade_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: cost of every trade, with market impact from the symbol's mean bar volume."""
    av = fixtures.bars_calm(spark, sf_dir).groupBy("symbol").agg(F.avg("v").alias("avg_volume"))
    t = fixtures.trades(spark, sf_dir).join(av, "symbol", "left")
    return t.select("trade_id", rnd(labels.cost("avg_volume", "qty"), 10).alias("cost"))


def _kpi_select(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, "total_trades", *[rnd(c, 8).alias(c) for c in kpis.KPI_COLS[1:]])


def _kpi_sql(keys: list[str], src_ctes: list[str], src: str) -> str:
    k = ", ".join(keys)
    x = "realized_return"
    thr = DEFAULT.signal_threshold
    body = f"""SELECT {k}, count(*) AS total_trades,
  {S.R(f'count(*) FILTER (WHERE {x} > 0) / count(*)', 8)} AS win_rate,
  {S.R(f'sum({x})', 8)} AS total_pnl_pct, {S.R(f'avg({x})', 8)} AS avg_pnl_pct,
  {S.R(f'coalesce(avg({x}) FILTER (WHERE {x} > 0), 0.0)', 8)} AS avg_win_pct,
  {S.R(f'coalesce(avg({x}) FILTER (WHERE {x} <= 0), 0.0)', 8)} AS avg_loss_pct,
  {S.R(f'''CASE WHEN count(*) FILTER (WHERE {x} <= 0) > 0 AND sum({x}) FILTER (WHERE {x} <= 0) != 0
     THEN abs(coalesce(sum({x}) FILTER (WHERE {x} > 0), 0.0) / sum({x}) FILTER (WHERE {x} <= 0)) ELSE 0.0 END''', 8)} AS profit_factor,
  {S.R(f'avg({x} / {DEFAULT.risk_per_trade!r})', 8)} AS avg_r_multiple,
  {S.R('coalesce(avg(bars_held), 0.0)', 8)} AS avg_bars_held
FROM {src} WHERE base_score > {thr} GROUP BY {k}"""
    return S.with_(*src_ctes) + body


def labelled_signals(spark, sf_dir, with_regime=False) -> DataFrame:
    bars = fixtures.bars_panel(spark, sf_dir)
    if with_regime:
        pan = labels.meta_labels(regime_panel(bars))
    else:
        pan = labels.meta_labels(layout(bars))
    return pan.core().filter(F.col("base_score") > DEFAULT.signal_threshold).withColumnRenamed(
        "realized_return", "pnl_pct"
    )


@query("trade_kpis", lambda: _kpi_sql(["symbol"], [S.ctes_bars_panel(), ctes_index("bars_panel"), ctes_meta()], "ml"))
def q_trade_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: KPIs of every labelled signal bar, per symbol."""
    return _kpi_select(kpis.trade_kpis(labelled_signals(spark, sf_dir), ["symbol"]), ["symbol"])


@query("exit_breakdown", lambda: S.with_(S.ctes_bars_panel(), ctes_index("bars_panel"), ctes_meta()) + (
    f"SELECT symbol, exit_reason, count(*) AS trades FROM ml WHERE base_score > {DEFAULT.signal_threshold} "
    "GROUP BY symbol, exit_reason"))
def q_exit_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: trades per exit reason, per symbol (flat rows)."""
    return kpis.exit_breakdown(labelled_signals(spark, sf_dir), ["symbol"]).select(
        "symbol", "exit_reason", F.col("trades").cast("long").alias("trades"))


def _regime_kpi_sql() -> str:
    return _kpi_sql(
        ["symbol", "regime"],
        [S.ctes_bars_panel(), S.ctes_core_features("bars_panel"), S.ctes_regime(), ctes_meta("reg")],
        "ml",
    )


@query("regime_kpis", _regime_kpi_sql)
def q_regime_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: KPIs per (symbol, regime) in one aggregate."""
    keys = ["symbol", "regime"]
    return _kpi_select(kpis.trade_kpis(labelled_signals(spark, sf_dir, True), keys), keys)
