"""Queries: nearest-bar join, exit grid, best policy, top-k, delta R, uplift,
trade paths and the end-to-end trade review."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import features_core, grid, joins, kpis, labels, regime
from ..params import DEFAULT, Params
from ..sources import fixtures
from ..session import shared_dir
from . import sqlparts as S
from .layout import Panel, index, layout
from .registry import query

BASE_SCENARIO = dict(entry_shift=0, exit_mode="tp_sl", tp_mult=1.0, sl_mult=1.0)


def base_scenario_id(p: Params = DEFAULT) -> int:
    for r in grid.scenario_rows(p):
        if (r[1], r[2], r[3], r[4]) == (0, "tp_sl", 1.0, 1.0):
            return r[0]
    raise ValueError("grid has no base scenario")


def entry_bars(spark, sf_dir, p: Params = DEFAULT) -> DataFrame:
    """Trades with the index of their nearest bar of bars_calm, and the number of bars of its symbol."""
    bars = index(fixtures.bars_calm(spark, sf_dir))
    return joins.nearest_bar(bars, fixtures.trades(spark, sf_dir), bar_cols=("ts", "rn", "n"))


def parallelism(spark) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Units whose scenarios (216 rows each) a task evaluates and ranks.
TASK_UNITS = 2000


def placed(spark, sf_dir, bars: DataFrame, trades: DataFrame) -> DataFrame:
    """Trades with their entry bar ``e`` and the bars ``n`` of their symbol; those without a bar are left out."""
    near = joins.nearest_bar(bars, trades, bar_cols=("ts", "rn", "n"))
    return near.filter("bar_rn is not null").withColumnsRenamed({"bar_rn": "e", "bar_n": "n"})


def entered(spark, sf_dir, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(indexed bars, trades with their entry bar ``e`` and the bars ``n`` of their symbol).

    Both are narrow and read several times below, so each is written once to the shared folder."""
    shared_dir(spark)
    bars = index(fixtures.bars_calm(spark, sf_dir)).checkpoint()
    return bars, placed(spark, sf_dir, bars, fixtures.trades(spark, sf_dir)).checkpoint()


@dataclass
class Entries:
    """``trades``: the keys and their ``uses``; ``rows``: their units by entry shift; ``panel``: featured bars of
    which those that some unit uses are marked; ``tasks``: into how many the evaluation is dealt."""

    trades: DataFrame
    rows: DataFrame
    panel: Panel
    tasks: int


def entry_rows(spark, sf_dir, p: Params = DEFAULT, keys: tuple[str, ...] = ("trade_id",), pooled: bool = True) -> Entries:
    """Entries of the trades, one row per ``keys`` whose rows are ranked together or, not ``pooled``, one per trade.

    Bars, trades and units are read several times, so each is written once to the shared folder."""
    shared_dir(spark)
    bars = index(fixtures.bars_calm(spark, sf_dir)).checkpoint()
    trades = fixtures.trades(spark, sf_dir)
    trades = placed(spark, sf_dir, bars, trades.select(*[c for c in trades.columns if c in (*keys, "symbol", "ts_open", "side")]))
    trades = grid.with_uses(trades, *keys) if pooled else trades.select(*keys, F.array(F.struct(*grid.USE)).alias("uses"))
    trades = trades.checkpoint()
    units = grid.units(trades).checkpoint()
    ent = grid.entries(units, p)
    pan = features_core.compute(layout(grid.mark(bars, ent), p, indexed=True), p)
    return Entries(trades, ent, pan, max(parallelism(spark), -(-units.count() // TASK_UNITS)))


def grid_results(spark, sf_dir, p: Params = DEFAULT, keys: tuple[str, ...] = ("trade_id",), scenarios: DataFrame | None = None,
                 pooled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(trades with their uses, results of the units)."""
    ent = entry_rows(spark, sf_dir, p, keys, pooled)
    sc = grid.scenarios(spark, p) if scenarios is None else scenarios
    return ent.trades, grid.evaluate(ent.rows, grid.with_forward(ent.panel, p).core(), sc, p, ent.tasks)


# ---------------------------------------------------------------- oracle SQL

def ctes_nearest(bars: str = "bidx", out: str = "nb") -> str:
    return f"""{out}_0 AS (
  SELECT t.*, b.rn AS bar_rn, b.ts AS bar_ts, b.n AS n,
         row_number() OVER (PARTITION BY t.trade_id ORDER BY abs(epoch_us(b.ts) - epoch_us(t.ts_open)), b.ts) AS k
  FROM trades t JOIN {bars} b ON b.symbol = t.symbol),
{out} AS (SELECT * EXCLUDE (k) FROM {out}_0 WHERE k = 1)"""


def scenario_values(p: Params = DEFAULT) -> str:
    rows = []
    for r in grid.scenario_rows(p):
        rows.append("(" + ", ".join([str(r[0]), str(r[1]), f"'{r[2]}'", repr(r[3]), repr(r[4]), str(r[5]),
                                     "true" if r[6] else "false"] + [repr(x) for x in r[7:]]) + ")")
    return ("sc AS (SELECT * FROM (VALUES " + ",\n  ".join(rows) + ") AS v(scenario_id, entry_shift, exit_mode, "
            "tp_mult, sl_mult, horizon, trail, m_tp_long, m_sl_long, m_tp_short, m_sl_short))")


def ctes_grid(p: Params = DEFAULT) -> list[str]:
    k = repr(p.cost)
    m = repr(p.trail_atr_mult)
    return [
        S.ctes_bars_calm(), S.ctes_trades(), S.ctes_core_features("bars_calm"), ctes_nearest("feat"),
        scenario_values(p),
        f"""g AS (
  SELECT nb.trade_id, nb.symbol, nb.side, s.*, greatest(0, least(nb.bar_rn + s.entry_shift, nb.n - 2)) AS entry_idx
  FROM nb CROSS JOIN sc s),
g1 AS (
  SELECT g.*, b.c AS entry_price,
         b.c * CASE WHEN g.side = 'long' THEN g.m_tp_long ELSE g.m_tp_short END AS tp_px,
         b.c * CASE WHEN g.side = 'long' THEN g.m_sl_long ELSE g.m_sl_short END AS sl0
  FROM g JOIN feat b ON b.symbol = g.symbol AND b.rn = g.entry_idx),
st AS (
  SELECT g1.trade_id, g1.scenario_id, g1.side, g1.tp_px, g1.entry_idx, g1.horizon, b.rn, b.h, b.l, b.c,
         CASE WHEN NOT g1.trail THEN g1.sl0
              WHEN g1.side = 'long' THEN greatest(g1.sl0, max(b.c - {m} * coalesce(b.atr, b.h - b.l)) OVER ws)
              ELSE least(g1.sl0, min(b.c + {m} * coalesce(b.atr, b.h - b.l)) OVER ws) END AS sl
  FROM g1 JOIN feat b ON b.symbol = g1.symbol AND b.rn > g1.entry_idx AND b.rn <= g1.entry_idx + g1.horizon
  WINDOW ws AS (PARTITION BY g1.trade_id, g1.scenario_id ORDER BY b.rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
gev AS (
  SELECT *, CASE WHEN side = 'long' THEN h >= tp_px ELSE l <= tp_px END AS tp_hit,
            CASE WHEN side = 'long' THEN l <= sl ELSE h >= sl END AS sl_hit FROM st),
fx AS (
  SELECT trade_id, scenario_id, min(rn) FILTER (WHERE tp_hit OR sl_hit OR rn = entry_idx + horizon) AS exit_rn
  FROM gev GROUP BY trade_id, scenario_id),
res0 AS (
  SELECT g1.*, fx.exit_rn, e.tp_hit, e.sl_hit, e.c AS exit_c, e.sl AS exit_sl
  FROM g1 LEFT JOIN fx ON fx.trade_id = g1.trade_id AND fx.scenario_id = g1.scenario_id
  LEFT JOIN gev e ON e.trade_id = g1.trade_id AND e.scenario_id = g1.scenario_id AND e.rn = fx.exit_rn),
res1 AS (
  SELECT *, CASE WHEN exit_rn IS NULL THEN 'timeout' WHEN tp_hit THEN 'tp' WHEN sl_hit THEN 'sl' ELSE 'time' END AS exit_reason,
         CASE WHEN exit_rn IS NULL THEN entry_price WHEN tp_hit THEN tp_px WHEN sl_hit THEN exit_sl ELSE exit_c END AS exit_price,
         coalesce(exit_rn, entry_idx) AS exit_idx
  FROM res0),
res AS (
  SELECT trade_id, symbol, side, scenario_id, entry_shift, exit_mode, tp_mult, sl_mult, entry_idx, entry_price,
         exit_idx, exit_price, exit_reason,
         CASE WHEN side = 'long' THEN (exit_price - entry_price) / entry_price - {k}
              ELSE (entry_price - exit_price) / entry_price - {k} END AS pnl_pct,
         exit_idx - entry_idx AS bars_held
  FROM res1),
rk AS (SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY pnl_pct DESC, scenario_id) AS rank FROM res)""",
    ]


GRID_COLS_SQL = ("trade_id, scenario_id, CAST(entry_shift AS BIGINT) AS entry_shift, exit_mode, tp_mult, sl_mult, "
                 "CAST(entry_idx AS BIGINT) AS entry_idx, " + S.R("entry_price") + " AS entry_price, "
                 "CAST(exit_idx AS BIGINT) AS exit_idx, " + S.R("exit_price") + " AS exit_price, exit_reason, "
                 + S.R("pnl_pct", 8) + " AS pnl_pct, CAST(bars_held AS BIGINT) AS bars_held")


def _grid_select(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(*extra,
        "trade_id", "scenario_id", "entry_shift", "exit_mode", "tp_mult", "sl_mult", "entry_idx",
        rnd("entry_price").alias("entry_price"), "exit_idx", rnd("exit_price").alias("exit_price"), "exit_reason",
        rnd("pnl_pct", 8).alias("pnl_pct"), "bars_held",
    )


# ---------------------------------------------------------------- queries

def ctes_index_calm() -> str:
    return """bidx AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn,
         count(*) OVER (PARTITION BY symbol) AS n FROM bars_calm)"""



@query("nearest_bar_join", lambda: S.with_(S.ctes_bars_calm(), S.ctes_trades(), ctes_index_calm(), ctes_nearest()) + (
    "SELECT trade_id, symbol, ts_open, bar_ts, CAST(bar_rn AS BIGINT) AS bar_rn FROM nb"))
def q_nearest_bar_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trade's nearest bar (same symbol, min |ts - t|, earlier bar on ties)."""
    return entry_bars(spark, sf_dir).select("trade_id", "symbol", "ts_open", "bar_ts", "bar_rn")


def _line(side_up: str, pct: str) -> str:
    """Price of a line ``pct`` away from the entry, on the ``side_up`` trade's upper side."""
    return f"entry_px * (CASE WHEN side = '{side_up}' THEN 1.0 + {pct} ELSE 1.0 - {pct} END)"


#: Lines of the fixture's trades: a target 1 % and a stop 0.5 % away; a quantity divisible by 4 has no
#: target, one divisible by 5 a stop of zero.
TARGET_SQL = f"CASE WHEN qty % 4 <> 0 THEN {_line('long', '0.01')} END"
STOP_SQL = f"CASE WHEN qty % 5 = 0 THEN 0.0 ELSE {_line('short', '0.005')} END"


@query("trade_marks", lambda: S.with_(S.ctes_bars_calm(), S.ctes_trades(), ctes_index_calm(), ctes_nearest(),
       f"lines AS (SELECT *, {TARGET_SQL} AS tp, {STOP_SQL} AS sl FROM nb)") + f"""
SELECT trade_id, symbol, 'entry' AS kind, bar_ts AS ts, {S.R('entry_px')} AS price FROM lines
UNION ALL SELECT trade_id, symbol, 'target', NULL, {S.R('tp')} FROM lines WHERE tp <> 0
UNION ALL SELECT trade_id, symbol, 'stop', NULL, {S.R('sl')} FROM lines WHERE sl <> 0""")
def q_trade_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry point at the nearest bar, target line and stop line of every trade."""
    entries = entry_bars(spark, sf_dir).selectExpr("*", f"{TARGET_SQL} AS tp", f"{STOP_SQL} AS sl")
    return joins.trade_marks(entries).select("trade_id", "symbol", "kind", "ts", rnd("price").alias("price"))


@query("entry_window", lambda: S.with_(S.ctes_bars_calm(), S.ctes_trades(), ctes_index_calm(), ctes_nearest()) + (
    f"SELECT nb.trade_id, nb.symbol, CAST(b.rn - nb.bar_rn AS BIGINT) AS \"offset\", b.ts, {S.R('b.o')} AS o, {S.R('b.h')} AS h, "
    f"{S.R('b.l')} AS l, {S.R('b.c')} AS c FROM nb JOIN bidx b ON b.symbol = nb.symbol AND b.rn >= nb.bar_rn - 20 AND b.rn < nb.bar_rn + 30"))
def q_entry_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: the bars around every trade's entry, 20 before it and 30 from it on."""
    entries = entry_bars(spark, sf_dir).select("trade_id", "symbol", "bar_rn")
    got = joins.entry_window(index(fixtures.bars_calm(spark, sf_dir)), entries)
    return got.select("trade_id", "symbol", "offset", "ts", *[rnd(c).alias(c) for c in ("o", "h", "l", "c")])


@query("grid_216", lambda: S.with_(*ctes_grid()) + f"SELECT {GRID_COLS_SQL}, rank FROM rk")
def q_grid_216(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 (with C1, C2): all 216 scenarios of every trade, ranked by pnl (ties: grid order)."""
    trades, res = grid_results(spark, sf_dir)
    return _grid_select(grid.of_trades(trades, grid.ranked(res)), "rank")


@query("scenario_eval", lambda: S.with_(*ctes_grid()) + f"SELECT {GRID_COLS_SQL} FROM res WHERE scenario_id = {base_scenario_id()}")
def q_scenario_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base scenario (actual entry, tp_sl, 1x/1x) of every trade, long and short."""
    sc = grid.scenarios(spark).filter(F.col("scenario_id") == base_scenario_id())
    return _grid_select(grid.of_trades(*grid_results(spark, sf_dir, scenarios=sc, pooled=False)))


@query("scenario_trail", lambda: S.with_(*ctes_grid()) + f"SELECT {GRID_COLS_SQL} FROM res WHERE exit_mode = 'atr_trail'")
def q_scenario_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ATR trailing-stop scenarios of every trade."""
    sc = grid.scenarios(spark).filter(F.col("trail"))
    return _grid_select(grid.of_trades(*grid_results(spark, sf_dir, scenarios=sc, pooled=False)))


@query("best_policy", lambda: S.with_(*ctes_grid()) + f"SELECT {GRID_COLS_SQL} FROM rk WHERE rank = 1")
def q_best_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: best scenario per trade."""
    trades, res = grid_results(spark, sf_dir)
    return _grid_select(grid.of_trades(trades, grid.best(res)))


@query("top_k_scenarios", lambda: S.with_(*ctes_grid()) + f"SELECT {GRID_COLS_SQL}, rank FROM rk WHERE rank <= 10")
def q_top_k_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best scenarios per trade."""
    trades, res = grid_results(spark, sf_dir)
    return _grid_select(grid.of_trades(trades, grid.top_k(res, 10)), "rank")


def actual_vs_best(spark, sf_dir, p: Params = DEFAULT) -> DataFrame:
    """Each trade's base-scenario result beside its best scenario."""
    trades, res = grid_results(spark, sf_dir, p, ("trade_id", "symbol"))
    both = grid.of_trades(trades, grid.actual_and_best(res, base_scenario_id(p)))
    return both.select("trade_id", "symbol", F.col("actual.pnl_pct").alias("actual_pnl"),
                       F.col("actual.exit_reason").alias("actual_exit"), "best.*")


def ctes_avb() -> str:
    return f"""avb AS (
  SELECT a.trade_id, a.symbol, a.pnl_pct AS actual_pnl, a.exit_reason AS actual_exit, b.scenario_id, b.exit_mode,
         b.entry_shift, b.tp_mult, b.sl_mult, b.pnl_pct AS best_pnl
  FROM res a JOIN rk b ON b.trade_id = a.trade_id AND b.rank = 1 WHERE a.scenario_id = {base_scenario_id()})"""


@query("delta_r", lambda: S.with_(*ctes_grid(), ctes_avb()) + (
    f"SELECT trade_id, {S.R('actual_pnl', 8)} AS actual_pnl, {S.R('best_pnl', 8)} AS best_pnl, "
    f"{S.R('best_pnl / 1.0 - actual_pnl / 1.0', 8)} AS delta_r FROM avb"))
def q_delta_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best minus actual in R (risk 1.0) for every trade."""
    j = actual_vs_best(spark, sf_dir)
    return j.select("trade_id", rnd("actual_pnl", 8).alias("actual_pnl"), rnd("pnl_pct", 8).alias("best_pnl"),
                    rnd(grid.delta_r(F.col("actual_pnl"), F.col("pnl_pct"), 1.0), 8).alias("delta_r"))


@query("counterfactual_uplift", lambda: S.with_(*ctes_grid(), ctes_avb()) + (
    f"SELECT symbol, {S.R('coalesce(sum(best_pnl - actual_pnl) FILTER (WHERE best_pnl - actual_pnl > 0), 0.0)', 8)} AS avoidable_loss, "
    f"{S.R('sum(best_pnl - actual_pnl)', 8)} AS expected_uplift, "
    f"{S.R(f'avg((best_pnl - actual_pnl) / {DEFAULT.risk_per_trade!r})', 6)} AS avg_delta_r, "
    "count(*) FILTER (WHERE best_pnl - actual_pnl > 0) AS improvable_trades FROM avb GROUP BY symbol"))
def q_counterfactual_uplift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: avoidable loss, expected uplift, avg delta R and improvable trades per symbol."""
    d = actual_vs_best(spark, sf_dir).withColumn("delta_pnl", F.col("pnl_pct") - F.col("actual_pnl"))
    u = kpis.uplift(d, ["symbol"])
    return u.select("symbol", rnd("avoidable_loss", 8).alias("avoidable_loss"),
                    rnd("expected_uplift", 8).alias("expected_uplift"), rnd("avg_delta_r", 6).alias("avg_delta_r"),
                    "improvable_trades")


@query("trade_path_join", lambda: S.with_(S.ctes_bars_calm(), S.ctes_trades(), ctes_index_calm(), ctes_nearest()) + f"""
SELECT nb.trade_id, CAST(count(b.rn) AS BIGINT) AS fwd_bars, {S.R('max(b.h)')} AS fwd_high, {S.R('min(b.l)')} AS fwd_low
FROM nb LEFT JOIN bidx b ON b.symbol = nb.symbol AND b.rn > nb.bar_rn AND b.rn <= nb.bar_rn + {DEFAULT.timeout_bars}
GROUP BY nb.trade_id""")
def q_trade_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trade joined to the forward bars of its symbol (next 16): count, high, low."""
    bars, trades = entered(spark, sf_dir)
    pan = layout(bars, indexed=True)
    ahead = pan.w.rowsBetween(1, DEFAULT.timeout_bars)
    paths = pan.with_df(pan.df.select(
        "symbol", F.col("rn").alias("e"), "blk", "core", F.count(F.col("c")).over(ahead).alias("fwd_bars"),
        F.max("h").over(ahead).alias("fwd_high"), F.min("l").over(ahead).alias("fwd_low"))).core()
    return trades.select("trade_id", "symbol", "e").join(paths, ["symbol", "e"]).select(
        "trade_id", "fwd_bars", rnd("fwd_high").alias("fwd_high"), rnd("fwd_low").alias("fwd_low"))


# ---------------------------------------------------------------- flagship

REVIEW_FEATURES = ["vwap_dist", "atr_pct", "volume_ratio_5"]


def trade_review_df(spark, sf_dir, p: Params = DEFAULT) -> DataFrame:
    trade = ("symbol", "ts_open", "side", "qty")
    ent = entry_rows(spark, sf_dir, p, ("trade_id", *trade, "e"))
    pan = regime.classify(ent.panel, p)
    # an entry without shift uses the trade's bar or, where that is the last one, the bar before it:
    # the features of both go with the entry bar, so the bars are laid out once
    at_entry = (*REVIEW_FEATURES, "regime")
    pan = pan.with_df(pan.df.select("*", *[F.lead(c).over(pan.w).alias(f"next_{c}") for c in at_entry]))
    core, seen = grid.with_forward(pan, p).core(), (*at_entry, *[f"next_{c}" for c in at_entry])
    res = grid.evaluate(ent.rows, core, grid.scenarios(spark, p), p, ent.tasks, carry_bar=seen)
    out = grid.of_trades(ent.trades, grid.actual_and_best(res, base_scenario_id(p), carry_bar=seen)).select(
        "trade_id", *trade, "e",
        *[F.when(F.col("actual.entry_idx") == F.col("e"), F.col(f"actual.{c}")).otherwise(F.col(f"actual.next_{c}")).alias(c)
          for c in at_entry],
        F.col("actual.pnl_pct").alias("actual_pnl"), F.col("actual.exit_reason").alias("actual_exit"),
        F.col("actual.bars_held").alias("actual_bars_held"),
        F.col("best.scenario_id").alias("best_scenario"), F.col("best.exit_mode").alias("best_exit_mode"),
        F.col("best.entry_shift").alias("best_shift"), F.col("best.tp_mult").alias("best_tp_mult"),
        F.col("best.sl_mult").alias("best_sl_mult"), F.col("best.pnl_pct").alias("best_pnl"))
    delta = F.col("best_pnl") - F.col("actual_pnl")
    return out.select(
        "trade_id", "symbol", "ts_open", "side", "qty", F.col("e").alias("entry_idx"),
        *[rnd(c).alias(c) for c in REVIEW_FEATURES], "regime",
        rnd("actual_pnl", 8).alias("actual_pnl"), "actual_exit", "actual_bars_held",
        "best_scenario", "best_exit_mode", "best_shift", "best_tp_mult", "best_sl_mult",
        rnd("best_pnl", 8).alias("best_pnl"), rnd(delta, 8).alias("delta_pnl"),
        rnd(delta / F.lit(p.risk_per_trade), 6).alias("delta_r"),
        F.when(F.col("actual_pnl") > 0, F.lit("take")).otherwise(F.lit("skip")).alias("verdict"),
    )


def _review_sql() -> str:
    parts = ctes_grid()
    parts.insert(3, S.ctes_regime("feat", out="reg"))
    return S.with_(*parts, ctes_avb()) + f"""
SELECT a.trade_id, a.symbol, t.ts_open, t.side, t.qty, CAST(nb.bar_rn AS BIGINT) AS entry_idx,
       {S.R('r.vwap_dist')} AS vwap_dist, {S.R('r.atr_pct')} AS atr_pct, {S.R('r.volume_ratio_5')} AS volume_ratio_5,
       r.regime, {S.R('a.actual_pnl', 8)} AS actual_pnl, a.actual_exit, CAST(x.bars_held AS BIGINT) AS actual_bars_held,
       a.scenario_id AS best_scenario, a.exit_mode AS best_exit_mode, CAST(a.entry_shift AS BIGINT) AS best_shift,
       a.tp_mult AS best_tp_mult, a.sl_mult AS best_sl_mult, {S.R('a.best_pnl', 8)} AS best_pnl,
       {S.R('a.best_pnl - a.actual_pnl', 8)} AS delta_pnl,
       {S.R(f'(a.best_pnl - a.actual_pnl) / {DEFAULT.risk_per_trade!r}', 6)} AS delta_r,
       CASE WHEN a.actual_pnl > 0 THEN 'take' ELSE 'skip' END AS verdict
FROM avb a JOIN trades t ON t.trade_id = a.trade_id JOIN nb ON nb.trade_id = a.trade_id
JOIN reg r ON r.symbol = a.symbol AND r.rn = nb.bar_rn
JOIN res x ON x.trade_id = a.trade_id AND x.scenario_id = {base_scenario_id()}"""


@query("trade_review", _review_sql)
def q_trade_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 (flagship): trade, features and regime at entry, actual vs best policy, delta PnL/R, verdict."""
    return trade_review_df(spark, sf_dir)


# ---------------------------------------------------------------- daily summary

def _daily_sql() -> str:
    from .q_io import summary_select
    from .q_labels import ctes_meta

    parts = [*ctes_grid(), S.ctes_regime("feat"), ctes_meta("reg")]
    return S.with_(*parts, "dm AS (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS review_date FROM ml)",
                   f"ds AS ({summary_select('symbol, review_date', 'dm')})", f"""dp AS (
  SELECT r.symbol, CAST(CAST(t.ts_open AS DATE) AS VARCHAR) AS review_date, r.scenario_id, r.exit_mode, r.entry_shift, r.tp_mult, r.sl_mult,
         {S.R('avg(r.pnl_pct)', 10)} AS mean_pnl, count(*) AS trades
  FROM res r JOIN trades t ON t.trade_id = r.trade_id GROUP BY ALL),
db AS (SELECT *, row_number() OVER (PARTITION BY symbol, review_date ORDER BY mean_pnl DESC, scenario_id) AS k FROM dp)""") + f"""
SELECT ds.*, coalesce(db.trades, 0) AS trades, db.scenario_id AS best_scenario, db.exit_mode AS best_exit_mode,
       CAST(db.entry_shift AS BIGINT) AS best_shift, db.tp_mult AS best_tp_mult, db.sl_mult AS best_sl_mult, {S.R('db.mean_pnl', 8)} AS best_pnl
FROM ds LEFT JOIN db ON db.symbol = ds.symbol AND db.review_date = ds.review_date AND db.k = 1"""


@query("review_summary_by_date", _daily_sql)
def q_review_summary_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a symbol and day: bars, signals, win rate, avg R, profit factor, regime %, and the exit
    policy with the highest mean pnl over the trades opened that day (none: nulls)."""
    from . import q_io

    p = DEFAULT
    ent = entry_rows(spark, sf_dir, p, ("symbol", "ts_open"), pooled=False)
    labelled = labels.meta_labels(regime.classify(ent.panel, p), p).core()
    days = q_io.review_summary(labelled.withColumn("review_date", F.date_format("ts", "yyyy-MM-dd")), "symbol", "review_date")
    key = ("symbol", "review_date")
    trades = ent.trades.withColumn("review_date", F.date_format("ts_open", "yyyy-MM-dd"))
    trades = trades.groupBy(*key, "uses").agg(F.count(F.lit(1)).alias("alike"))
    res = grid.evaluate(ent.rows, grid.with_forward(ent.panel, p).core(), grid.scenarios(spark, p), p, ent.tasks)
    both = days.join(grid.best_policy_of(grid.of_trades(trades, res), *key, weight="alike"), list(key), "left")
    return q_io.summary_out(
        both, *key, F.coalesce("trades", F.lit(0)).alias("trades"), F.col("scenario_id").alias("best_scenario"),
        F.col("exit_mode").alias("best_exit_mode"), F.col("entry_shift").cast("long").alias("best_shift"),
        F.col("tp_mult").alias("best_tp_mult"), F.col("sl_mult").alias("best_sl_mult"), rnd("mean_pnl", 8).alias("best_pnl"))
