"""SQL text of the fixtures and the first feature steps, for the DuckDB oracle.

Each oracle query starts from the raw test tables (registered as views), so
the check covers the fixture derivation as well as the operator.
"""

from __future__ import annotations

from ..params import DEFAULT, Params

K_SQL = r"""TRY_CAST(regexp_extract(props, '"k":\s*(-?\d+)', 1) AS INTEGER)"""


def R(expr: str, d: int = 6) -> str:
    """Double rounded half up to d places exactly as ``functions.exprs.rnd``; NaN -> NULL."""
    s = f"CAST({float(10 ** d)!r} AS DOUBLE)"
    x = f"CAST(({expr}) AS DOUBLE)"
    return (f"(CASE WHEN isnan({x}) THEN NULL WHEN abs({x}) * {s} < CAST(9e15 AS DOUBLE) "
            f"THEN floor({x} * {s} + CAST(0.5 AS DOUBLE)) / {s} ELSE {x} END)")


def W(k: int, part: str = "symbol", order: str = "ts") -> str:
    return f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def full_roll(agg: str, x: str, k: int, part: str = "symbol", order: str = "ts") -> str:
    w = W(k, part, order)
    return f"(CASE WHEN count({x}) OVER {w} = {k} THEN {agg}({x}) OVER {w} END)"


def ctes_bars_panel() -> str:
    return """li_p AS (
  SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount,
         1000.0 + least(l_extendedprice / l_quantity, 5000.0) / 100.0 AS p
  FROM lineitem),
bars_panel0 AS (
  SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol, l_shipdate AS ts,
         first(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS o,
         max(p) AS h, min(p) AS l,
         last(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS c,
         CAST(sum(l_quantity) AS BIGINT) AS v, max(l_discount) * 10.0 AS base_score
  FROM li_p GROUP BY 1, 2),
bars_panel AS (SELECT symbol, ts, o, h, l, c, v, (h + l + c) / 3.0 AS vwap, base_score FROM bars_panel0)"""


def ctes_events() -> str:
    return f"""ev AS (
  SELECT event_id, ts, user_id, event_type, value, {K_SQL} AS k FROM events)"""


def _hourly(name: str, price: str, volume: str) -> str:
    return f"""{name}0 AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
         first({price} ORDER BY event_id) AS o, max({price}) AS h, min({price}) AS l,
         last({price} ORDER BY event_id) AS c, {volume} AS v,
         last(k ORDER BY event_id) / 100.0 AS base_score
  FROM ev GROUP BY 1, 2),
{name} AS (SELECT symbol, ts, o, h, l, c, v, (h + l + c) / 3.0 AS vwap, base_score FROM {name}0)"""


CALM_PRICE = "(1000.0 + least(value, 200.0) / 10.0)"


def ctes_bars_hour() -> str:
    return ctes_events() + ",\n" + _hourly("bars_hour", "value", "CAST(count(*) AS BIGINT)")


def ctes_bars_calm() -> str:
    return ctes_events() + ",\n" + _hourly("bars_calm", CALM_PRICE, "CAST(sum(k) AS BIGINT)")


def ctes_bars_user() -> str:
    return ctes_events() + """,
bars_user AS (
  SELECT 'U' || CAST(user_id AS VARCHAR) AS symbol, ts, value AS o, value AS h, value AS l, value AS c,
         CAST(k AS BIGINT) AS v, (value + value + value) / 3.0 AS vwap, k / 100.0 AS base_score
  FROM ev)"""


def ctes_trades() -> str:
    return f"""trades AS (
  SELECT event_id AS trade_id, event_type AS symbol, ts AS ts_open,
         CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END AS side,
         CAST(k AS BIGINT) AS qty, {CALM_PRICE} AS entry_px
  FROM ev)"""


FIXTURE_CTES = {
    "bars_panel": ctes_bars_panel,
    "bars_hour": ctes_bars_hour,
    "bars_calm": ctes_bars_calm,
    "bars_user": ctes_bars_user,
}


def ctes_core_features(src: str, p: Params = DEFAULT, out: str = "feat") -> str:
    """Core features over ``src`` (a bars CTE) as CTE ``out``: guard, forward fill, NaN -> 0."""
    w = "(PARTITION BY symbol ORDER BY ts)"
    k = p.atr_period
    vr = ",\n         ".join(
        f"v / {full_roll('avg', 'v', lb)} AS volume_ratio_{lb}" for lb in p.vol_lookbacks
    )
    feats_d = ["vwap_dist", "vwap_slope", "tr", "atr", "atr_pct", "returns", "realized_vol"] + [
        f"volume_ratio_{lb}" for lb in p.vol_lookbacks
    ] + ["hour_sin", "hour_cos"]
    feats_i = ["hour", "minute", "session_phase"]
    upto = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    minb = p.feature_min_bars

    def filled(c, dbl):
        f = f"last_value({c} IGNORE NULLS) OVER {upto}"
        if dbl:
            f = f"(CASE WHEN isnan({f}) THEN 0.0 ELSE {f} END)"
        return f"CASE WHEN n >= {minb} THEN {f} ELSE {c} END AS {c}"

    base_d = ["o", "h", "l", "c", "vwap", "base_score"]
    fill_sel = ",\n         ".join(
        [filled(c, True) for c in base_d + feats_d] + [filled("v", False)] + [filled(c, False) for c in feats_i]
    )
    guard = ",\n         ".join(f"CASE WHEN n >= {minb} THEN {c} END AS {c}" for c in feats_d + feats_i)
    return f"""{out}_0 AS (
  SELECT *, row_number() OVER {w} - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n,
         lag(c) OVER {w} AS c_1, lag(vwap, {p.vwap_slope_bars}) OVER {w} AS vwap_k
  FROM {src}),
{out}_1 AS (
  SELECT *, (c - vwap) / vwap AS vwap_dist, (vwap - vwap_k) / vwap_k AS vwap_slope,
         greatest(h - l, abs(h - c_1), abs(l - c_1)) AS tr, (c - c_1) / c_1 AS returns,
         CAST(hour(ts) AS BIGINT) AS hour, CAST(minute(ts) AS BIGINT) AS minute
  FROM {out}_0),
{out}_2 AS (
  SELECT *, {full_roll('avg', 'tr', k)} AS atr,
         {full_roll('stddev_samp', 'returns', k)} AS realized_vol,
         {vr},
         sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos,
         CAST(CASE WHEN hour < 9 THEN 0 WHEN hour = 9 AND minute < 30 THEN 1 WHEN hour < 14 THEN 2
              WHEN hour >= 15 THEN 3 ELSE 2 END AS BIGINT) AS session_phase
  FROM {out}_1),
{out}_3 AS (
  SELECT symbol, ts, rn, n, o, h, l, c, v, vwap, base_score,
         {guard.replace('CASE WHEN n >= ' + str(minb) + ' THEN atr_pct END AS atr_pct', 'CASE WHEN n >= ' + str(minb) + ' THEN atr / c END AS atr_pct')}
  FROM {out}_2),
{out} AS (
  SELECT symbol, ts, rn, n,
         {fill_sel}
  FROM {out}_3)"""


def ctes_regime(src: str = "feat", p: Params = DEFAULT, out: str = "reg") -> str:
    w = "(PARTITION BY symbol ORDER BY ts)"
    ok = f"n >= {max(p.regime_min_bars, p.feature_min_bars)}"
    return f"""{out}_0 AS (
  SELECT *, CASE WHEN {ok} THEN CAST(c > lag(c) OVER {w} AS BIGINT) END AS up_bar FROM {src}),
{out}_1 AS (
  SELECT *, CASE WHEN {ok} THEN CAST({full_roll('sum', 'up_bar', p.trend_min_bars)} AS BIGINT) END AS directional_count,
         CASE WHEN {ok} THEN atr_pct / {full_roll('avg', 'atr_pct', 10)} END AS atr_expansion
  FROM {out}_0),
{out} AS (
  SELECT *, CASE WHEN NOT ({ok}) THEN 'unknown'
              WHEN abs(vwap_slope) > {p.trend_min_slope} AND (directional_count >= {p.trend_min_bars}
                   OR directional_count <= {p.trend_min_bars - p.trend_min_bars}) THEN 'trend'
              WHEN realized_vol < {p.chop_max_vol} AND atr_pct < {p.chop_max_atr} THEN 'chop'
              WHEN volume_ratio_5 > {p.breakout_min_volume_ratio} AND atr_expansion > {p.breakout_min_atr_expansion} THEN 'breakout'
              ELSE 'unknown' END AS regime
  FROM {out}_1)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
