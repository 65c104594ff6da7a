"""Parameters of every operator, with the defaults the engine is specified against."""

from __future__ import annotations

from dataclasses import dataclass, field


# Defaults that must equal the specified behaviour.
#   barriers: take profit 1.5 %, stop loss 0.75 %, timeout 16 bars
#   costs (basis points): fees total 6.3, base slippage 2.0, impact coefficient 5.0,
#     maximum slippage 20.0
#   exit grid: entry shifts -2 -1 0 1 2 3; exit modes tp_sl time_8 time_12 atr_trail;
#     take-profit multipliers 0.75 1.0 1.25; stop-loss multipliers 0.75 1.0 1.25
#   horizons: tp_sl 20 bars, atr_trail 30 bars, time_N N bars
#   regime: trend |vwap_slope| > 0.0015 with >= 5 up bars of 5 (or <= 0);
#     chop realized_vol < 0.025 and atr_pct < 0.02;
#     breakout volume_ratio_5 > 2.0 and atr_expansion > 1.5
#   features: atr period 14, volume lookbacks 2 5 10, vwap slope bars 10
#   guards: features need 34 bars, regime 20 bars, metrics 20 bars
#   signal threshold: base_score > 0.5
#   duration limits (interval minutes -> days): 1 30, 2 30, 3 30, 5 30, 10 90, 15 90,
#     30 90, 60 180, 240 180, 1440 180; unknown interval 30
#   session: 09:15 to 15:30 wall clock
#   position limits: 8 trades per day, 10 % of capital per position
DURATION_LIMITS = {1: 30, 2: 30, 3: 30, 5: 30, 10: 90, 15: 90, 30: 90, 60: 180, 240: 180, 1440: 180}


@dataclass(frozen=True)
class Params:
    # triple barrier
    tp_pct: float = 0.015
    sl_pct: float = 0.0075
    timeout_bars: int = 16
    signal_threshold: float = 0.5
    # costs in basis points
    fees_bps: float = 6.3
    slippage_base_bps: float = 2.0
    impact_coef: float = 5.0
    max_slippage_bps: float = 20.0
    # exit grid
    entry_shifts: tuple = (-2, -1, 0, 1, 2, 3)
    exit_modes: tuple = ("tp_sl", "time_8", "time_12", "atr_trail")
    tp_mults: tuple = (0.75, 1.0, 1.25)
    sl_mults: tuple = (0.75, 1.0, 1.25)
    tp_sl_horizon: int = 20
    trail_horizon: int = 30
    trail_atr_mult: float = 2.0
    # regime
    trend_min_slope: float = 0.0015
    trend_min_bars: int = 5
    chop_max_vol: float = 0.025
    chop_max_atr: float = 0.02
    breakout_min_volume_ratio: float = 2.0
    breakout_min_atr_expansion: float = 1.5
    regime_min_bars: int = 20
    # features
    atr_period: int = 14
    vol_lookbacks: tuple = (2, 5, 10)
    vwap_slope_bars: int = 10
    # analysis
    metrics_min_bars: int = 20
    risk_per_trade: float = 0.01
    # position limits
    max_daily_trades: int = 8
    max_position_pct: float = 10.0
    # layout: rows per block of one symbol, halo rows copied from neighbours
    block_rows: int = 65536
    halo_back: int = 1024
    halo_ahead: int = 64

    @property
    def cost(self) -> float:
        """Round-trip cost as a fraction: (fees + base slippage) / 1e4."""
        return (self.fees_bps + self.slippage_base_bps) / 10000.0

    @property
    def feature_min_bars(self) -> int:
        return self.atr_period + max(self.vol_lookbacks) + self.vwap_slope_bars

    def max_horizon(self) -> int:
        hs = [self.tp_sl_horizon, self.trail_horizon]
        hs += [int(m.split("_")[1]) for m in self.exit_modes if m.startswith("time_")]
        return max(hs)


DEFAULT = Params()
