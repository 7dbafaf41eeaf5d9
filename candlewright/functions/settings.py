"""Thresholds of the screener, in one place. Defaults are fixed values of the screening rules."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    benchmark: str = "^NSEI"
    suffix: str = ".NS"
    history_days: int = 300
    chart_days: int = 90
    min_turnover: float = 1e8
    min_price: float = 20.0
    min_bars: int = 60
    rs_floor: float = 60.0
    rs_single: float = 70.0
    extended_atr: float = 1.0
    stop_atr: float = 2.0
    target_atr: float = 3.0
    min_rr: float = 1.0
    earnings_days: int = 10
    hold: int = 10
    #: Look-back windows in bars and their weights in the relative-strength composite.
    lookbacks: tuple[tuple[int, float], ...] = ((21, 0.20), (63, 0.35), (126, 0.45))


DEFAULTS = Settings()
