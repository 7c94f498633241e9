"""Limits and scales of the jobs. The values are fixed by the data and rules the results must agree with."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    # Fixed values.
    slots: int = 24
    capital: float = 1000.0
    commission_rate: float = 0.05
    reserve_ratio: float = 0.20
    budget_multiplier: float = 1.5
    max_liability_share: float = 0.3
    min_liability: float = 5.0
    signal_threshold: float = 0.3
    min_stake: float = 2.0
    depth_ratio: float = 0.5
    volatility_limit: float = 0.05
    volatility_factor: float = 0.3
    stale_seconds: float = 60.0
    stale_penalty: float = -0.02
    mtm_scale: float = 1.0
    sharpe_scale: float = 0.01
    terminal_scale: float = 10.0
    trade_reward: float = 0.0
    no_trade_reward: float = 0.0
    netting: bool = True
    micro_exits: bool = False
    streak_grace: int = 3
    streak_cap: float = -2.0
    curriculum_steps: int = 500_000
    warmup_steps: int = 50_000
    curriculum_power: float = 1.5
    start_liability: float = 0.05
    start_threshold: float = 0.01
    start_stake: float = 0.5
    train_period: tuple[str, str] = ("2025-10-01", "2026-01-31")
    validation_period: tuple[str, str] = ("2026-02-01", "2026-03-31")
    min_rows: int = 10
    min_pre_race_seconds: float = 60.0
    min_pre_race_snapshots: int = 30
    min_liquidity: float = 5000.0
    max_favourite_spread: float = 8.0
    min_favourite_drift: float = 1.0
    min_imbalance_deviation: float = 0.10
    max_prob_null_rate: float = 0.30
    observation_clip: float = 10.0


DEFAULT = Config()

#: The earlier rules: exits at the microprice, no netting, no stake floor, stale trades counted but not penalised.
EARLIER = replace(DEFAULT, micro_exits=True, netting=False, min_stake=0.0, start_stake=0.0, stale_penalty=0.0, mtm_scale=5.0, sharpe_scale=1.0, terminal_scale=1.0, trade_reward=0.01, no_trade_reward=-0.001, streak_grace=1, curriculum_power=2.0)
