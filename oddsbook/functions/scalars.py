"""Column functions: conversions, normalisations, exit prices and schedules. All stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from oddsbook.config import DEFAULT, Config

_EPSILON = 1e-8


def number(c: Column) -> Column:
    """A double, with NaN as null; values that are no numbers are null too."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def to_float(c: Column, default: float = 0.0) -> Column:
    """A double; null, blank, NaN and unparseable values become the default."""
    return F.coalesce(number(c), F.lit(default))


def clip(c: Column, low: float, high: float) -> Column:
    """c inside [low, high]; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def safe_normalize(c: Column, low: float, high: float) -> Column:
    """(c - low) / (high - low) inside [0, 1]; 0.5 if the range is next to nothing."""
    if high - low < _EPSILON:
        return F.when(c.isNotNull(), F.lit(0.5))
    return clip((c - F.lit(low)) / F.lit(high - low), 0.0, 1.0)


def normalize_between(c: Column, low: Column, high: Column) -> Column:
    """The same with columns for the range."""
    return F.when(high - low < _EPSILON, 0.5).otherwise(clip(F.try_divide(c - low, high - low), 0.0, 1.0))


def safe_log_norm(c: Column) -> Column:
    """log1p of what is above 0."""
    return F.log1p(F.greatest(F.lit(0.0), c) + F.lit(_EPSILON))


def log_norm_of(value: float) -> float:
    return math.log1p(max(0.0, value) + _EPSILON)


def safe_price_norm(c: Column) -> Column:
    """The log of a price on a scale where 1001 is 1; 0 below 1.01."""
    return F.when(c < 1.01, 0.0).otherwise(F.log(c + F.lit(_EPSILON)) / F.lit(math.log(1001.0)))


def exit_prices(back_1: Column, lay_1: Column, microprice: Column, config: Config = DEFAULT) -> tuple[Column, Column]:
    """Prices at which a back and a lay are closed: those on the other side of the book, or the microprice for both."""
    return (microprice, microprice) if config.micro_exits else (lay_1, back_1)


def runner_close_pnl(bs: Column, wb: Column, ls: Column, wl: Column, back_exit: Column, lay_exit: Column) -> Column:
    """What closing a runner's back and lay stakes at these prices gives, whoever wins; null prices close nothing."""
    back = F.when((bs > 0.01) & (wb > 1.01) & (back_exit > 1.01), bs * (wb - back_exit) / back_exit).otherwise(0.0)
    lay = F.when((ls > 0.01) & (wl > 1.01) & (lay_exit > 1.01), ls * (lay_exit - wl) / lay_exit).otherwise(0.0)
    return back + lay


def curriculum_progress(step: Column, config: Config = DEFAULT) -> Column:
    """0 in the warm-up, 1 at the end, a power of the share of the way between."""
    share = (step - config.warmup_steps) / F.lit(float(config.curriculum_steps - config.warmup_steps))
    return F.when(step < config.warmup_steps, 0.0).when(step >= config.curriculum_steps, 1.0).otherwise(F.pow(share, F.lit(config.curriculum_power)))


def curriculum_schedule(step: Column, config: Config = DEFAULT) -> dict[str, Column]:
    """Progress and the limits that rise with it."""
    p = curriculum_progress(step, config)
    between = lambda low, high: F.lit(low) + F.lit(high - low) * p
    return {
        "progress": p,
        "min_liability": between(config.start_liability, config.min_liability),
        "min_stake": between(config.start_stake, config.min_stake),
        "threshold": between(config.start_threshold, config.signal_threshold),
    }


def commission_rate(c: Column, config: Config = DEFAULT) -> Column:
    return F.coalesce(number(c), F.lit(config.commission_rate))


def after_commission(pnl: Column, rate: Column) -> Column:
    """Profits less commission; losses as they are."""
    return F.when(pnl > 0, pnl * (F.lit(1.0) - rate)).otherwise(pnl)
