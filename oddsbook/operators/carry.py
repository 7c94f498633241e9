"""Positions as of each step: the last state of each runner carried forward over the complete grid of steps and runners.

States are rows after trades, (market_id, runner_idx, step, k, back_stake, back_price, lay_stake, lay_price, net_stake) with running sums realised and commission
where a ledger has them. The grid has a row for every step and runner, with or without a quote. Both are put into one table that is dealt out
by market once; a window then takes the last state so far, and all later windows and sums by market, runner and step use that partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from oddsbook.config import DEFAULT, Config
from oddsbook.functions.scalars import after_commission, exit_prices, runner_close_pnl

_C = F.col
STATE = ["back_stake", "back_price", "lay_stake", "lay_price", "net_stake", "realised", "commission"]
#: What the sums of a step are called.
TOTALS = ["exposure", "net_exposure", "n_positions", "concentration", "portfolio_mtm", "green_up", "closing_commission", "recent_trades", "balance", "commission"]


def _both(grid: DataFrame, states: DataFrame) -> DataFrame:
    """(market_id, runner_idx, step, __row, __state, __k) of the grid's rows and the states, dealt out by market."""
    key = ["market_id", "runner_idx", "step"]
    state = F.struct(*((_C(n) if n in states.columns else F.lit(0.0)).cast("double").alias(n) for n in STATE))
    own = grid.select(*(_C(c).cast("long") for c in key), F.struct(*(_C(c) for c in grid.columns)).alias("__row"))
    moved = states.select(*(_C(c).cast("long") for c in key), state.alias("__state"), _C("k").cast("long").alias("__k"))
    return own.unionByName(moved, allowMissingColumns=True).repartition("market_id")


def _position(frame: WindowSpec) -> Column:
    """The last state of a frame with n_trades and first_open; zeros and null before the first."""
    last = F.max(F.when(_C("__state").isNotNull(), F.struct("step", "__k", "__state"))).over(frame)["__state"]
    first = F.min(F.when(_C("__state").isNotNull(), _C("step"))).over(frame)
    return F.struct(*(F.coalesce(last[n], F.lit(0.0)).alias(n) for n in STATE), first.alias("first_open"), F.count("__state").over(frame).alias("n_trades"))


def around(grid: DataFrame, states: DataFrame, before: str | None = "before", after: str | None = "after") -> DataFrame:
    """The rows of grid (market_id, step, runner_idx, ...) with the runner's position before the trades of the step and after them, a struct each (None leaves one out).

    A struct has STATE (0 before the first trade), first_open, the step of the runner's first trade so far (null if none), and n_trades, its trades so
    far. States of several trades of a step count in the order of k; states of runners or steps that the grid lacks give no rows, but
    carry on. Grid rows of one market, step and runner all get the same states.
    """
    by_step = Window.partitionBy("market_id", "runner_idx").orderBy("step")
    ends = {name: end for name, end in ((before, -1), (after, 0)) if name}
    rows = _both(grid, states).withColumns({name: _position(by_step.rangeBetween(Window.unboundedPreceding, end)) for name, end in ends.items()})
    key = ("market_id", "runner_idx", "step")
    return rows.where("__row IS NOT NULL").select(*(_C(c) if c in key else _C("__row")[c].alias(c) for c in grid.columns), *ends)


def carried(grid: DataFrame, states: DataFrame, before: bool = False) -> DataFrame:
    """The rows of grid with the fields of the position after the trades of the step, or before them, as columns of their own; as around has them."""
    rows = around(grid, states, "__held" if before else None, None if before else "__held")
    return rows.select(*grid.columns, "__held.*")


def mark(position: Callable[[str], Column], config: Config = DEFAULT) -> Column:
    """What closing a position, given by its fields, at the row's own exit prices gives before commission; 0 without a quote."""
    back_exit, lay_exit = exit_prices(_C("back_price_1"), _C("lay_price_1"), _C("microprice"), config)
    value = runner_close_pnl(*(position(c) for c in ("back_stake", "back_price", "lay_stake", "lay_price")), back_exit, lay_exit)
    return F.when(_C("back_price_1").isNotNull() & _C("lay_price_1").isNotNull(), value).otherwise(0.0)


def marked(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Rows of carried with mtm, the mark of the position."""
    return rows.withColumn("mtm", mark(_C, config))


def position_age(n_steps: Column) -> Column:
    """Steps since a runner's first trade, as a share of the race, while it has a position; at every step, for rows of carried."""
    age = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (_C("step") - _C("first_open")) / F.greatest(n_steps, F.lit(1))))
    return F.when((F.abs("net_stake") > 0.01) & _C("first_open").isNotNull(), age).otherwise(0.0)


def totals(rate: Column, config: Config = DEFAULT, most: int = 10) -> list[Column]:
    """The sums TOTALS of a step, as aggregates over its rows of marked.

    exposure is back stakes and lay liabilities, concentration the Herfindahl index of net stakes, green_up the marks after commission on each runner's profit,
    recent_trades the market's trades so far up to `most`, balance the capital and what was realised so far.
    """
    held = _C("n_trades") > 0
    size = F.when(F.abs("net_stake") > 1e-6, F.abs("net_stake"))
    liability = F.when(_C("lay_price") > 1.0, _C("lay_stake") * (_C("lay_price") - 1.0)).otherwise(0.0)
    return [
        F.sum(_C("back_stake") + liability).alias("exposure"), F.sum("net_stake").alias("net_exposure"), F.count_if(held).alias("n_positions"),
        F.coalesce(F.try_divide(F.sum(size * size), F.sum(size) * F.sum(size)), F.lit(0.0)).alias("concentration"), F.sum("mtm").alias("portfolio_mtm"),
        F.sum(after_commission(_C("mtm"), rate)).alias("green_up"), F.sum(F.when(_C("mtm") > 0, _C("mtm") * rate).otherwise(0.0)).alias("closing_commission"),
        F.least(F.sum("n_trades"), F.lit(most)).alias("recent_trades"), (F.lit(config.capital) + F.sum("realised")).alias("balance"), F.sum("commission").alias("commission"),
    ]


def by_step(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(market_id, step, TOTALS) of rows of marked; a column rate gives each market's commission, else it is the usual one."""
    rate = _C("rate") if "rate" in rows.columns else F.lit(config.commission_rate)
    return rows.groupBy("market_id", "step").agg(*totals(rate, config))
