"""Values of positions: exposure, concentration, marks, closing and payoffs under every winner.

Positions are rows (market_id, runner_idx, back_stake, back_price, lay_stake, lay_price, net_stake).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsbook.config import DEFAULT, Config
from oddsbook.functions.scalars import after_commission, exit_prices, runner_close_pnl

_C = F.col


def market_exposure(positions: DataFrame) -> DataFrame:
    """Back stakes plus lay liabilities, net stake and number of positions of each market."""
    liability = F.when(_C("lay_price") > 1.0, _C("lay_stake") * (_C("lay_price") - 1.0)).otherwise(0.0)
    return positions.groupBy("market_id").agg((F.sum("back_stake") + F.sum(liability)).alias("exposure"), F.sum("net_stake").alias("net_exposure"), F.count("*").alias("n_positions"))


def position_concentration(positions: DataFrame) -> DataFrame:
    """The Herfindahl index of net stakes; 0 where there are none."""
    size = F.when(F.abs("net_stake") > 1e-6, F.abs("net_stake"))
    return positions.groupBy("market_id").agg(F.coalesce(F.try_divide(F.sum(size * size), F.sum(size) * F.sum(size)), F.lit(0.0)).alias("concentration"))


def closing_quotes(quotes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Quotes of the row at which positions are closed: the first in play, or the last. A runner without a quote there has null prices."""
    off = snapshots.groupBy("market_id").agg(F.coalesce(F.min(F.when(_C("in_play") == 1, _C("step"))), F.max("step")).alias("step"))
    return quotes.join(off, ["market_id", "step"], "left_semi")


def mark_positions(positions: DataFrame, quotes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Each position with its value at the exit prices of one quote per runner; 0 without a quote."""
    back_exit, lay_exit = exit_prices(_C("q.back_price_1"), _C("q.lay_price_1"), _C("q.microprice"), config)
    quoted = _C("q.back_price_1").isNotNull() & _C("q.lay_price_1").isNotNull()
    value = runner_close_pnl(_C("p.back_stake"), _C("p.back_price"), _C("p.lay_stake"), _C("p.lay_price"), back_exit, lay_exit)
    joined = positions.alias("p").join(quotes.alias("q"), (_C("p.market_id") == _C("q.market_id")) & (_C("p.runner_idx") == _C("q.runner_idx")), "left")
    return joined.select("p.*", F.when(quoted, value).otherwise(0.0).alias("mtm"))


def portfolio_mtm(marked: DataFrame) -> DataFrame:
    return marked.groupBy("market_id").agg(F.sum("mtm").alias("portfolio_mtm"))


def green_up(marked: DataFrame) -> DataFrame:
    """Closing value of each market after commission on each runner's profit, and that commission; rows have a column rate."""
    return marked.groupBy("market_id").agg(F.sum(after_commission(_C("mtm"), _C("rate"))).alias("green_up"), F.sum(F.when(_C("mtm") > 0, _C("mtm") * _C("rate")).otherwise(0.0)).alias("commission"))


def book_payoffs(positions: DataFrame, markets: DataFrame) -> DataFrame:
    """(market_id, winner, payoff) for every runner of markets (market_id, runner_count, rate), also those without a position.

    If runner j wins, every other position pays lay stake less back stake; so the sum over all is taken once, and j's own share in it
    is replaced by its win. Positions with next to no stake, or beyond the runners, are left out.
    """
    bs, wb, ls, wl = (_C(c) for c in ("back_stake", "back_price", "lay_stake", "lay_price"))
    counted = positions.join(markets, "market_id").where(((bs > 0.01) | (ls > 0.01)) & (_C("runner_idx") < _C("runner_count")))
    win = F.when((bs > 0.01) & (wb > 1.01), bs * (wb - 1.0)).otherwise(0.0) - F.when((ls > 0.01) & (wl > 1.01), ls * (wl - 1.0)).otherwise(0.0)
    own = counted.select("market_id", "runner_idx", (ls - bs).alias("other"), win.alias("win"))
    total = own.groupBy("market_id").agg(F.sum("other").alias("total"))
    slots = markets.where("runner_count > 0").select("market_id", "rate", F.explode(F.sequence(F.lit(0).cast("long"), _C("runner_count").cast("long") - 1)).alias("runner_idx"))
    rows = slots.join(total, "market_id", "left").join(own, ["market_id", "runner_idx"], "left")
    payoff = F.coalesce(_C("total"), F.lit(0.0)) - F.coalesce(_C("other"), F.lit(0.0)) + F.coalesce(_C("win"), F.lit(0.0))
    return rows.select("market_id", _C("runner_idx").alias("winner"), after_commission(payoff, _C("rate")).alias("payoff"))


def payoffs_of(positions: Column, runners: Column, rate: Column) -> Column:
    """The payoffs under each winner 0 .. runners - 1 from an array of a market's positions (runner_idx, back_stake, back_price, lay_stake, lay_price); the rule of book_payoffs."""
    held = F.filter(positions, lambda p: ((p["back_stake"] > 0.01) | (p["lay_stake"] > 0.01)) & (p["runner_idx"] < runners))
    total = F.aggregate(held, F.lit(0.0), lambda a, p: a + p["lay_stake"] - p["back_stake"])
    side = lambda p, s: F.when((p[f"{s}_stake"] > 0.01) & (p[f"{s}_price"] > 1.01), p[f"{s}_stake"] * (p[f"{s}_price"] - 1.0)).otherwise(0.0)
    own = F.map_from_entries(F.transform(held, lambda p: F.struct(p["runner_idx"].cast("long"), side(p, "back") - side(p, "lay") - (p["lay_stake"] - p["back_stake"]))))
    winners = F.sequence(F.lit(0).cast("long"), F.greatest(runners.cast("long"), F.lit(1)) - 1)
    return F.transform(winners, lambda j: after_commission(total + F.coalesce(F.try_element_at(own, j), F.lit(0.0)), rate))


def worst_case_book(payoffs: DataFrame) -> DataFrame:
    found = payoffs.groupBy("market_id").agg(F.min("payoff").alias("worst_case"), F.max("payoff").alias("best_case"))
    return found.select("*", (_C("best_case") - _C("worst_case")).alias("book_spread"), (_C("worst_case") > 0).alias("is_green"))
