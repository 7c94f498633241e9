"""Positions from trades: a netting ledger, whose steps depend on each other, and the simple one, which is running sums."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEDGER = "market_id long, runner_idx long, step long, k long, back_stake double, back_price double, lay_stake double, lay_price double, net_stake double, realised double, commission double"
_NAMES = [c.split()[0] for c in LEDGER.split(", ")]
_TYPES = [{"long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in LEDGER.split(", ")]
_DUST = 0.01


class Book:
    """The position of one runner: stake and average price by side, backs at 0 and lays at 1, and the net stake."""

    __slots__ = ("stakes", "prices", "net")

    def __init__(self):
        self.stakes, self.prices, self.net = [0.0, 0.0], [0.0, 0.0], 0.0

    bs, ls = (property(lambda self, side=side: self.stakes[side]) for side in (0, 1))
    wb, wl = (property(lambda self, side=side: self.prices[side]) for side in (0, 1))

    def trade(self, back: bool, stake: float, price: float, rate: float, netting: bool = True) -> tuple[float, float]:
        """Takes a trade and returns (realised, commission).

        What the other side holds is closed first, at a gain of the move from its average price that is signed by the side of the trade; what is left
        opens, unless it is dust.
        """
        side, sign = (0, 1.0) if back else (1, -1.0)
        stakes, prices, other = self.stakes, self.prices, 1 - side
        closing = min(stake, stakes[other]) if netting and stakes[other] > _DUST else 0.0
        gain = 0.0
        if closing:
            gain = sign * closing * (price - prices[other]) / price
            stakes[other] -= closing
            if stakes[other] < _DUST:
                stakes[other] = prices[other] = 0.0
        opening = stake - closing
        if opening > _DUST:
            held = stakes[side]
            stakes[side] = held + opening
            prices[side] = (prices[side] * held + price * opening) / stakes[side]
        else:
            opening = 0.0
        self.net += sign * (closing + opening)
        commission = max(gain, 0.0) * rate
        return gain - commission, commission


def position_ledger(trades: DataFrame, netting: bool = True) -> DataFrame:
    """The state of each runner's position after each trade, in step order, for trades (market_id, step, runner_idx, side, price, stake, rate).

    realised and commission are running sums of the runner. Trades are dealt by market and runner and sorted by step (then by side, price and stake, for
    trades of one step); a task folds its rows as they stream by, batch by batch, with the position of the present runner alone in memory. So a runner may
    have any number of trades.
    """
    order = ["market_id", "runner_idx", "step", "side", "price", "stake"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, book, k, realised, commission = None, Book(), 0, 0.0, 0.0
        for batch in batches:
            out = []
            for market, runner, step, side, price, stake, rate in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (market, runner) != present:
                    present, book, k, realised, commission = (market, runner), Book(), 0, 0.0, 0.0
                gained, paid = book.trade(side == "BACK", stake, price, rate, netting)
                k, realised, commission = k + 1, realised + gained, commission + paid
                out.append((market, runner, step, k, book.bs, book.wb, book.ls, book.wl, book.net, realised, commission))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)

    kinds = {"side": "string", "price": "double", "stake": "double", "rate": "double"}
    rows = trades.select(*(F.col(c).cast(kinds.get(c, "long")).alias(c) for c in (*order, "rate")))
    return rows.repartition("market_id", "runner_idx").sortWithinPartitions(*order).mapInArrow(fold, LEDGER)


def position_ledger_simple(trades: DataFrame) -> DataFrame:
    """The same without netting: running stakes, average prices by side and net stake after each trade."""
    w = Window.partitionBy("market_id", "runner_idx").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stake = lambda side: F.sum(F.when(F.col("side") == side, F.col("stake")).otherwise(0.0)).over(w)
    paid = lambda side: F.sum(F.when(F.col("side") == side, F.col("stake") * F.col("price")).otherwise(0.0)).over(w)
    rows = trades.withColumns({"k": F.row_number().over(w), "back_stake": stake("BACK"), "lay_stake": stake("LAY"), "__b": paid("BACK"), "__l": paid("LAY")})
    return rows.select(
        "market_id", "runner_idx", "step", "k", "back_stake", F.coalesce(F.try_divide("__b", "back_stake"), F.lit(0.0)).alias("back_price"), "lay_stake",
        F.coalesce(F.try_divide("__l", "lay_stake"), F.lit(0.0)).alias("lay_price"), (F.col("back_stake") - F.col("lay_stake")).alias("net_stake"),
    )


def last_state(ledger: DataFrame) -> DataFrame:
    """The position of each runner after its last trade."""
    names = [c for c in ledger.columns if c not in ("market_id", "runner_idx", "k", "step")]
    return ledger.groupBy("market_id", "runner_idx").agg(F.max_by(F.struct(*names), "k").alias("s")).select("market_id", "runner_idx", *(f"s.{n}" for n in names))
