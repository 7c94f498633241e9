"""Metrics of episodes and validation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsbook.config import DEFAULT, Config
from oddsbook.functions.scalars import commission_rate

_C = F.col


def episode_outcome(pnl: Column) -> Column:
    return F.when(pnl > 0, "WIN").when(pnl < 0, "LOSS").otherwise("FLAT")


def rollout_quantiles(rollouts: DataFrame) -> DataFrame:
    """Median and outer tenths of each episode's rollouts (val_episode, rollout, pnl), interpolated; the tenths are 0 for a single rollout.
    last_pnl and all other columns are those of the last rollout.
    """
    q = F.percentile("pnl", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    others = [c for c in rollouts.columns if c not in ("val_episode", "rollout", "pnl")]
    last = F.max_by(F.struct(_C("pnl").alias("last_pnl"), *others), "rollout")
    rows = rollouts.groupBy("val_episode").agg(q.alias("q"), F.count("*").alias("n_rollouts"), last.alias("last"))
    tail = lambda i: F.when(_C("n_rollouts") > 1, _C("q")[i]).otherwise(0.0)
    return rows.select("val_episode", "n_rollouts", _C("q")[1].alias("realized_pnl"), tail(0).alias("pnl_p10"), tail(2).alias("pnl_p90"), "last.*")


def race_card(snapshots: DataFrame, card: list[str], key: str = "market_id", order: str = "step", config: Config = DEFAULT) -> DataFrame:
    """One row a market from its first row: file, runner count, commission rate, the columns `card` and how many of them are known; and its
    number of snapshots. Columns of the card that snapshots lack are null; the key is no column of the card.
    """
    card = [c for c in card if c != key]
    own = [c for c in ("file", "runner_count", "commission_rate") if c in snapshots.columns]
    known = [c for c in card if c in snapshots.columns]
    rows = snapshots.groupBy(key).agg(F.min_by(F.struct(*own, *known), order).alias("f"), F.count("*").alias("snapshots"))
    field = lambda c: (_C("f")[c] if c in known else F.lit(None)).cast("string")
    n_known = sum((field(c).isNotNull().cast("int") for c in card), F.lit(0))
    return rows.select(key, *(_C("f")[c].alias(c) for c in own if c != "commission_rate"), commission_rate(_C("f.commission_rate") if "commission_rate" in own else F.lit(None).cast("double"), config).alias("commission_rate"), "snapshots", *(field(c).alias(c) for c in card), n_known.alias("n_known"))


def _rates(rows_with: str = "num_trades") -> list[Column]:
    back, lay = F.sum("back_trades"), F.sum("lay_trades")
    return [(F.avg((_C(rows_with) > 0).cast("int")) * 100).alias("trade_rate"), (back / F.greatest(back + lay, F.lit(1)) * 100).alias("back_pct")]


def validation_summary(rows: DataFrame) -> DataFrame:
    """One row over all validation episodes; means of the rollouts' tenths and of the mid-race result where rows have them."""
    back, lay = F.sum("back_trades"), F.sum("lay_trades")
    mean = lambda c: F.avg(c).alias(f"mean_{c}")
    return rows.agg(
        F.count("*").alias("episodes"), F.avg("realized_pnl").alias("mean_pnl"), F.percentile("realized_pnl", F.lit(0.5)).alias("median_pnl"), F.stddev_samp("realized_pnl").alias("std_pnl"),
        (F.avg((_C("realized_pnl") > 0).cast("int")) * 100).alias("win_rate"), *_rates(), (back / F.greatest(lay, F.lit(1))).alias("back_lay_ratio"),
        mean("num_trades"), mean("commission_paid"), mean("back_exposure"), mean("lay_exposure"), mean("depth_violations"), mean("suspended_violations"),
        *(mean(c) for c in ("pnl_p10", "pnl_p90", "mid_race_pnl") if c in rows.columns),
    )


def training_blocks(rows: DataFrame, size: int = 10) -> DataFrame:
    """Means over full blocks of episodes of a run."""
    mean = lambda c: F.avg(c).alias(f"avg_{c}")
    block = F.floor((_C("episode") - 1) / size).alias("block")
    names = ["realized_pnl", "max_drawdown", "num_trades", "commission_paid", "depth_violations", "suspended_violations", "back_trades", "lay_trades", "back_exposure", "lay_exposure"]
    out = rows.groupBy(block).agg(F.count("*").alias("episodes"), *_rates(), *(mean(c) for c in names), (F.avg("back_trades") / F.greatest(F.avg("lay_trades"), F.lit(0.01))).alias("back_lay_ratio"))
    return out.where(_C("episodes") == size)


def lay_share_by_band(rows: DataFrame, ends: tuple[int, ...] = (200, 600, 1200, 2000)) -> DataFrame:
    """Trades and exposure by side and the share of lays in each band of episodes, and over all."""
    band = F
    for i, end in enumerate(ends):
        band = band.when(_C("episode") <= end, i)
    rows = rows.withColumn("band", band.otherwise(len(ends)))
    out = rows.rollup("band").agg(*(F.sum(c).alias(c) for c in ("back_trades", "lay_trades", "back_exposure", "lay_exposure")))
    return out.select(F.coalesce("band", F.lit(-1)).alias("band"), "back_trades", "lay_trades", "back_exposure", "lay_exposure", F.coalesce(F.try_divide(_C("lay_trades") * 100.0, _C("back_trades") + _C("lay_trades")), F.lit(0.0)).alias("lay_pct"), F.try_divide("lay_exposure", "back_exposure").alias("exposure_ratio"))


def size_ratios(quotes: DataFrame, edges: tuple[float, ...] = (2.0, 3.0, 5.0, 8.0, 13.0, 25.0)) -> DataFrame:
    """quotes with bucket, that of the back price, and ratio, lay size over back size, where both are there."""
    bucket = F
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        bucket = bucket.when((_C("back_price_1") >= low) & (_C("back_price_1") < high), i)
    rows = quotes.withColumn("bucket", bucket.otherwise(None)).where(_C("bucket").isNotNull() & (_C("back_size_1") > 0) & _C("lay_size_1").isNotNull())
    return rows.withColumn("ratio", _C("lay_size_1") / _C("back_size_1"))


def size_ratio_by_price(quotes: DataFrame, edges: tuple[float, ...] = (2.0, 3.0, 5.0, 8.0, 13.0, 25.0)) -> DataFrame:
    """The median of lay size over back size in buckets of the back price, exactly; sketches.sketched has a form whose size does not grow."""
    return size_ratios(quotes, edges).groupBy("bucket").agg(F.percentile("ratio", F.lit(0.5)).alias("median_ratio"), F.count("*").alias("n"))


def no_trade_streak(rows: DataFrame, run: str = "run_id", config: Config = DEFAULT) -> DataFrame:
    """Length of the present run of episodes without trades, and its penalty. Each run (a training process) is a partition of the window."""
    w = Window.partitionBy(run).orderBy("episode")
    traded = (_C("num_trades") > 0).cast("int")
    rows = rows.withColumn("__island", F.sum(traded).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    place = F.sum(1 - traded).over(Window.partitionBy(run, "__island").orderBy("episode").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("streak", F.when(traded == 1, 0).otherwise(place))
    excess = _C("streak") - (config.streak_grace - 1)
    return rows.withColumn("penalty", F.when(_C("streak") >= config.streak_grace, F.greatest(F.lit(config.streak_cap), excess * -0.5)).otherwise(0.0)).drop("__island")


def rolling_sharpe(rows: DataFrame, pnl: str = "mtm_change", n: int = 100, least: int = 20, config: Config = DEFAULT) -> DataFrame:
    """Mean over deviation of a market's last n changes, clipped and scaled; 0 with fewer than `least` or no deviation."""
    w = Window.partitionBy("market_id").orderBy("step").rowsBetween(-(n - 1), Window.currentRow)
    sd = F.stddev_pop(pnl).over(w)
    ratio = F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.try_divide(F.avg(pnl).over(w), sd)))
    return rows.withColumn("sharpe", F.when((F.count(pnl).over(w) < least) | (sd < 1e-8), 0.0).otherwise(ratio * config.sharpe_scale))


def drawdown(rows: DataFrame) -> DataFrame:
    """The largest balance so far and how far, in per cent, a market's balance is below it."""
    w = Window.partitionBy("market_id").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("peak", F.max("balance").over(w))
    return rows.withColumn("drawdown", F.when(_C("peak") > 0, (_C("peak") - _C("balance")) / _C("peak") * 100).otherwise(0.0))


def recent_trades(trades: DataFrame, most: int = 10) -> DataFrame:
    """Trades of a market so far, up to ten, as a share of ten."""
    w = Window.partitionBy("market_id").orderBy("step", "runner_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return trades.withColumn("recent", F.least(F.count("*").over(w), F.lit(most)) / most)


def trade_log(trades: DataFrame, n: int = 10) -> DataFrame:
    """The first n and the last n trades of each market, with their place."""
    w = Window.partitionBy("market_id")
    rows = trades.withColumns({"place": F.row_number().over(w.orderBy("step", "runner_idx")), "__last": F.row_number().over(w.orderBy(F.desc("step"), F.desc("runner_idx")))})
    return rows.where((_C("place") <= n) | (_C("__last") <= n)).drop("__last")


def rollout_grid(races: DataFrame, n: int = 5) -> DataFrame:
    """Each race n times; n is a small fixed number, so the rows are exploded."""
    return races.withColumn("rollout", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
