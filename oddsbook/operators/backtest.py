"""Replay of given signals against the books of each market.

What a step may stake depends on the trades before it, so that part is a fold over the proposals of a market in their order (decided). It streams: a task holds the
positions of one market, not its rows. All else about the replay is declared over the whole table: gates that do not depend on capital, positions carried to every step,
marks before and after a step's trades, running measures, payoffs and the episode's sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsbook.config import DEFAULT, Config
from oddsbook.functions.scalars import after_commission, commission_rate, curriculum_schedule
from oddsbook.operators import carry
from oddsbook.operators.ledger import Book
from oddsbook.operators.metrics import no_trade_streak, rolling_sharpe
from oddsbook.operators.quotes import DEFAULT_RUNNERS, depth, is_open
from oddsbook.operators.valuation import payoffs_of
from oddsbook.sources.work import written

_C = F.col
REASONS = ["below_threshold", "no_quote", "no_level_1", "stale", "price_range", "small_budget", "depth", "small_liability", "stake_floor", "accepted"]


def trade_admission(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Each proposal with side, price, liability, stake, volatile and the first gate it fails, or accepted.

    rows are clean quotes of open snapshots with signal, budget and available (capital), which are given; the replay has them from its state.
    """
    signal, strength = _C("signal"), F.abs("signal")
    back = signal > 0
    volatile = _C("ret_std_5s") > config.volatility_limit
    rows = rows.withColumns({
        "side": F.when(back, "BACK").otherwise("LAY"), "price": F.when(back, _C("back_price_1")).otherwise(_C("lay_price_1")),
        "volatile": F.coalesce(volatile, F.lit(False)), "own_budget": _C("budget") * strength * F.when(volatile, config.volatility_factor).otherwise(1.0),
        "total": F.when(back, depth("back")).otherwise(depth("lay")),
    }).withColumn("intended", F.when(back, _C("own_budget")).when(_C("price") > 1.01, F.try_divide("own_budget", _C("price") - 1.0)).otherwise(0.0))
    safe = _C("total") * config.depth_ratio
    rows = rows.withColumn("liability", F.least(_C("own_budget"), _C("available") * config.max_liability_share, F.when(back, safe).otherwise(safe * (_C("price") - 1.0))))
    rows = rows.withColumn("stake", F.when(back, _C("liability")).otherwise(F.try_divide("liability", _C("price") - 1.0)))
    quoted = _C("back_price_1").isNotNull() & _C("lay_price_1").isNotNull()
    gates = [
        strength < config.signal_threshold, ~quoted, ~_C("has_level_1"), _C("secs_since_last_trade") > config.stale_seconds, (_C("price") < 1.01) | (_C("price") > 1000),
        _C("own_budget") < config.min_liability, _C("intended") > safe, _C("liability") < config.min_liability, _C("stake") < config.min_stake,
    ]
    reason = F
    for test, name in zip(gates, REASONS, strict=False):
        reason = reason.when(test, name)
    return rows.withColumn("reason", reason.otherwise("accepted")).drop("own_budget", "total", "intended")


def violation_counts(admitted: DataFrame, snapshots: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Counts of what the gates found, by market, and of snapshots before the off that were not open."""
    of = lambda name, side=None: F.count_if((_C("reason") == name) & (F.lit(True) if side is None else _C("side") == side))
    past = [r for r in REASONS if r not in ("below_threshold", "no_quote", "no_level_1", "stale")]
    found = admitted.groupBy("market_id").agg(
        of("stale").alias("stale"), F.count_if(_C("volatile") & _C("reason").isin(past)).alias("volatile"), of("depth").alias("depth"), of("depth", "BACK").alias("back_depth"), of("depth", "LAY").alias("lay_depth"),
        of("stake_floor").alias("stake_floor"), of("stake_floor", "BACK").alias("back_stake"), of("stake_floor", "LAY").alias("lay_stake"), (of("stale") * config.stale_penalty).alias("stale_penalty"),
    )
    shut = snapshots.groupBy("market_id").agg(F.count_if(~is_open()).alias("suspended"))
    return shut.join(found, "market_id", "left").fillna(0)


HELD = "array<struct<runner_idx:long,net_stake:double,mtm:double,age:double>>"
BOOK = "array<struct<runner_idx:long,back_stake:double,back_price:double,lay_stake:double,lay_price:double>>"
EPISODE = "struct<balance:double,num_trades:long,realized_pnl:double,commission_paid:double,commission_rate:double,max_drawdown:double,mtm_reward:double,sharpe_reward:double,depth_violations:long,volatility_violations:long,stale_market_violations:long,suspended_violations:long,back_trades:long,worst_case:double,best_case:double,book_spread:double,is_green:boolean,back_depth_viol:long,lay_depth_viol:long,stake_floor_rej:long,back_stake_rej:long,lay_stake_rej:long,lay_trades:long,back_exposure:double,lay_exposure:double,mid_race_pnl:double,stale_penalty:double,netting_bonus:double,green_up_pnl:double,had_trades:boolean,step:long>"
_NAMES = ["market_id", "step", "balance", "exposure", "n_positions", "commission", "recent_trades", "net_exposure", "concentration", "portfolio_mtm", "green_up", "positions", "trades", "realised", "mtm_change", "sharpe", "reward", "last", "episode"]


def limits_of(config: Config) -> dict[str, float]:
    """The limits of a trade that a curriculum moves, at their final values."""
    return {"min_liability": config.min_liability, "threshold": config.signal_threshold, "min_stake": config.min_stake}


def markets_of(snapshots: DataFrame, config: Config = DEFAULT, max_steps: int | None = None) -> DataFrame:
    """A row a market: runners and rate by its first snapshot, n_steps, closing, the step at which it is closed (the first in play, or the last), and end, its last step here."""
    first = F.min_by(F.struct("runner_count", "commission_rate"), "step")
    found = snapshots.groupBy("market_id").agg(first.alias("f"), (F.max("step") + 1).alias("n_steps"), F.min(F.when(_C("in_play") == 1, _C("step"))).alias("off"))
    closing = F.coalesce("off", _C("n_steps") - 1)
    runners = F.when(_C("f.runner_count") > 0, _C("f.runner_count")).otherwise(DEFAULT_RUNNERS)
    end = closing if max_steps is None else F.least(closing, F.lit(max_steps - 1))
    return found.select("market_id", runners.cast("long").alias("runners"), commission_rate(_C("f.commission_rate"), config).alias("rate"), "n_steps", closing.alias("closing"), end.alias("end"))


def gated(quotes: DataFrame, steps: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Quotes of open steps before the off with side, price, strength (of the signal, less where prices move fast), total (depth on that side), volatile and reason:
    the first of the gates it fails that do not depend on capital, or null.
    """
    live = steps.where(_C("open") & ~_C("off")).select("market_id", "step", "runners", "rate", *limits_of(config))
    rows = quotes.join(live, ["market_id", "step"]).where(_C("runner_idx") < F.least(_C("runners"), F.lit(config.slots)))
    back, no = _C("signal") > 0, F.lit(False)
    rows = rows.withColumns({
        "side": F.when(back, "BACK").otherwise("LAY"), "price": F.when(back, _C("back_price_1")).otherwise(_C("lay_price_1")), "volatile": F.coalesce(_C("ret_std_5s") > config.volatility_limit, no),
        "total": F.when(back, depth("back")).otherwise(depth("lay")),
    }).withColumn("strength", F.abs("signal") * F.when(_C("volatile"), config.volatility_factor).otherwise(1.0))
    quoted = _C("back_price_1").isNotNull() & _C("lay_price_1").isNotNull()
    passes = [F.abs("signal") >= _C("threshold"), quoted, _C("has_level_1").cast("int") == 1, ~F.coalesce(_C("secs_since_last_trade") > config.stale_seconds, no), _C("price").between(1.01, 1000)]
    reason = F
    for test, name in zip(passes, REASONS, strict=False):
        reason = reason.when(~F.coalesce(test, no), name)
    allocation = F.coalesce(_C("allocation").cast("double"), F.lit(0.0))
    return rows.select("market_id", "step", "runner_idx", "side", "price", "strength", "total", allocation.alias("allocation"), "rate", "min_liability", "min_stake", "volatile", reason.otherwise(None).alias("reason"))


DECIDED = "market_id long, step long, runner_idx long, side string, price double, volatile boolean, reason string, liability double, stake double, gained double, k long, back_stake double, back_price double, lay_stake double, lay_price double, net_stake double, realised double, commission double"


def decided(candidates: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The proposals that pass the gates of `gated`, each with the first gate on capital it fails, or accepted with what was traded and the runner's position after it.

    This is the part that depends on its own past: what may be staked follows from the balance and the positions at the start of the step. Proposals are dealt by
    market, sorted by step and runner, and folded as they stream by; a task holds the balance and positions of one market, however many steps it has.
    """
    order = ["market_id", "step", "runner_idx"]
    names = [c.split()[0] for c in DECIDED.split(", ")]
    types = [{"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in DECIDED.split(", ")]
    nothing = (None,) * (len(names) - names.index("gained"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        market = step = None
        for batch in batches:
            out = []
            for m, t, i, side, price, strength, total, allocation, rate, least_liability, least_stake, volatile in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if m != market:
                    market, step, balance, books, sums = m, None, config.capital, {}, {}
                if t != step:
                    step = t
                    used = sum(b.bs + (b.ls * (b.wl - 1.0) if b.wl > 1.0 else 0.0) for b in books.values())
                    available = max(0.0, balance - used) * (1.0 - config.reserve_ratio)
                    budget = available * ((allocation + 1.0) / 2.0) * config.budget_multiplier
                back, own, safe = side == "BACK", budget * strength, total * config.depth_ratio
                odds = 1.0 if back else price - 1.0 if price > 1.01 else math.inf
                liability = min(own, available * config.max_liability_share, safe * (1.0 if back else price - 1.0))
                stake = liability / odds
                tests = [(own < least_liability, "small_budget"), (own / odds > safe, "depth"), (liability < least_liability, "small_liability"), (stake < least_stake, "stake_floor"), (stake < 0.01, "dust")]
                reason, after = next((name for fails, name in tests if fails), "accepted"), nothing
                if reason == "accepted":
                    book, (k, realised, commission) = books.setdefault(i, Book()), sums.get(i, (0, 0.0, 0.0))
                    gained, paid = book.trade(back, stake, price, rate, config.netting)
                    balance += gained
                    sums[i] = (k + 1, realised + gained, commission + paid)
                    after = (gained, k + 1, book.bs, book.wb, book.ls, book.wl, book.net, realised + gained, commission + paid)
                out.append((m, t, i, side, price, volatile, reason, liability, stake, *after))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), types, strict=True)], names)

    rows = candidates.select(*(_C(c).cast("long").alias(c) for c in order), "side", *(_C(c).cast("double").alias(c) for c in ("price", "strength", "total", "allocation", "rate", "min_liability", "min_stake")), "volatile")
    return rows.repartition("market_id").sortWithinPartitions(*order).mapInArrow(fold, DECIDED)


def _grid(quotes: DataFrame, steps: DataFrame, config: Config) -> DataFrame:
    """Prices of every runner at every step, null where the quotes have no row."""
    slots = steps.select("market_id", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.least(_C("runners"), F.lit(config.slots)) - 1)).alias("runner_idx"))
    prices = quotes.select("market_id", "step", _C("runner_idx").cast("long").alias("runner_idx"), F.struct("back_price_1", "lay_price_1", "microprice").alias("p"))
    rows = slots.unionByName(prices, allowMissingColumns=True).repartition("market_id").groupBy("market_id", "step", "runner_idx").agg(F.max("p").alias("p"))
    return rows.select("market_id", "step", "runner_idx", "p.*")


def _facts(proposals: DataFrame, made: DataFrame) -> DataFrame:
    """What each step's proposals came to: its trades, counts by reason and side, and what was realised."""
    trade = F.struct("runner_idx", "side", "price", "stake", "liability")
    early = proposals.where("reason = 'stale' OR volatile AND reason = 'price_range'")
    rows = made.unionByName(early.select("market_id", "step", "runner_idx", "side", "volatile", "reason"), allowMissingColumns=True)
    of = lambda name, side: F.count_if((_C("reason") == name) & (_C("side") == side))
    return rows.groupBy("market_id", "step").agg(
        F.sort_array(F.collect_list(F.when(_C("reason") == "accepted", trade))).alias("trades"), F.coalesce(F.sum("gained"), F.lit(0.0)).alias("realised"), F.count_if(_C("reason") == "stale").alias("stale"),
        F.count_if(_C("volatile") & (_C("reason") != "stale")).alias("volatile"), *(of(reason, side).alias(f"{side.lower()}_{name}") for reason, name in (("depth", "depth"), ("stake_floor", "stake"), ("accepted", "trades")) for side in ("BACK", "LAY")),
        *(F.coalesce(F.sum(F.when((_C("reason") == "accepted") & (_C("side") == side), _C("liability"))), F.lit(0.0)).alias(f"{side.lower()}_exposure") for side in ("BACK", "LAY")),
    )


def _values(grid: DataFrame, states: DataFrame, markets: DataFrame, config: Config) -> DataFrame:
    """By step: the sums of carry.TOTALS and the positions before its trades, and marks, closing values and positions after them."""
    rows = carry.around(grid, states).join(markets.select("market_id", "n_steps", "rate"), "market_id")
    now = lambda c: _C("after")[c]
    rows = rows.select("market_id", "step", "runner_idx", "n_steps", "rate", "before.*", "after", carry.mark(lambda c: _C("before")[c], config).alias("mtm"), carry.mark(now, config).alias("mtm_after"))
    held = F.struct(_C("runner_idx"), _C("net_stake"), _C("mtm"), carry.position_age(_C("n_steps")).alias("age"))
    book = F.struct(_C("runner_idx"), *(now(c).alias(c) for c in ("back_stake", "back_price", "lay_stake", "lay_price")))
    listed = lambda c, some: F.sort_array(F.collect_list(F.when(some, c)))
    profit = F.when(_C("mtm_after") > 0, _C("mtm_after") * _C("rate")).otherwise(0.0)
    return rows.groupBy("market_id", "step").agg(
        *carry.totals(_C("rate"), config), listed(held, _C("n_trades") > 0).alias("positions"), listed(book, now("n_trades") > 0).alias("book"), F.sum("mtm_after").alias("mtm_after"),
        F.sum(after_commission(_C("mtm_after"), _C("rate"))).alias("closed"), F.sum(profit).alias("closing_paid"), (F.lit(config.capital) + F.sum(now("realised"))).alias("balance_after"), F.sum(now("commission")).alias("commission_after"),
    )


def backtest(quotes: DataFrame, snapshots: DataFrame, config: Config = DEFAULT, max_steps: int | None = None) -> DataFrame:
    """A row per market and step up to its end: the state before the step, its trades and rewards, and on the last row the episode.

    quotes are clean, with the columns signal and allocation; snapshots have runner_count, commission_rate, in_play and market_status. Every
    snapshot is a step, with quotes or without. With max_steps a market stops there without closing. Where snapshots have global_step (the steps
    that a training run made before), the limits of a trade follow the curriculum at that step, else they are the final ones.

    Only what may be staked depends on the past (decided, whose rows are written to the shared folder once); gates, positions as of each step, marks, payoffs, running measures and
    counts are columns, windows and sums by market.
    """
    if "global_step" in snapshots.columns:
        schedule = curriculum_schedule(_C("global_step"), config)
        limits = [F.coalesce(schedule[n].cast("double"), F.lit(v)).alias(n) for n, v in limits_of(config).items()]
    else:
        limits = [F.lit(v).alias(n) for n, v in limits_of(config).items()]
    markets = markets_of(snapshots, config, max_steps)
    own = snapshots.select("market_id", "step", F.coalesce(_C("in_play") == 1, F.lit(False)).alias("off"), is_open().alias("open"), *limits)
    steps = own.join(markets, "market_id").where(_C("step") <= _C("end"))
    fields = [f"{s}_{w}" for s in ("back", "lay") for w in ("price_1", "size_1", "size_2", "size_3")]
    quotes = quotes.select("market_id", "step", "runner_idx", *fields, "has_level_1", "microprice", "secs_since_last_trade", "ret_std_5s", "signal", "allocation")
    proposals = gated(quotes, steps, config)
    made = written(decided(proposals.where("reason IS NULL"), config), "decided")
    states = made.where("reason = 'accepted'").select("market_id", "runner_idx", "step", "k", *carry.STATE)
    rows = steps.join(_values(_grid(quotes, steps, config), states, markets, config), ["market_id", "step"], "left").join(_facts(proposals, made), ["market_id", "step"], "left")

    zero = lambda c: F.coalesce(_C(c), F.lit(0))
    counts = ["stale", "volatile", "back_depth", "lay_depth", "back_stake", "lay_stake", "back_trades", "lay_trades"]
    sums = {c: zero(c) for c in (*counts, "realised", "back_exposure", "lay_exposure", "exposure", "n_positions", "commission", "recent_trades", "net_exposure", "concentration", "portfolio_mtm", "green_up", "mtm_after", "closed", "closing_paid", "commission_after")}
    rows = rows.withColumns(sums | {c: F.coalesce(_C(c), F.lit(config.capital)) for c in ("balance", "balance_after")})
    none = F.array().cast("array<struct<runner_idx:long,side:string,price:double,stake:double,liability:double>>")
    rows = rows.withColumns({"trades": F.coalesce("trades", none), "mtm_change": F.when(_C("off"), 0.0).otherwise(_C("mtm_after") - _C("portfolio_mtm") + _C("realised")), "last": _C("step") == _C("closing")})
    rows = rolling_sharpe(rows, config=config).withColumn("sharpe", F.when(_C("off"), 0.0).otherwise(_C("sharpe")))
    so_far = Window.partitionBy("market_id").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({
        "mtm_reward": _C("mtm_change") / config.capital * config.mtm_scale, "stale_penalty": _C("stale") * config.stale_penalty, "suspended": F.when(_C("off") | _C("open"), 0).otherwise(1),
        "peak": F.greatest(F.lit(config.capital), F.max(F.when(~_C("off"), _C("balance_after"))).over(so_far)), "payoffs": F.when(_C("last"), payoffs_of(F.coalesce("book", F.array().cast(BOOK)), _C("runners"), _C("rate"))),
    })
    rows = rows.withColumns({"worst": F.array_min("payoffs"), "best": F.array_max("payoffs")})
    terminal = F.when(_C("last"), (_C("worst") if config.netting else _C("closed")) / config.capital * config.terminal_scale).otherwise(0.0)
    step_reward = _C("mtm_reward") + _C("sharpe") + F.when(F.size("trades") > 0, config.trade_reward).otherwise(config.no_trade_reward) + _C("stale_penalty")
    run = {c: F.sum(c).over(so_far) for c in (*counts, "suspended", "realised", "back_exposure", "lay_exposure", "mtm_reward", "sharpe", "stale_penalty")}
    rows = rows.withColumn("reward", F.when(_C("off"), 0.0).otherwise(step_reward) + terminal).withColumns({f"all_{c}": v for c, v in run.items()})
    whole = lambda *names: sum((_C(f"all_{n}") for n in names[1:]), _C(f"all_{names[0]}"))
    balance = _C("balance_after") + _C("closed")
    episode = {
        "balance": balance, "num_trades": whole("back_trades", "lay_trades"), "realized_pnl": balance - config.capital, "commission_paid": _C("commission_after") + _C("closing_paid"), "commission_rate": _C("rate"),
        "max_drawdown": F.when(_C("peak") > 0, (_C("peak") - balance) / _C("peak") * 100).otherwise(0.0), "mtm_reward": whole("mtm_reward"), "sharpe_reward": whole("sharpe"), "depth_violations": whole("back_depth", "lay_depth"),
        "volatility_violations": whole("volatile"), "stale_market_violations": whole("stale"), "suspended_violations": whole("suspended"), "back_trades": whole("back_trades"), "worst_case": _C("worst"), "best_case": _C("best"),
        "book_spread": _C("best") - _C("worst"), "is_green": _C("worst") > 0, "back_depth_viol": whole("back_depth"), "lay_depth_viol": whole("lay_depth"), "stake_floor_rej": whole("back_stake", "lay_stake"), "back_stake_rej": whole("back_stake"),
        "lay_stake_rej": whole("lay_stake"), "lay_trades": whole("lay_trades"), "back_exposure": whole("back_exposure"), "lay_exposure": whole("lay_exposure"), "mid_race_pnl": whole("realised"), "stale_penalty": whole("stale_penalty"),
        "netting_bonus": whole("realised") / config.capital, "green_up_pnl": balance - config.capital, "had_trades": whole("back_trades", "lay_trades") > 0, "step": F.when(_C("off"), _C("step")).otherwise(_C("step") + 1),
    }
    kinds = {"episode": EPISODE, "n_positions": "int", "recent_trades": "int", "positions": HELD}
    rows = rows.withColumns({"episode": F.when(_C("last"), F.struct(*(c.alias(n) for n, c in episode.items()))), "positions": F.coalesce("positions", F.array().cast(HELD))})
    return rows.select(*(_C(c).cast(kinds[c]).alias(c) if c in kinds else _C(c) for c in _NAMES))


def backtest_trades(steps: DataFrame) -> DataFrame:
    return steps.select("market_id", "step", F.explode("trades").alias("t")).select("market_id", "step", "t.*")


def episode_summary(steps: DataFrame, runs: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """A row per market that ended: the measures of its episode. With runs (market_id, run_id, episode), the order in which a process met the
    markets, also the streak of episodes without trades up to it and its penalty."""
    found = steps.where("episode IS NOT NULL").select("market_id", F.col("episode.step").alias("length"), *(F.col(f"episode.{n}").alias(n) for n in steps.schema["episode"].dataType.names if n != "step"))
    if runs is None:
        return found
    streaks = no_trade_streak(found.join(runs, "market_id"), config=config)
    return streaks.withColumnsRenamed({"streak": "no_trade_streak", "penalty": "no_trade_penalty"}).drop("run_id", "episode")


def step_pnl(steps: DataFrame) -> DataFrame:
    """Change of value of each step: marks after less marks before its trades, both at the step's own row, and what was realised."""
    return steps.select("market_id", "step", "realised", "mtm_change", "sharpe", "reward")

