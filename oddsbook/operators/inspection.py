"""Which markets are fit for use, and why not: nine checks from one aggregation per market and one per runner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsbook.config import DEFAULT, Config
from oddsbook.operators.quotes import pre_race_rows

CHECKS = ["pre_race_secs", "pre_race_snapshots", "liquidity_at_off", "fav_spread", "fav_drift", "ob_imbalance", "result_closed", "winner_valid", "prob_null_rate"]


def stride_sample(snapshots: DataFrame) -> DataFrame:
    """Every k-th pre-race row of a market, k = max(1, rows // 50), from the first."""
    w = Window.partitionBy("market_id")
    rows = pre_race_rows(snapshots).withColumns({"__i": F.row_number().over(w.orderBy("step")) - 1, "__n": F.count("*").over(w)})
    return rows.where(F.col("__i") % F.greatest(F.lit(1), F.floor(F.col("__n") / 50)) == 0).drop("__i", "__n")


def market_checks(snapshots: DataFrame, quotes: DataFrame, config: Config = DEFAULT, dealt: bool = False) -> DataFrame:
    """A row per market with the measure of every check, from snapshots and raw quotes (before clean_quotes), keyed by market, step and runner.

    Quotes meet their snapshots once and become a row per runner; the favourite is chosen among these rows. Quotes go through one exchange, by
    market_id, or none where the caller says that both inputs are dealt by market; after that only two rows a market do, one of its snapshots and
    one of its runners. Snapshots without quotes stay, quotes without a snapshot do not count. `file`, where snapshots have it, is that of the
    market's first row.
    """
    of_runners = _runners(snapshots, quotes if dealt else quotes.repartition("market_id")).groupBy("market_id").agg(
        F.min(F.when(F.col("price").isNotNull(), F.struct("price", F.col("runner_idx").alias("idx"), "spread", "last_price"))).alias("fav"),
        F.sum("n_first").alias("n_first"), F.avg("sd").alias("sd"), F.try_divide(F.sum("nulls"), F.sum("n")).alias("null_rate"),
    )
    pre_step = F.when(_pre(snapshots), F.col("step"))
    last_pre = lambda c: F.max_by(F.struct(c), pre_step)[c]
    last = lambda c: F.max_by(F.struct(c), "step")[c]
    pre_time = F.when(pre_step.isNotNull(), F.col("ts_unix"))
    has_file = "file" in snapshots.columns
    whole = snapshots.groupBy("market_id").agg(
        F.count("*").alias("n_rows"), F.coalesce(last("runner_count"), F.lit(0)).alias("n_runners"),
        F.coalesce(F.when(F.count(pre_step) >= 2, (F.max(pre_time) - F.min(pre_time)) / 1000), F.lit(0.0)).alias("pre_race_secs"),
        F.count(pre_step).alias("pre_race_snapshots"),
        last_pre("total_matched_market").alias("liquidity_at_off"),
        F.coalesce(last("result_closed"), F.lit(0)).cast("int").alias("result_closed"),
        last("result_winner_idx_first").alias("winner"), F.coalesce(F.trim(last("result_winner_selids")), F.lit("None")).alias("selids"),
        *([F.min_by(F.struct("file"), "step")["file"].alias("file")] if has_file else []),
    )
    drift = F.abs(F.col("fav.last_price") - F.col("fav.price")) / F.col("fav.price") * 100
    found = whole.unionByName(of_runners, allowMissingColumns=True)
    return found.groupBy("market_id").agg(*(F.max(c).alias(c) for c in found.columns if c != "market_id")).select(
        "market_id", ((F.col("n_rows") < config.min_rows) | (F.coalesce("n_first", F.lit(0)) == 0)).alias("few_rows"),
        "n_runners", "pre_race_secs", "pre_race_snapshots", "liquidity_at_off", F.col("fav.idx").alias("fav"),
        F.col("fav.spread").alias("fav_spread"), F.coalesce(drift, F.lit(0.0)).alias("fav_drift"),
        F.coalesce("sd", F.lit(0.0)).alias("ob_imbalance"), "result_closed",
        (F.col("winner").isNotNull() & (F.col("winner") != -1) & (F.col("selids") != "")).cast("int").alias("winner_valid"), F.coalesce("null_rate", F.lit(1.0)).alias("prob_null_rate"),
        *(["file"] if has_file else []),
    )


def _pre(snapshots: DataFrame) -> Column:
    """Whether a snapshot is before the off: all are where the column is absent, null is not."""
    return F.coalesce(F.col("in_play") == 0, F.lit(False)) if "in_play" in snapshots.columns else F.lit(True)


def _runners(snapshots: DataFrame, quotes: DataFrame) -> DataFrame:
    """A row per market and runner: n_first, the priced rows in which it is the first runner; and of its rows before the off the back price over 1
    in the market's first row, the back price in its last, the mean spread over every k-th row, the deviation of the imbalance, null probabilities and their number."""
    w = Window.partitionBy("market_id")
    pre, back, lay = F.col("pre"), F.col("back_price_1"), F.col("lay_price_1")
    steps = snapshots.select("market_id", "step", _pre(snapshots).alias("pre")).withColumns({
        "nth": F.count(F.when(pre, 1)).over(w.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)) - 1, "n_pre": F.count(F.when(pre, 1)).over(w),
        "first_pre": F.min(F.when(pre, F.col("step"))).over(w), "last_pre": F.max(F.when(pre, F.col("step"))).over(w),
    })
    steps = steps.select("market_id", "step", "pre", (F.col("step") == F.col("first_pre")).alias("is_first"), (F.col("step") == F.col("last_pre")).alias("is_last"), (F.col("nth") % F.greatest(F.lit(1), F.floor(F.col("n_pre") / 50)) == 0).alias("sampled"))
    place = F.row_number().over(Window.partitionBy("market_id", "step").orderBy("runner_idx"))
    rows = quotes.select("market_id", "step", "runner_idx", "back_price_1", "lay_price_1", "ob_imbalance", "prob_implied", (place == 1).alias("is_lowest"))
    imbalance = F.when(pre, F.col("ob_imbalance"))
    return rows.join(steps.hint("merge"), ["market_id", "step"]).groupBy("market_id", "runner_idx").agg(
        F.count(F.when(F.col("is_lowest"), back)).alias("n_first"),
        F.min(F.when(pre & F.col("is_first") & (back > 1.0), back)).alias("price"), F.max(F.when(pre & F.col("is_last"), back)).alias("last_price"),
        F.avg(F.when(pre & F.col("sampled") & (back > 0) & (lay > back), (lay - back) / back * 100)).alias("spread"),
        F.when(F.count(imbalance) > 1, F.stddev_samp(imbalance)).alias("sd"), F.count(F.when(pre & F.col("prob_implied").isNull(), 1)).alias("nulls"), F.count(F.when(pre, 1)).alias("n"),
    )


def reason(config: Config = DEFAULT) -> Column:
    """The first check that fails, in a fixed order. A liquidity that is null passes, as no comparison with it holds."""
    c = F.col
    steps = [
        (c("few_rows"), "too_short_or_missing_columns"), (c("n_runners") == 0, "no_runners"),
        (c("pre_race_secs") < config.min_pre_race_seconds, "pre_race_window_too_short"), (c("pre_race_snapshots") < config.min_pre_race_snapshots, "too_few_pre_race_snapshots"),
        (c("liquidity_at_off") < config.min_liquidity, "low_liquidity"), (c("fav").isNull(), "no_favourite_found"),
        (c("fav_spread").isNull() | (c("fav_spread") > config.max_favourite_spread), "fav_spread_too_wide"), (c("fav_drift") < config.min_favourite_drift, "fav_price_no_signal"),
        (c("ob_imbalance") < config.min_imbalance_deviation, "ob_imbalance_flat"), (c("result_closed") != 1, "result_not_closed"), (c("winner_valid") != 1, "winner_invalid"),
        (c("prob_null_rate") > config.max_prob_null_rate, "prob_implied_too_null"),
    ]
    out = F
    for test, name in steps:
        out = out.when(test, name)
    return out.otherwise("passed_all_9_checks")


def suitability(snapshots: DataFrame, quotes: DataFrame, config: Config = DEFAULT, dealt: bool = False) -> DataFrame:
    """(market_id, is_suitable, reason) of every market."""
    return _judged(market_checks(snapshots, quotes, config, dealt).select("market_id", reason(config).alias("reason")))


def suitable_files(snapshots: DataFrame, quotes: DataFrame, config: Config = DEFAULT, dealt: bool = False) -> DataFrame:
    """(market_id, file, is_suitable, reason) of every market, the file from the same pass."""
    return _judged(market_checks(snapshots, quotes, config, dealt).select("market_id", "file", reason(config).alias("reason")))


def _judged(found: DataFrame) -> DataFrame:
    return found.withColumn("is_suitable", F.col("reason") == "passed_all_9_checks").select(*(c for c in found.columns if c != "reason"), "is_suitable", "reason")


def with_unread(suitable: DataFrame, listed: DataFrame) -> DataFrame:
    """suitable (market_id, file, is_suitable, reason) and a row, with a null market, for each file of listed that gave no market: reason read_error."""
    lost = listed.select("file").distinct().join(suitable.select("file").distinct(), "file", "left_anti")
    return suitable.unionByName(lost.select("file", F.lit(False).alias("is_suitable"), F.lit("read_error").alias("reason")), allowMissingColumns=True)


def reason_histogram(suitable: DataFrame) -> DataFrame:
    """Rejected markets by reason, most frequent first."""
    return suitable.where(~F.col("is_suitable")).groupBy("reason").agg(F.count("*").alias("markets")).orderBy(F.desc("markets"), "reason")


def whitelisted(files: DataFrame, whitelist: DataFrame) -> DataFrame:
    return files.join(whitelist.select("file").distinct(), "file", "left_semi")


def filtered_out(files: DataFrame, whitelist: DataFrame) -> DataFrame:
    return files.join(whitelist.select("file").distinct(), "file", "left_anti")
