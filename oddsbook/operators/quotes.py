"""From wide snapshots to clean quotes: one row per market, step and runner. Narrow steps, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from oddsbook.functions.scalars import number, safe_log_norm, safe_normalize, safe_price_norm

LEVELS = [f"{side}_{what}_{level}" for level in (1, 2, 3) for what in ("price", "size") for side in ("back", "lay")]
FIELDS = [*LEVELS, "has_level_1", "has_level_2", "has_level_3", "last_traded_price", "traded_vol_total", "traded_vol_60s", "secs_since_last_trade", "microprice", "ob_imbalance", "rel_spread", "prob_implied", "ret_std_5s", "ret_std_20s"]
SLOTS = 24
#: Fixed value: the runners of a market whose first row has no count.
DEFAULT_RUNNERS = 9


def wide_column(slot: int, field: str) -> str:
    """The name of a runner's column in a wide snapshot, ready for F.col."""
    return f"`run[{slot}].{field}`"


def first_runner_count(wide: DataFrame, market: str, order: str) -> DataFrame:
    """(market, runners) by the first row of each market; a count that is null there is the default. One row a market."""
    first = F.min_by(F.struct(F.col("runner_count").cast("int").alias("n")), order)["n"]
    return wide.groupBy(market).agg(F.coalesce(first, F.lit(DEFAULT_RUNNERS)).alias("__runners"))


def unpivot_runners(wide: DataFrame, keep: list[str], fields: list[str] = FIELDS, market: str = "market_id", order: str = "step") -> DataFrame:
    """One row per snapshot and runner below the market's runner count, with the columns `keep`; absent runner columns are null, NaN too.

    The runner count of a market is that of its first row, 9 if that is null; other rows' counts do not matter. Rows with a null market are left out.
    """
    wide = wide.join(first_runner_count(wide, market, order), market)
    have = set(wide.columns)
    value = lambda slot, f: number(F.col(wide_column(slot, f))) if f"run[{slot}].{f}" in have else F.lit(None).cast("double")
    slots = F.array(*(F.struct(F.lit(i).alias("runner_idx"), *(value(i, f).alias(f) for f in fields)) for i in range(SLOTS)))
    rows = wide.select(*keep, F.explode(F.filter(slots, lambda s: s["runner_idx"] < F.col("__runners"))).alias("__quote"))
    return rows.select(*keep, "__quote.*")


def valid(quotes: DataFrame) -> Column:
    """Whether a runner has a quote: both first prices are there."""
    return quotes["back_price_1"].isNotNull() & quotes["lay_price_1"].isNotNull()


def clean_quotes(quotes: DataFrame) -> DataFrame:
    """Defaults for what a quote may lack, then what follows from the rest. Rows without a quote stay, with null prices."""
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in [*(c for c in LEVELS if "_size_" in c), "traded_vol_total", "traded_vol_60s", "ret_std_5s", "ret_std_20s"]}
    price = {f"{side}_price_{level}": F.coalesce(f"{side}_price_{level}", f"{side}_price_1") for side in ("back", "lay") for level in (2, 3)}
    flags = {f"has_level_{i}": F.coalesce(F.col(f"has_level_{i}").cast("boolean"), F.lit(i == 1)) for i in (1, 2, 3)}
    other = {"last_traded_price": F.coalesce("last_traded_price", "back_price_1"), "secs_since_last_trade": F.coalesce(F.col("secs_since_last_trade"), F.lit(999.0))}
    return derive_quotes(quotes.withColumns(zero | price | flags | other))


def derive_quotes(quotes: DataFrame) -> DataFrame:
    """Fall-backs for the microprice, and then for imbalance, spread and probability."""
    total = F.col("back_size_1") + F.col("lay_size_1")
    rows = quotes.withColumn("microprice", F.coalesce(F.col("microprice"), (F.col("back_price_1") + F.col("lay_price_1")) / 2))
    return rows.withColumns({
        "ob_imbalance": F.coalesce(F.col("ob_imbalance"), F.when(total > 0, (F.col("back_size_1") - F.col("lay_size_1")) / total).otherwise(0.0)),
        "rel_spread": F.coalesce(F.col("rel_spread"), F.abs(F.col("back_price_1") - F.col("lay_price_1")) / F.greatest(F.col("microprice"), F.lit(1.01))),
        "prob_implied": F.coalesce(F.col("prob_implied"), F.when(F.col("microprice") > 1.01, 1 / F.col("microprice")).otherwise(0.5)),
    })


def valid_quotes(quotes: DataFrame) -> DataFrame:
    return quotes.where(valid(quotes))


def depth(side: str) -> Column:
    return F.col(f"{side}_size_1") + F.col(f"{side}_size_2") + F.col(f"{side}_size_3")


def base_features() -> dict[str, Column]:
    """The 29 normalised columns of a clean quote, in the order of the feature vector."""
    c, back = F.col, depth("back")
    out = {f"f_{n}": (safe_price_norm if "_price_" in n else safe_log_norm)(c(n)) for level in (1, 2, 3) for n in (f"back_price_{level}", f"lay_price_{level}", f"back_size_{level}", f"lay_size_{level}")}
    return out | {
        "f_microprice": safe_price_norm(c("microprice")), "f_imbalance": safe_normalize(c("ob_imbalance"), -1.0, 1.0), "f_spread": safe_normalize(c("rel_spread"), 0.0, 0.1),
        "f_prob": safe_normalize(c("prob_implied"), 0.0, 1.0), "f_ret_std_5s": safe_log_norm(c("ret_std_5s")), "f_ret_std_20s": safe_log_norm(c("ret_std_20s")),
        "f_ltp": safe_price_norm(c("last_traded_price")), "f_vol_total": safe_log_norm(c("traded_vol_total")), "f_vol_60s": safe_log_norm(c("traded_vol_60s")), "f_since_trade": safe_log_norm(c("secs_since_last_trade") + 1),
        **{f"f_has_level_{i}": c(f"has_level_{i}").cast("double") for i in (1, 2, 3)},
        "f_back_depth": safe_log_norm(back), "f_lay_depth": safe_log_norm(depth("lay")), "f_depth_share": F.when(back > 0, c("back_size_1") / back).otherwise(1.0),
        "f_vol_accel": safe_normalize(F.when(c("traded_vol_total") > 0, c("traded_vol_60s") / c("traded_vol_total")).otherwise(0.0), 0.0, 1.0),
    }


def market() -> WindowSpec:
    return Window.partitionBy("market_id")


def off_step() -> Column:
    """The first step in play of a market; null if it has none. A null in_play is not in play."""
    return F.min(F.when(F.col("in_play") == 1, F.col("step"))).over(market())


def pre_race_rows(snapshots: DataFrame) -> DataFrame:
    """Rows with in_play 0; all rows where the column is absent; null is not pre-race here."""
    return snapshots.where(F.col("in_play") == 0) if "in_play" in snapshots.columns else snapshots


def before_off(snapshots: DataFrame) -> DataFrame:
    """Rows before the first one in play, with closing_step: that row, or the last one."""
    rows = snapshots.withColumn("off_step", off_step()).withColumn("closing_step", F.coalesce("off_step", F.max("step").over(market())))
    return rows.where(F.col("off_step").isNull() | (F.col("step") < F.col("off_step")))


def is_open() -> Column:
    """Only the exact status OPEN is open."""
    return F.coalesce(F.col("market_status") == "OPEN", F.lit(False))


def favourite() -> Column:
    """As an aggregate over a first row's quotes: the runner with the least back price over 1, of equals the first; null if none."""
    return F.min(F.when(F.col("back_price_1") > 1.0, F.struct("back_price_1", "runner_idx")))["runner_idx"]


def favourites(quotes: DataFrame) -> DataFrame:
    """(market_id, favourite) from the first row of each market."""
    return quotes.where(F.col("step") == 0).groupBy("market_id").agg(favourite().alias("favourite"))


def step_index(snapshots: DataFrame, order: list[str]) -> DataFrame:
    """Step number, number of steps and progress of each snapshot, in the order of the given columns."""
    rows = snapshots.withColumns({"step": F.row_number().over(market().orderBy(*order)) - 1, "n_steps": F.count("*").over(market())})
    return rows.withColumn("progress", F.col("step") / F.col("n_steps"))
