"""Quantiles from mergeable sketches of bounded size, for groups of any number of rows.

A sketch (KLL) of a group is some kilobytes whatever the group's size; sketches of days, markets or runs are kept and merged without reading the rows again. The exact forms are
metrics.rollout_quantiles and metrics.size_ratio_by_price.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 400


def rank_error(k: int = K) -> float:
    """The share of a group by which the rank of a quantile may be off, at 99% confidence; the published fit for one quantile of this sketch."""
    return 2.296 / k**0.9021


def sketched(rows: DataFrame, keys: list[str], value: Column, k: int = K) -> DataFrame:
    """(keys, sketch, n): the sketch of the values of each group; nulls and NaN are left out. Up to k values are held as they are."""
    value = F.when(~F.isnan(value), value)
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"), F.count(value).alias("n"))


def merged(sketches: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """(keys, sketch, n) of coarser groups, from the sketches of finer ones."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """The sketches' keys and n with a column for each share, the value at that rank; null where a group has no value."""
    keys = [c for c in sketches.columns if c != "sketch"]
    at = lambda p: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p)))
    return sketches.select(*keys, *(at(p).alias(name) for name, p in shares.items()))
