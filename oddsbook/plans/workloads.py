"""The three workloads as plans: inspection and split, feature build, back-test and report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from oddsbook.config import DEFAULT, Config
from oddsbook.operators import backtest, features, inspection, metrics, split
from oddsbook.operators.quotes import base_features, clean_quotes


def inspect(snapshots: DataFrame, raw_quotes: DataFrame, config: Config = DEFAULT, listed: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """(market_id, file, is_suitable, reason, race_date, split) of every market; with listed, the files (file) of the folder, also of those that could not be read; dealt says that both inputs are dealt by market."""
    found = inspection.suitable_files(snapshots, raw_quotes, config, dealt)
    return split.temporal_split(found if listed is None else inspection.with_unread(found, listed), config)


def build_features(raw_quotes: DataFrame) -> DataFrame:
    """Every quote with its base, momentum and session features: one row per market, step and runner."""
    return features.runner_features(clean_quotes(raw_quotes)).withColumns(base_features())


def run_backtest(snapshots: DataFrame, raw_quotes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The steps of the replay of every market."""
    return backtest.backtest(clean_quotes(raw_quotes), snapshots, config)


def report(steps: DataFrame) -> DataFrame:
    """The validation summary of the markets of a replay."""
    return metrics.validation_summary(backtest.episode_summary(steps))


