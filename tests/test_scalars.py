from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from oddsbook.config import DEFAULT, EARLIER
from oddsbook.functions import scalars as x
from oddsbook.operators import metrics, split


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


@pytest.mark.parametrize("args,want", [((10, 3.0, 0, 0, 2.0, 2.0), 5.0), ((10, 3.0, 0, 0, 4.0, 4.0), -2.5), ((0, 0, 10, 3.0, 4.0, 4.0), 2.5), ((0, 0, 10, 3.0, 2.0, 2.0), -5.0), ((0.01, 3.0, 0.01, 3.0, 2.0, 2.0), 0.0), ((10, 3.0, 10, 3.0, 1.01, 1.01), 0.0)])
def test_closing_a_runner(spark, args, want):
    assert value(spark, x.runner_close_pnl(*(F.lit(float(a)) for a in args))) == pytest.approx(want)


def test_closing_without_prices_gives_nothing(spark):
    none = F.lit(None).cast("double")
    assert value(spark, x.runner_close_pnl(F.lit(10.0), F.lit(3.0), F.lit(5.0), F.lit(3.0), none, none)) == 0.0


@pytest.mark.parametrize("text,want", [(None, -1.0), ("", -1.0), ("abc", -1.0), ("NaN", -1.0), ("2.5", 2.5), (" 3 ", 3.0)])
def test_to_float(spark, text, want):
    assert value(spark, x.to_float(F.lit(text).cast("string"), -1.0)) == want


def test_norms(spark):
    assert value(spark, x.safe_price_norm(F.lit(1.0))) == 0.0
    assert value(spark, x.safe_price_norm(F.lit(1001.0))) == pytest.approx(1.0, abs=1e-9)
    assert value(spark, x.safe_log_norm(F.lit(-4.0))) == pytest.approx(math.log1p(1e-8))
    assert value(spark, x.safe_normalize(F.lit(7.0), 2.0, 2.0)) == 0.5
    assert [value(spark, x.safe_normalize(F.lit(v), 0.0, 2.0)) for v in (-1.0, 1.0, 5.0)] == [0.0, 0.5, 1.0]
    assert value(spark, x.safe_normalize(F.lit(None).cast("double"), 0.0, 1.0)) is None


def test_exit_prices(spark):
    cols = F.lit(2.0), F.lit(2.2), F.lit(2.1)
    assert [value(spark, c) for c in x.exit_prices(*cols, DEFAULT)] == [2.2, 2.0]
    assert [value(spark, c) for c in x.exit_prices(*cols, EARLIER)] == [2.1, 2.1]


@pytest.mark.parametrize("step,want", [(49_999, 0.0), (275_000, 0.5**1.5), (500_000, 1.0)])
def test_curriculum(spark, step, want):
    found = x.curriculum_schedule(F.lit(step))
    assert value(spark, found["progress"]) == pytest.approx(want)
    assert value(spark, found["min_liability"]) == pytest.approx(0.05 + 4.95 * want)
    assert value(spark, found["threshold"]) == pytest.approx(0.01 + 0.29 * want)


@pytest.mark.parametrize("file,want", [("2026-02-13_Newcastle_Race7_1.253949170.parquet", "2026-02-13"), ("x20260213.parquet", "2026-02-13"), ("2026_13_45.parquet", None), ("Race_1.5.parquet", None)])
def test_race_date(spark, file, want):
    found = value(spark, split.race_date(F.lit(file)))
    assert (found and str(found)) == want


@pytest.mark.parametrize("config,want", [(DEFAULT, [0, 0, -0.5, -1, -1.5, -2, -2, -2, -2, -2]), (EARLIER, [-0.5, -1, -1.5, -2, -2, -2, -2, -2, -2, -2])])
def test_streak_penalty(spark, config, want):
    rows = spark.createDataFrame([(0, i, 0) for i in range(10)] + [(0, 10, 3), (0, 11, 0)], "run_id int, episode int, num_trades int")
    got = [r.penalty for r in metrics.no_trade_streak(rows, config=config).orderBy("episode").collect()]
    assert got[:10] == want and got[10] == 0 and got[11] == want[0]


def test_rollout_tenths_are_0_for_one_rollout(spark):
    row = metrics.rollout_quantiles(spark.createDataFrame([(1, 0, 5.0)], "val_episode int, rollout int, pnl double")).first()
    assert (row.realized_pnl, row.pnl_p10, row.pnl_p90) == (5.0, 0.0, 0.0)
