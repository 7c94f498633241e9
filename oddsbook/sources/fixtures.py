"""Order-book tables derived from the general tables, for queries where no race files are at hand.

A user is a market, an event a snapshot; quotes follow by integer arithmetic, orders are episodes. The texts run in Spark and, with
another expression for milliseconds, in DuckDB. The session time zone must be UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK_MS, DUCK_MS = "unix_millis(CAST(ts AS TIMESTAMP))", "(epoch_us(ts) // 1000)"

SNAPSHOTS = """
SELECT *, CASE WHEN 4 * step >= 3 * n_steps THEN 1 ELSE 0 END AS in_play,
  CAST(cum_value_c * (1 + market_id % 8) AS DOUBLE) / 100 AS total_matched_market,
  CAST(n_steps * 3 - step * 4 AS DOUBLE) AS secs_to_off, CAST(value_c % 400 AS DOUBLE) / 100 AS prob_entropy
FROM (
SELECT user_id AS market_id, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step,
  count(*) OVER (PARTITION BY user_id) AS n_steps,
  {ms} AS ts_unix,
  CASE WHEN event_type = 'error' THEN 'SUSPENDED' ELSE 'OPEN' END AS market_status,
  3 + user_id % 5 AS runner_count,
  CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(2 + user_id % 4 AS DOUBLE) / 100 END AS commission_rate,
  CAST(round(value * 100) AS BIGINT) AS value_c,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS cum_value_c,
  CASE WHEN user_id % 10 = 9 THEN 0 ELSE 1 END AS result_closed,
  CASE WHEN user_id % 11 = 10 THEN -1 ELSE CAST(user_id % 3 AS INT) END AS result_winner_idx_first,
  CASE WHEN user_id % 13 = 12 THEN '' ELSE concat('sel', CAST(user_id AS VARCHAR(12))) END AS result_winner_selids,
  CASE WHEN user_id % 17 = 16 THEN concat('Track_1.', CAST(user_id AS VARCHAR(12)), '.parquet')
       ELSE concat('202', CASE WHEN user_id % 6 < 3 THEN '5-1' ELSE '6-0' END,
            CAST(CASE WHEN user_id % 6 < 3 THEN user_id % 3 ELSE 1 + user_id % 3 END AS VARCHAR(1)),
            '-1', CAST(user_id % 9 AS VARCHAR(1)), '_Track_Race', CAST(1 + user_id % 8 AS VARCHAR(1)),
            '_1.', CAST(user_id AS VARCHAR(12)), '.parquet') END AS file
FROM {events}) e"""

QUOTES = """
SELECT market_id, step, runner_idx, h,
  CASE WHEN h % 29 = 0 THEN NULL ELSE CAST(b AS DOUBLE) / 100 END AS back_price_1,
  CASE WHEN h % 29 = 0 THEN NULL ELSE CAST(b + 2 + h % 7 AS DOUBLE) / 100 END AS lay_price_1,
  CAST(h % 200 AS DOUBLE) AS back_size_1,
  CAST((h * 7) % 150 AS DOUBLE) AS lay_size_1,
  CASE WHEN h % 6 = 0 THEN NULL ELSE CAST(b - 2 AS DOUBLE) / 100 END AS back_price_2,
  CASE WHEN h % 6 = 0 THEN NULL ELSE CAST(b + 9 AS DOUBLE) / 100 END AS lay_price_2,
  CASE WHEN h % 6 = 0 THEN NULL ELSE CAST((h * 3) % 90 AS DOUBLE) END AS back_size_2,
  CASE WHEN h % 6 = 0 THEN NULL ELSE CAST((h * 5) % 90 AS DOUBLE) END AS lay_size_2,
  CAST(b - 4 AS DOUBLE) / 100 AS back_price_3, CAST(b + 12 AS DOUBLE) / 100 AS lay_price_3,
  CAST((h * 11) % 60 AS DOUBLE) AS back_size_3, CAST((h * 13) % 60 AS DOUBLE) AS lay_size_3,
  CASE WHEN h % 31 = 1 THEN 0 WHEN h % 5 = 0 THEN NULL ELSE 1 END AS has_level_1,
  CASE WHEN h % 6 = 0 THEN 0 ELSE 1 END AS has_level_2, 1 AS has_level_3,
  CASE WHEN h % 4 = 0 THEN NULL ELSE CAST(b + 1 AS DOUBLE) / 100 END AS last_traded_price,
  CASE WHEN h % 37 = 2 THEN 0.0 ELSE CAST(cum_value_c AS DOUBLE) / 100 END AS traded_vol_total,
  CAST((h * 3) % 500 AS DOUBLE) AS traded_vol_60s,
  CASE WHEN h % 13 = 0 THEN NULL ELSE CAST(h % 80 AS DOUBLE) END AS secs_since_last_trade,
  CASE WHEN h % 3 = 0 OR h % 29 = 0 THEN NULL ELSE CAST(2 * b + 2 + h % 7 AS DOUBLE) / 200 END AS microprice,
  CASE WHEN h % 5 = 0 THEN NULL ELSE CAST(h % 201 - 100 AS DOUBLE) / 100 END AS ob_imbalance,
  CASE WHEN h % 7 = 0 THEN NULL ELSE CAST(2 + h % 7 AS DOUBLE) / b END AS rel_spread,
  CASE WHEN h % 4 = 1 THEN NULL ELSE 100 / CAST(b AS DOUBLE) END AS prob_implied,
  CAST(h % 64 AS DOUBLE) / 1000 AS ret_std_5s, CAST(h % 48 AS DOUBLE) / 1000 AS ret_std_20s,
  CAST((h * 17) % 201 - 100 AS DOUBLE) / 100 AS signal,
  CAST((market_id * 7 + step * 13) % 201 - 100 AS DOUBLE) / 100 AS allocation
FROM (
SELECT s.*, r.runner_idx, (s.event_id * 31 + r.runner_idx * 17 + s.value_c) % 1000 AS h,
  200 + 150 * r.runner_idx + (s.market_id * 37) % 100 + (s.event_id * 31 + r.runner_idx * 17 + s.value_c) % 41 - 20 AS b
FROM {snapshots} s JOIN {slots} r ON r.runner_idx < s.runner_count) q"""

TRADES = """
SELECT q.market_id, q.step, q.runner_idx,
  CASE WHEN q.signal > 0 THEN 'BACK' ELSE 'LAY' END AS side,
  CASE WHEN q.signal > 0 THEN q.back_price_1 ELSE q.lay_price_1 END AS price,
  CAST(2 + q.h % 19 AS DOUBLE) AS stake,
  CASE WHEN q.signal > 0 THEN CAST(2 + q.h % 19 AS DOUBLE)
       ELSE CAST(2 + q.h % 19 AS DOUBLE) * (q.lay_price_1 - 1) END AS liability
FROM {quotes} q JOIN {snapshots} s ON s.market_id = q.market_id AND s.step = q.step
WHERE s.in_play = 0 AND s.market_status = 'OPEN' AND abs(q.signal) >= 0.3
  AND q.back_price_1 IS NOT NULL AND q.lay_price_1 IS NOT NULL"""

EPISODES = """
SELECT run_id, episode, step, num_trades, num_trades - lay_trades AS back_trades, lay_trades,
  CAST(pnl_c AS DOUBLE) / 100 AS realized_pnl,
  1000 + CAST(pnl_c AS DOUBLE) / 100 AS balance,
  CASE WHEN pnl_c > 0 AND num_trades > 0 THEN CAST(pnl_c AS DOUBLE) / 2000 ELSE 0.0 END AS commission_paid,
  CAST((num_trades - lay_trades) * 11 AS DOUBLE) AS back_exposure, CAST(lay_trades * 37 AS DOUBLE) AS lay_exposure,
  CAST(episode % 50 AS DOUBLE) / 2 AS max_drawdown, episode % 13 AS depth_violations, episode % 4 AS suspended_violations
FROM (
SELECT run_id, episode, step, num_trades, CASE WHEN num_trades = 0 THEN 0 ELSE (num_trades * 7 + episode) % (num_trades + 1) END AS lay_trades,
  CASE WHEN num_trades = 0 THEN 0 ELSE p END AS pnl_c
FROM (
SELECT o_custkey % 5 AS run_id, o_orderkey + 1 AS episode, (o_orderkey + 1) * 72 AS step,
  CASE WHEN (o_orderkey * 7 + o_custkey) % 5 < 3 THEN 0 ELSE 1 + o_orderkey % 40 END AS num_trades,
  CAST(round(o_totalprice * 100) AS BIGINT) % 20001 - 10000 AS p
FROM {orders}) a) b"""

ROLLOUTS = """
SELECT e.episode AS val_episode, r.rollout,
  CAST((e.episode * 7919 + r.rollout * 104729) % 20001 - 10000 AS DOUBLE) / 100 AS pnl,
  (e.num_trades + r.rollout) % 40 AS num_trades, CAST((e.episode * 13 + r.rollout * 29) % 401 - 200 AS DOUBLE) / 10 AS mid_race_pnl
FROM {episodes} e CROSS JOIN {rollouts} r"""


def snapshots(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """With parts, events are dealt by market into so many partitions, which the snapshots keep."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(SNAPSHOTS.replace("{ms}", SPARK_MS), events=events.repartition(parts, "user_id") if parts else events)


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes_of(spark, snapshots(spark, sf_dir))


def quotes_of(spark: SparkSession, snapshots: DataFrame) -> DataFrame:
    return spark.sql(QUOTES, snapshots=snapshots, slots=spark.range(24).withColumnRenamed("id", "runner_idx"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRADES, quotes=quotes(spark, sf_dir), snapshots=snapshots(spark, sf_dir))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EPISODES, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def rollout_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ROLLOUTS, episodes=episodes(spark, sf_dir), rollouts=spark.range(5).withColumnRenamed("id", "rollout"))
