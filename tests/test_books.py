from __future__ import annotations

import datetime
import random
import re
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddsbook import queries
from oddsbook.config import DEFAULT, EARLIER
from oddsbook.operators import backtest, features, inspection, ledger, metrics, split, valuation
from oddsbook.operators import quotes as q
from oddsbook.plans import workloads
from oddsbook.sources import fixtures as fx
from oddsbook.sources import metrics as sink
from oddsbook.sources import races

SF = "/root/testdata/sf0.001"
LEVEL = {"has_level_1": 1.0, "has_level_2": 0.0, "has_level_3": 0.0}


def states(spark, trades, rate=0.05):
    rows = spark.createDataFrame([(1, i, 0, s, float(p), float(k), rate) for i, (s, k, p) in enumerate(trades)], "market_id long, step long, runner_idx long, side string, price double, stake double, rate double")
    return ledger.position_ledger(rows).orderBy("k").collect()


def test_netting(spark):
    last = states(spark, [("BACK", 10, 4.0), ("LAY", 10, 2.0)])[-1]
    assert (last.back_stake, last.lay_stake, last.net_stake) == (0.0, 0.0, 0.0) and last.realised == pytest.approx(9.5) and last.commission == pytest.approx(0.5)


def test_netting_over(spark):
    last = states(spark, [("BACK", 10, 4.0), ("LAY", 15, 5.0)])[-1]
    assert (last.back_stake, last.lay_stake, last.lay_price, last.net_stake) == (0.0, 5.0, 5.0, -5.0) and last.realised == pytest.approx(-2.0)


def test_never_both_sides_open(spark):
    rows = ledger.position_ledger(fx.trades(spark, SF).withColumn("rate", F.lit(0.05)))
    assert rows.count() > 500 and rows.where("back_stake > 0 AND lay_stake > 0").count() == 0


def test_payoffs(spark):
    held = spark.createDataFrame([(1, 0, 10.0, 3.0, 0.0, 0.0, 10.0), (2, 5, 10.0, 3.0, 0.0, 0.0, 10.0)], "market_id long, runner_idx long, back_stake double, back_price double, lay_stake double, lay_price double, net_stake double")
    markets = spark.createDataFrame([(1, 3, 0.05), (2, 2, 0.05), (3, 2, 0.05)], "market_id long, runner_count long, rate double")
    paid = valuation.book_payoffs(held, markets)
    assert [r.payoff for r in paid.where("market_id = 1").orderBy("winner").collect()] == [19.0, -10.0, -10.0]
    worst = {r.market_id: r for r in valuation.worst_case_book(paid).collect()}
    assert (worst[1].worst_case, worst[1].book_spread, worst[1].is_green) == (-10.0, 29.0, False)
    assert worst[2].worst_case == worst[3].best_case == 0.0


def test_closing_is_no_better_than_the_mark(spark):
    marked = queries._marked(spark, SF).join(queries._rates(spark, SF), "market_id")
    both = valuation.green_up(marked).join(valuation.portfolio_mtm(marked), "market_id")
    assert both.where("green_up > portfolio_mtm + 1e-6").count() == 0 and both.count() > 10


def test_lag_counts_steps_not_quotes(spark):
    base = {f: None for f in q.FIELDS} | LEVEL
    rows = [dict(base, market_id=1, step=t, runner_idx=0, back_price_1=b, lay_price_1=None if b is None else b + 0.1) for t, b in enumerate([2.0, None, 3.0, 3.3])]
    schema = "market_id long, step long, runner_idx long, " + ", ".join(f"{f} double" for f in q.FIELDS)
    got = features.runner_features(q.clean_quotes(spark.createDataFrame(rows, schema))).orderBy("step").collect()
    assert [r.micro_delta_1 for r in got] == [0.0, None, 0.0, pytest.approx(0.3 / 3.05)]


def test_admission_of_a_longshot_lay(spark):
    row = dict.fromkeys(q.FIELDS, 0.0) | {"back_price_1": 29.0, "lay_price_1": 30.0, "lay_size_1": 100.0, "has_level_1": 1.0, "signal": -1.0, "budget": 5.0, "available": 800.0}
    got = backtest.trade_admission(spark.createDataFrame([row]).withColumn("has_level_1", F.lit(True))).first()
    assert (got.reason, got.side) == ("stake_floor", "LAY") and got.stake == pytest.approx(5 / 29)


def replay_by_hand(rows, config):
    """The rules once more, row by row and runner by runner."""
    c, n = config, int(rows.runner_count.iloc[0])
    rate = rows.commission_rate.iloc[0]
    rate = c.commission_rate if pd.isna(rate) else rate
    balance, books, out = c.capital, {}, []
    by = {t: g.set_index("runner_idx") for t, g in rows.groupby("step")}
    closing = lambda b, r: sum([b["bs"] * (b["wb"] - r.x) / r.x if b["bs"] > 0.01 and b["wb"] > 1.01 and r.x > 1.01 else 0.0, b["ls"] * (r.y - b["wl"]) / r.y if b["ls"] > 0.01 and b["wl"] > 1.01 and r.y > 1.01 else 0.0])

    def marks(t):
        found = {}
        for i, b in books.items():
            r = by[t].loc[i].copy()
            if pd.notna(r.back_price_1) and pd.notna(r.lay_price_1):
                r["x"], r["y"] = (r.microprice, r.microprice) if c.micro_exits else (r.lay_price_1, r.back_price_1)
                found[i] = closing(b, r)
        return found

    steps = sorted(by)
    for t in steps:
        one = by[t].iloc[0]
        if one.in_play == 1:
            balance += sum(m * (1 - rate) if m > 0 else m for m in marks(t).values())
            break
        before, realised = sum(marks(t).values()), 0.0
        if one.market_status == "OPEN":
            used = sum(b["bs"] + (b["ls"] * (b["wl"] - 1) if b["wl"] > 1 else 0) for b in books.values())
            available = max(0.0, balance - used) * 0.8
            budget = available * (one.allocation + 1) / 2 * 1.5
            for i in range(min(24, n)):
                r = by[t].loc[i]
                if abs(r.signal) < c.signal_threshold or pd.isna(r.back_price_1) or pd.isna(r.lay_price_1) or not r.has_level_1 or r.secs_since_last_trade > 60:
                    continue
                back = r.signal > 0
                p = r.back_price_1 if back else r.lay_price_1
                own = budget * abs(r.signal) * (0.3 if r.ret_std_5s > 0.05 else 1.0)
                size = sum(r[f"{'back' if back else 'lay'}_size_{k}"] for k in (1, 2, 3))
                if not 1.01 <= p <= 1000 or own < c.min_liability or (own if back else own / (p - 1)) > 0.5 * size:
                    continue
                lia = min(own, 0.3 * available, 0.5 * size if back else 0.5 * size * (p - 1))
                stake = lia if back else lia / (p - 1)
                if lia < c.min_liability or stake < c.min_stake or stake < 0.01:
                    continue
                b = books.setdefault(i, dict(bs=0.0, wb=0.0, ls=0.0, wl=0.0))
                rest, gain = stake, 0.0
                mine, other = ("b", "l") if back else ("l", "b")
                if c.netting and b[other + "s"] > 0.01:
                    cut = min(rest, b[other + "s"])
                    gain = cut * (p - b["wl"]) / p if back else cut * (b["wb"] - p) / p
                    gain -= max(gain, 0.0) * rate
                    b[other + "s"] -= cut
                    rest -= cut
                    if b[other + "s"] < 0.01:
                        b[other + "s"] = b["w" + other] = 0.0
                if rest > 0.01:
                    total = b[mine + "s"] + rest
                    b["w" + mine] = (b["w" + mine] * b[mine + "s"] + p * rest) / total
                    b[mine + "s"] = total
                balance += gain
                realised += gain
        out.append((t, sum(marks(t).values()) - before + realised))
        if t == steps[-1]:
            balance += sum(m * (1 - rate) if m > 0 else m for m in marks(t).values())
    return balance, out


@pytest.mark.parametrize("config", [DEFAULT, EARLIER])
def test_replay(spark, config):
    snaps, clean = fx.snapshots(spark, SF), q.clean_quotes(fx.quotes(spark, SF))
    got = backtest.backtest(clean, snaps, config).collect()
    rows = snaps.select("market_id", "step", "runner_count", "commission_rate", "in_play", "market_status").join(clean.drop("h"), ["market_id", "step"]).toPandas()
    made = 0
    for market, own in rows.groupby("market_id"):
        balance, changes = replay_by_hand(own, config)
        mine = sorted((r for r in got if r.market_id == market), key=lambda r: r.step)
        assert mine[-1].episode.balance == pytest.approx(balance, abs=1e-6)
        assert [r.mtm_change for r in mine if not (r.last and r.step not in dict(changes))] == pytest.approx([c for _, c in changes], abs=1e-7)
        assert mine[-1].episode.worst_case <= mine[-1].episode.best_case
        made += mine[-1].episode.num_trades
    assert made > 50


def test_replay_of_steps_without_quotes(spark):
    """Quotes of every third step are gone, in play too: each snapshot is a step all the same, and a shut one counts."""
    snaps, clean = fx.snapshots(spark, SF), q.clean_quotes(fx.quotes(spark, SF))
    got = {r.market_id: r for r in backtest.episode_summary(backtest.backtest(clean.where("step % 3 <> 2"), snaps)).collect()}
    whole = {r.market_id: r for r in backtest.episode_summary(backtest.backtest(clean, snaps)).collect()}
    assert {m: (r.length, r.suspended_violations) for m, r in got.items()} == {m: (r.length, r.suspended_violations) for m, r in whole.items()}
    none = backtest.episode_summary(backtest.backtest(clean.where("false"), snaps)).collect()
    assert len(none) == len(whole) and all(r.balance == DEFAULT.capital and not r.had_trades for r in none)


def test_replay_follows_the_curriculum(spark):
    snaps, clean = fx.snapshots(spark, SF), q.clean_quotes(fx.quotes(spark, SF))
    of = lambda s: sorted(map(tuple, backtest.episode_summary(backtest.backtest(clean, s)).select("market_id", "num_trades", "balance").collect()))
    last, early = of(snaps.withColumn("global_step", F.lit(DEFAULT.curriculum_steps))), of(snaps.withColumn("global_step", F.lit(0)))
    loose = replace(DEFAULT, min_liability=DEFAULT.start_liability, signal_threshold=DEFAULT.start_threshold, min_stake=DEFAULT.start_stake)
    assert last == of(snaps)
    assert early == sorted(map(tuple, backtest.episode_summary(backtest.backtest(clean, snaps, loose)).select("market_id", "num_trades", "balance").collect())) != last


def test_episode_fields(spark):
    steps = backtest.backtest(q.clean_quotes(fx.quotes(spark, SF)), fx.snapshots(spark, SF))
    runs = steps.select("market_id").distinct().selectExpr("market_id", "0 AS run_id", "market_id AS episode")
    trades = {m: n for m, n in steps.select("market_id", F.size("trades").alias("n")).groupBy("market_id").agg(F.sum("n")).collect()}
    changed = {r.market_id: r for r in steps.groupBy("market_id").agg(F.sum(F.col("mtm_change")).alias("mtm"), F.sum("realised").alias("realised"), F.sum("sharpe").alias("sharpe")).collect()}
    streak = 0
    for r in backtest.episode_summary(steps, runs).orderBy("market_id").collect():
        streak = 0 if trades[r.market_id] else streak + 1
        assert (r.num_trades, r.had_trades, r.no_trade_streak) == (trades[r.market_id], trades[r.market_id] > 0, streak) and r.back_trades + r.lay_trades == r.num_trades
        assert r.no_trade_penalty == (max(DEFAULT.streak_cap, -0.5 * (streak - DEFAULT.streak_grace + 1)) if streak >= DEFAULT.streak_grace else 0.0)
        assert r.green_up_pnl == r.realized_pnl == pytest.approx(r.balance - DEFAULT.capital)
        own = changed[r.market_id]
        assert (r.mtm_reward, r.mid_race_pnl, r.sharpe_reward) == pytest.approx((own.mtm / DEFAULT.capital * DEFAULT.mtm_scale, own.realised, own.sharpe), abs=1e-6)
        assert r.book_spread == pytest.approx(r.best_case - r.worst_case) and r.is_green == (r.worst_case > 0)


def test_runner_count_is_that_of_the_first_row(spark):
    rows = [(1, 0, 3), (1, 1, None), (1, 2, 5), (2, 0, None), (2, 1, 2)]
    wide = spark.createDataFrame(rows, "market_id long, step long, runner_count int").withColumn("run[0].back_price_1", F.lit(2.0))
    got = q.unpivot_runners(wide, ["market_id", "step"]).groupBy("market_id", "step").count().collect()
    assert {(r.market_id, r.step): r["count"] for r in got} == {(1, 0): 3, (1, 1): 3, (1, 2): 3, (2, 0): 9, (2, 1): 9}


def test_replay_does_not_depend_on_partitions(spark):
    snaps, clean = fx.snapshots(spark, SF), q.clean_quotes(fx.quotes(spark, SF))
    one, two = (backtest.episode_summary(backtest.backtest(c, snaps)).orderBy("market_id").collect() for c in (clean, clean.repartition(7, "runner_idx")))
    assert one == two


def test_replay_stops_without_closing(spark):
    got = backtest.backtest(q.clean_quotes(fx.quotes(spark, SF)), fx.snapshots(spark, SF), max_steps=5)
    assert got.where("step >= 5 OR episode IS NOT NULL").count() == 0


def race(step, slots, **more):
    row = {"ts_unix": 1000 * step, "runner_count": len(slots), "in_play": 0, "market_status": "OPEN", "total_matched_market": 6000.0, "result_closed": 1, "result_winner_idx_first": 0.0, "result_winner_selids": "s"} | more
    for i, price in enumerate(slots):
        row |= {f"run[{i}].back_price_1": price + step / 50, f"run[{i}].lay_price_1": price + 0.05 + step / 50, f"run[{i}].ob_imbalance": (-1.0) ** step * 0.5, f"run[{i}].prob_implied": 0.3}
    return row


def test_race_files(spark, tmp_path):
    pd.DataFrame([race(t, [2.0, 3.0]) for t in range(80)]).to_parquet(tmp_path / "2026-02-13_A_1.1.parquet")
    pd.DataFrame([race(t, [2.0, 3.0, 4.0], market_id="m") for t in range(9)]).to_parquet(tmp_path / "B_1.2.parquet")
    (tmp_path / "broken.parquet").write_bytes(b"no parquet")
    rows = races.scan_snapshots(spark, str(tmp_path))
    assert {r.file: r.n for r in rows.groupBy("file").agg(F.count("*").alias("n")).collect()} == {"2026-02-13_A_1.1.parquet": 80, "B_1.2.parquet": 9}
    assert [(r.file, r.reason) for r in races.quarantine_files(spark, str(tmp_path), rows).collect()] == [("broken.parquet", "read_error")]
    keyed = rows.withColumn("market_id", F.xxhash64("file")).transform(lambda d: q.step_index(d, ["ts_unix"]))
    long = q.unpivot_runners(keyed, ["market_id", "step"])
    assert long.groupBy("runner_idx").count().count() == 3 and long.count() == 80 * 2 + 9 * 3
    found = inspection.suitability(keyed, long).join(keyed.select("market_id", "file").distinct(), "market_id")
    assert {r.file: r.reason for r in found.collect()} == {"2026-02-13_A_1.1.parquet": "passed_all_9_checks", "B_1.2.parquet": "too_short_or_missing_columns"}


CASES = [
    ({}, "passed_all_9_checks"), ({"total_matched_market": 10.0}, "low_liquidity"), ({"total_matched_market": float("nan")}, "passed_all_9_checks"), ({"result_closed": 0}, "result_not_closed"),
    ({"result_winner_idx_first": -1.0}, "winner_invalid"), ({"result_winner_selids": " "}, "winner_invalid"), ({"in_play": 1}, "pre_race_window_too_short"), ({"run[0].ob_imbalance": 0.0, "run[1].ob_imbalance": 0.0}, "ob_imbalance_flat"),
    ({"run[0].lay_price_1": 9.0}, "fav_spread_too_wide"), ({"run[0].back_price_1": 2.0, "run[0].lay_price_1": 2.1}, "fav_price_no_signal"), ({"run[0].prob_implied": float("nan")}, "prob_implied_too_null"),
    ({"run[0].back_price_1": float("nan"), "run[1].back_price_1": float("nan")}, "too_short_or_missing_columns"),
]


def test_reasons(spark, tmp_path):
    for i, (change, _) in enumerate(CASES):
        pd.DataFrame([race(t, [2.0, 3.0]) | change for t in range(80)]).to_parquet(tmp_path / f"{i}.parquet")
    rows = races.scan_snapshots(spark, str(tmp_path)).withColumn("market_id", F.regexp_extract("file", r"\d+", 0).cast("long")).transform(lambda d: q.step_index(d, ["ts_unix"]))
    rows = rows.withColumn("total_matched_market", F.nanvl("total_matched_market", F.lit(None).cast("double")))
    got = inspection.suitability(rows, q.unpivot_runners(rows, ["market_id", "step"])).collect()
    assert {r.market_id: r.reason for r in got} == {i: reason for i, (_, reason) in enumerate(CASES)}


def test_whitelist(spark, tmp_path):
    (tmp_path / "w.csv").write_text("file,is_suitable\na,True\nb, True \nc,False\na,True\n")
    assert sorted(r.file for r in races.read_whitelist(spark, str(tmp_path / "w.csv")).collect()) == ["a", "b"]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "m")
    sink.append_episode_metrics(fx.episodes(spark, SF).where("episode <= 30"), path)
    old = sink.read_metrics(spark, path)
    new = sink.resume_offset(old, fx.episodes(spark, SF).where("episode > 1490").drop("episode"))
    assert [r.episode for r in new.orderBy("step").collect()] == list(range(31, 41))
    sink.append_episode_metrics(new, path)
    assert sink.read_metrics(spark, path).count() == 40 and len(old.columns) == 39
    assert len(sink.VALIDATION.split(", ")) == 21


def test_vector_statistics(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 7)) * [1, 10, 1e-3, 5, 2, 7, 0] + [0, 1e4, 3, 0, 1, 2, 4]
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "observation array<double>").repartition(5)
    got = {r.feature: r for r in features.observation_stats(df).collect()}
    assert [got[i].mean for i in range(7)] == pytest.approx(x.mean(axis=0).tolist())
    assert [got[i].variance for i in range(7)] == pytest.approx(x.var(axis=0).tolist(), abs=1e-6)


def test_vector_has_the_state_of_the_replay(spark):
    snaps, clean = fx.snapshots(spark, SF), q.clean_quotes(fx.quotes(spark, SF))
    steps = backtest.backtest(clean, snaps)
    seen = features.build_observation(snaps, features.runner_features(clean), steps).join(steps.select("market_id", "step", "balance", "green_up", "positions"), ["market_id", "step"]).collect()
    names = features.slot_features()
    assert len(names) == 41 and all(len(r.observation) == 999 for r in seen)
    for r in random.Random(1).sample(seen, 100):
        assert r.observation[984] == pytest.approx(r.balance / 1000, rel=1e-6) and r.observation[998] == pytest.approx(r.green_up / 1000, abs=1e-6)
        for p in r.positions:
            own = r.observation[41 * p.runner_idx : 41 * p.runner_idx + 41]
            assert any(own) is False or own[names.index("net_position")] == pytest.approx(p.net_stake / 1000, abs=1e-6)


def test_shuffles(spark):
    """All windows of the features share the shuffle by market, runner or step keys; no Python runs there."""
    clean = q.clean_quotes(spark.read.parquet(_stored(spark)))
    plan = features.runner_features(clean)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow", plan)
    assert plan.count("Exchange hashpartitioning") <= 5


def test_inspection_shuffles_by_market_only(spark):
    """Snapshots and quotes go through one exchange by market_id for the measures of snapshots and one for those of runners."""
    snaps, raw = queries._snaps(spark, SF), queries._raw(spark, SF)
    plan = workloads.inspect(snaps, raw)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Final Plan ==")[0]
    exchanges = re.findall(r"(?<!Broadcast)Exchange (\w+)\(([^,)]*)", plan)
    assert exchanges and all(kind == "hashpartitioning" and key.startswith("market_id") for kind, key in exchanges)
    assert len(exchanges) <= 2


@pytest.mark.parametrize("name", ["whitelisted_races", "filtered_out_races", "suitability", "inspect_and_split"])
def test_inspection_by_query_moves_two_rows_a_market(spark, name):
    """Only measures by market and results by file are exchanged; quotes are neither exchanged, gathered by snapshot, broadcast nor written for it."""
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    moved = re.findall(r"(?<!Broadcast)Exchange \w+\(([^,)]*)#", plan)
    assert moved.count("market_id") == 1 and all(key in ("market_id", "file", "split") for key in moved)
    assert re.search(r"Exchange hashpartitioning\(market_id[^\n]*\n[^\w\n]*SortAggregate", plan)
    assert "collect_list" not in plan and "oddsbook_quotes" not in plan and "oddsbook_snapshots" in plan


def test_measures_of_a_hand_made_market(spark):
    """The favourite is the cheapest over 1 of the first row before the off, of equals the first; its rows may lack prices or quotes; the first runner of a row need not be runner 0."""
    snaps = spark.createDataFrame([(1, k, k * 1000, 2, 10.0 * k, 1, 0.0, "s", i) for k, i in enumerate([1, 0, 0, None, 0, 1])], "market_id long, step int, ts_unix long, runner_count int, total_matched_market double, result_closed int, result_winner_idx_first double, result_winner_selids string, in_play int")
    quoted = [(0, 1, 1.5, 1.6), (1, 1, 3.0, 3.3), (1, 2, 2.0, 2.1), (1, 3, 2.0, 2.2), (1, 4, 0.9, 1.0), (2, 2, 4.0, 3.9), (2, 3, 9.0, 9.9), (4, 1, None, 3.0), (4, 2, 2.5, 3.0), (5, 2, 7.0, 9.0), (8, 2, 2.0, 9.0)]
    raw = spark.createDataFrame([(1, k, r, b, y, float(k), None if k == 1 else 0.5) for k, r, b, y in quoted], "market_id long, step int, runner_idx int, back_price_1 double, lay_price_1 double, ob_imbalance double, prob_implied double")
    row = inspection.market_checks(snaps, raw).first()
    assert (row.fav, row.pre_race_snapshots, row.pre_race_secs, row.liquidity_at_off, row.n_runners, row.few_rows) == (2, 3, 3.0, 40.0, 2, True)
    assert (round(row.fav_spread, 9), row.fav_drift, row.prob_null_rate) == (12.5, 25.0, 0.5)
    assert abs(row.ob_imbalance - (4.5**0.5 + (7 / 3) ** 0.5 + 0.5**0.5) / 3) < 1e-9
    gone = inspection.market_checks(snaps, raw.where("step <> 4 OR runner_idx <> 2")).first()
    assert (gone.fav, round(gone.fav_spread, 9), gone.fav_drift) == (2, 5.0, 0.0)
    begun = inspection.market_checks(snaps.withColumn("in_play", F.lit(1)), raw).first()
    assert (begun.fav, begun.pre_race_snapshots, begun.liquidity_at_off, begun.prob_null_rate, begun.ob_imbalance) == (None, 0, None, 1.0, 0.0)
    priced = spark.range(12).selectExpr("1L AS market_id", "CAST(id AS int) AS step", "id AS ts_unix", "2 AS runner_count", "1D AS total_matched_market", "1 AS result_closed", "0D AS result_winner_idx_first", "'s' AS result_winner_selids")
    book = lambda rows: spark.createDataFrame([(1, k, r, b, 3.0, 0.0, 0.0) for k, r, b in rows], raw.schema)
    few = [inspection.market_checks(priced, book(rows)).first().few_rows for rows in ([(0, 0, None), (0, 1, 2.0)], [(0, 0, None), (0, 1, 2.0), (3, 1, 2.0)], [(3, 0, 2.0)], [(20, 0, 2.0), (3, 0, None)])]
    assert few == [True, False, False, True]


def test_inspection_of_odd_rows(spark):
    """Snapshots without quotes stay, quotes without a snapshot do not count, empty inputs give nothing."""
    snaps, raw = queries._snaps(spark, SF), queries._raw(spark, SF)
    market = snaps.first().market_id
    few = inspection.market_checks(snaps.where(f"market_id = {market}"), raw.where("false")).first()
    assert few.few_rows and few.fav is None and few.prob_null_rate == 1.0 and few.file.endswith(".parquet")
    assert inspection.market_checks(snaps.where("false"), raw).count() == 0
    gone = inspection.market_checks(snaps.where(f"market_id = {market} AND step <> 3"), raw).first()
    kept = inspection.market_checks(snaps.where(f"market_id = {market} AND step <> 3"), raw.where("step <> 3")).first()
    assert gone == kept


def test_dates_by_column_and_by_file_time(spark):
    at = datetime.datetime(2026, 2, 3, 12, 30)
    rows = spark.createDataFrame([("a", 1, None, at), ("a", 0, at, at), ("b", 0, None, at)], "file string, step int, market_time timestamp, modified timestamp")
    day = datetime.date(2026, 2, 3)
    assert {tuple(r) for r in split.file_dates(rows, "column").collect()} == {("a", day), ("b", None)}
    assert {tuple(r) for r in split.file_dates(rows, "modified").collect()} == {("a", day), ("b", day)}
    assert {tuple(r) for r in split.file_dates(rows, "filename").collect()} == {("a", None), ("b", None)}
    assert {(r.file, r.split) for r in split.temporal_split(split.file_dates(rows, "column")).collect()} == {("a", "validation"), ("b", "undated")}
    with pytest.raises(ValueError):
        split.file_dates(rows, "other")


def test_race_card(spark):
    rows = spark.createDataFrame([(1, 1, "f", 5, 0.1, "late"), (1, 0, "f", 4, None, None), (2, 0, "g", None, 0.02, "Y")], "market_id long, step int, file string, runner_count int, commission_rate double, venue string")
    card = {r.market_id: r for r in metrics.race_card(rows, ["venue", "race_type", "market_id"]).collect()}
    assert (card[1].venue, card[1].n_known, card[1].runner_count, card[1].commission_rate, card[1].snapshots) == (None, 0, 4, 0.05, 2)
    assert (card[2].venue, card[2].race_type, card[2].n_known, card[2].commission_rate) == ("Y", None, 1, 0.02)


def test_other_columns_are_those_of_the_last_rollout(spark):
    rows = spark.createDataFrame([(1, 0, 5.0, 3, "x"), (1, 1, 7.0, None, "y")], "val_episode int, rollout int, pnl double, num_trades int, note string")
    row = metrics.rollout_quantiles(rows).first()
    assert (row.realized_pnl, row.last_pnl, row.num_trades, row.note) == (6.0, 7.0, None, "y")


def _stored(spark):
    path = queries._folder(spark, "quotes")
    fx.quotes(spark, SF).write.parquet(path)
    return path


def test_workloads(spark):
    snaps, raw = fx.snapshots(spark, SF), fx.quotes(spark, SF)
    assert workloads.inspect(snaps, raw).count() == 15
    assert workloads.build_features(raw).count() == raw.count()
    assert workloads.report(workloads.run_backtest(snaps, raw)).first().episodes == 15
