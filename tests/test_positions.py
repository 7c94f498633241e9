"""The streamed ledger, positions as of each step, vectors with positions, and numbers without a single partition."""

from __future__ import annotations

import random
import resource
import re
import shutil
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from oddsbook import queries
from oddsbook.operators import backtest, carry, features, ledger, ranking, split
from oddsbook.plans import workloads
from oddsbook.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
TRADES = "market_id long, step long, runner_idx long, side string, price double, stake double, rate double"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def some_trades(seed, n=400, markets=4):
    rng = random.Random(seed)
    key = sorted({(rng.randrange(markets), rng.randrange(60), rng.randrange(3)) for _ in range(n)})
    return [(m, t, i, rng.choice(["BACK", "LAY"]), round(rng.uniform(1.02, 9), 2), float(rng.choice([0.005, 2, 3, 10, 10.004])), 0.05) for m, t, i in key]


def folded(rows):
    """{(market, runner): [(step, state)]} by the rules, one runner after the other."""
    out = {}
    for m, t, i, side, price, stake, rate in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        own = out.setdefault((m, i), [])
        s = dict(own[-1][1]) if own else dict.fromkeys(carry.STATE, 0.0)
        mine, other = ("back", "lay") if side == "BACK" else ("lay", "back")
        rest, move = stake, 1 if side == "BACK" else -1
        if s[f"{other}_stake"] > 0.01:
            cut = min(rest, s[f"{other}_stake"])
            gain = cut * (price - s["lay_price"]) / price if side == "BACK" else cut * (s["back_price"] - price) / price
            paid = gain * rate if gain > 0 else 0.0
            s["realised"] += gain - paid
            s["commission"] += paid
            s["net_stake"] += move * cut
            s[f"{other}_stake"] -= cut
            rest -= cut
            if s[f"{other}_stake"] < 0.01:
                s[f"{other}_stake"] = s[f"{other}_price"] = 0.0
        if rest > 0.01:
            total = s[f"{mine}_stake"] + rest
            s[f"{mine}_price"] = (s[f"{mine}_price"] * s[f"{mine}_stake"] + price * rest) / total
            s[f"{mine}_stake"] = total
            s["net_stake"] += move * rest
        own.append((t, s))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_ledger_against_the_rules(spark, seed):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # a runner goes on in the next batch
    try:
        rows = some_trades(seed)
        got = ledger.position_ledger(spark.createDataFrame(rows, TRADES).repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = folded(rows)
    assert len(got) == len(rows)
    for r in got:
        step, state = want[r.market_id, r.runner_idx][r.k - 1]
        assert r.step == step and {n: r[n] for n in carry.STATE} == {n: pytest.approx(v, abs=1e-9) for n, v in state.items()}


def test_ledger_without_netting_is_the_simple_one(spark):
    trades = fx.trades(spark, SF).withColumn("rate", F.lit(0.05))
    names = ["market_id", "runner_idx", "step", "k", *(F.round(c, 6).alias(c) for c in ("back_stake", "back_price", "lay_stake", "lay_price", "net_stake"))]
    one, two = ledger.position_ledger(trades, netting=False).select(names), ledger.position_ledger_simple(trades).select(names)
    assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0 and one.count() > 500


def test_a_runner_may_have_millions_of_trades(spark):
    """One runner with five million trades: the fold's memory does not grow with them."""
    n = 5_000_000
    trades = spark.range(n).selectExpr("1L AS market_id", "id AS step", "0L AS runner_idx", "IF(id % 3 = 0, 'LAY', 'BACK') AS side", "2.0 + id % 50 / 10 AS price", "3.0 AS stake", "0.05 AS rate")
    last = ledger.position_ledger(trades.selectExpr("*")).agg(F.count("*").alias("n"), F.max("k").alias("k"), F.max_by("net_stake", "k").alias("net")).first()
    assert (last.n, last.k) == (n, n) and last.net == pytest.approx(3.0 * (n - 2 * ((n + 2) // 3)))
    used = spark.sparkContext.parallelize(range(16), 16).map(lambda _: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss).max()
    assert used < 1 << 20  # kilobytes


def grid_of(spark, n_steps=60, markets=4, runners=3):
    """Every third quote or so is missing, with its row there."""
    rng = random.Random(9)
    rows = []
    for m in range(markets):
        for t in range(n_steps):
            for i in range(runners):
                b = None if rng.random() < 0.3 else round(rng.uniform(1.2, 8), 2)
                rows.append((m, t, i, b, None if b is None else round(b + 0.1, 2), None if b is None else b + 0.05))
    return rows, spark.createDataFrame(rows, "market_id long, step long, runner_idx long, back_price_1 double, lay_price_1 double, microprice double")


@pytest.mark.parametrize("before", [False, True])
def test_states_are_carried_over_steps_without_a_trade(spark, before):
    trades = some_trades(5, n=90)
    rows, grid = grid_of(spark)
    held = carry.marked(carry.carried(grid, ledger.position_ledger(spark.createDataFrame(trades, TRADES)), before))
    states = folded(trades)
    got = {(r.market_id, r.step, r.runner_idx): r for r in held.collect()}
    assert len(got) == len(rows) and any(r.mtm for r in got.values())
    sums = {}
    for m, t, i, b, y, _ in rows:
        own = [(at, s) for at, s in states.get((m, i), []) if at < t + (not before)]
        s = own[-1][1] if own else dict.fromkeys(carry.STATE, 0.0)
        r = got[m, t, i]
        assert {n: r[n] for n in carry.STATE} == {n: pytest.approx(v, abs=1e-9) for n, v in s.items()}
        assert (r.first_open, r.n_trades) == (own[0][0] if own else None, len(own))
        mtm = 0.0
        if b is not None:
            mtm += s["back_stake"] * (s["back_price"] - y) / y if s["back_stake"] > 0.01 else 0.0
            mtm += s["lay_stake"] * (b - s["lay_price"]) / b if s["lay_stake"] > 0.01 else 0.0
        assert r.mtm == pytest.approx(mtm, abs=1e-9)
        x = sums.setdefault((m, t), dict(exposure=0.0, net=0.0, n=0, sizes=[], mtm=0.0, green=0.0, recent=0, balance=1000.0))
        x["exposure"] += s["back_stake"] + s["lay_stake"] * max(0.0, s["lay_price"] - 1)
        x["net"] += s["net_stake"]
        x["n"] += bool(own)
        x["sizes"].append(abs(s["net_stake"]))
        x["mtm"] += mtm
        x["green"] += mtm * 0.95 if mtm > 0 else mtm
        x["recent"] += len(own)
        x["balance"] += s["realised"]
    for r in carry.by_step(held).collect():
        x = sums[r.market_id, r.step]
        total = sum(x["sizes"])
        assert (r.exposure, r.net_exposure, r.n_positions, r.portfolio_mtm, r.green_up, r.recent_trades, r.balance) == tuple(pytest.approx(v, abs=1e-9) for v in (x["exposure"], x["net"], x["n"], x["mtm"], x["green"], min(10, x["recent"]), x["balance"]))
        assert r.concentration == pytest.approx(sum((v / total) ** 2 for v in x["sizes"]) if total > 1e-6 else 0.0, abs=1e-6)
        assert r.green_up <= r.portfolio_mtm + 1e-6


def test_states_of_one_step_count_in_order_and_strangers_give_no_rows(spark):
    grid = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 0, 0)], "market_id long, step long, runner_idx long")
    states = spark.createDataFrame([(1, 0, 0, 2, 7.0), (1, 0, 0, 1, 5.0), (1, 9, 0, 3, 8.0), (1, 0, 4, 1, 1.0), (3, 0, 0, 1, 1.0)], "market_id long, step long, runner_idx long, k long, net_stake double")
    rows = lambda before: sorted((r.market_id, r.step, r.net_stake, r.n_trades) for r in carry.carried(grid, states, before).collect())
    assert rows(False) == [(1, 0, 7.0, 2), (1, 1, 7.0, 2), (2, 0, 0.0, 0)] and rows(True) == [(1, 0, 0.0, 0), (1, 1, 7.0, 2), (2, 0, 0.0, 0)]
    assert carry.carried(grid.where("false"), states).count() == 0 and carry.carried(grid, states.where("false")).where("n_trades > 0").count() == 0


def test_positions_by_step_take_one_exchange(spark, tmp_path):
    """The grid and the states are dealt out once, for the window and the sums; so is all of the vector but its join with snapshots."""
    queries._clean(spark, SF).write.parquet(str(tmp_path / "grid"))
    queries._ledger(spark, SF).write.parquet(str(tmp_path / "states"))
    grid, states = (spark.read.parquet(str(tmp_path / n)) for n in ("grid", "states"))
    plan = plan_of(carry.by_step(carry.marked(carry.carried(grid, states))))
    assert plan.count("Exchange ") == 1 and "hashpartitioning(market_id" in plan
    rows = features.positioned(grid, states, queries._markets(spark, SF))
    assert plan_of(rows).count("Exchange hashpartitioning(market_id") == 1


def test_vector_with_positions_is_that_of_the_replay(spark):
    """Trades of the replay, folded and carried, give the vector that the replay's own state gives, at every step up to the end."""
    snaps, raw = queries._snaps(spark, SF), queries._raw(spark, SF)
    steps = workloads.run_backtest(snaps, raw)
    rates = queries._markets(spark, SF)
    trades = backtest.backtest_trades(steps).join(rates.select("market_id", "rate"), "market_id")
    states = ledger.position_ledger(trades)
    clean = queries._clean(spark, SF)
    ours = features.build_observation(snaps, features.runner_features(features.positioned(clean, states, rates))).withColumnRenamed("observation", "ours")
    theirs = features.build_observation(snaps, features.runner_features(clean), steps)
    both = theirs.join(steps.select("market_id", "step"), ["market_id", "step"]).join(ours, ["market_id", "step"])
    far = F.array_max(F.transform(F.arrays_zip("ours", "observation"), lambda x: F.abs(x["ours"] - x["observation"])))
    found = both.agg(F.count("*").alias("n"), F.max(far).alias("far"), F.count_if(F.exists(F.slice("ours", 985, 3), lambda v: (v != 1) & (v != 0))).alias("moved")).first()
    assert found.n == steps.count() and found.far < 1e-4 and found.moved > 50


def test_position_places_are_not_constant(spark):
    rows = queries.QUERIES["build_observation_with_positions"](spark, SF)
    held = rows.where("slot < 24").agg(*(F.count_distinct(f"v{i}").alias(f"v{i}") for i in (29, 30, 39))).first()
    world = rows.where("slot = 24").agg(*(F.count_distinct(f"v{i}").alias(f"v{i}") for i in (0, 1, 2, 3, 5, 6, 8, 9, 10, 14))).first()
    assert min(*held, *world) > 3


def test_parts_of_vectors_are_cut_in_the_task(spark):
    """No vector of 999 places goes through the plan, to be cut up by functions over arrays; the parts are those of the vectors."""
    assert not re.search("lambda|slice|sequence", plan_of(queries.QUERIES["build_observation_with_positions"](spark, SF)))
    rows = features.runner_features(queries._clean(spark, SF))
    whole = {(r.market_id, r.step): r.observation for r in features.build_observation(queries._snaps(spark, SF), rows).collect()}
    parts = defaultdict(dict)
    for r in features.build_observation(queries._snaps(spark, SF), rows, by_slot=True).collect():
        assert any(r[3:]) and (r.slot < 24 or set(r[18:]) == {None})
        parts[r.market_id, r.step][r.slot] = list(r[3:])
    for k, o in whole.items():
        cut = [v for slot in range(25) for v in parts[k].get(slot, [0.0] * 41)]
        assert [v or 0.0 for v in cut[:999]] == o


def test_numbers_need_no_single_partition(spark):
    rows = spark.range(5000).selectExpr("(id * 7919) % 5000 AS v", "id", "'x' AS place")
    got = ranking.numbered(rows, [F.desc("v")])
    assert "SinglePartition" not in plan_of(got)
    assert [(r.v, r.place) for r in got.orderBy("place").collect()] == [(4999 - i, i + 1) for i in range(5000)]
    assert ranking.numbered(rows.where("false"), [F.col("v")]).count() == 0
    ties = ranking.numbered(spark.createDataFrame([(None,), (2,), (2,), (1,)], "v int"), [F.col("v")], start=5)
    assert sorted((r.place, r.v) for r in ties.collect()) == [(5, None), (6, 1), (7, 2), (8, 2)]


def test_orders_of_files_need_no_single_partition(spark):
    files = spark.range(300).selectExpr("concat('2025-1', id % 3, '-1', id % 7, '_', id, '.parquet') AS file")
    dated = split.temporal_split(files)
    for df in (split.validation_order(dated), split.train_shuffle(dated), split.tail_split(files, 20)):
        assert "SinglePartition" not in plan_of(df)
    assert split.tail_split(files, 20).where("split = 'validation'").count() == 20
    assert sorted(r.place for r in split.train_shuffle(dated).collect()) == list(range(1, 301))


def test_derived_tables_follow_their_sources(spark, tmp_path):
    for t in ("events", "orders"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path)
    n = queries.QUERIES["step_index"](spark, str(tmp_path)).count()
    half = spark.read.parquet(f"{SF}/events.parquet").where("event_id % 2 = 0").toPandas()
    half.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    assert queries.QUERIES["step_index"](spark, str(tmp_path)).count() == len(half) < n


@pytest.mark.parametrize("name", ["build_observation", "unpivot_runners", "observation_stats_wide"])
def test_quotes_are_not_exchanged_again(spark, name):
    """The derived tables are dealt by market when they are written: no wide row goes through an exchange after that."""
    plan = plan_of(queries.QUERIES[name](spark, SF)).split("== Final Plan ==")[0]
    assert not [e for e in re.findall(r"(?<!Broadcast)Exchange hashpartitioning\((\w+)", plan) if e not in ("feature",)]
