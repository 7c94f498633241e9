"""DuckDB SQL for the registered queries, over the same general tables. Doubles are rounded to 6 digits, as in the queries."""

from __future__ import annotations

from oddsbook.sources import fixtures as fx

_NAMES = {n: n for n in ("events", "orders", "snapshots", "slots", "quotes", "episodes", "rollouts")}
_FAV = "SELECT market_id, min(struct_pack(p := back_price_1, r := runner_idx)).r AS favourite FROM quotes WHERE step = 0 AND back_price_1 > 1.0 GROUP BY market_id"

#: Tables that the queries build on, in an order in which each only needs those before it.
_TABLES = {
    "snapshots": fx.SNAPSHOTS.format(ms=fx.DUCK_MS, **_NAMES),
    "slots": "SELECT range AS runner_idx FROM range(24)",
    "rollouts": "SELECT range AS rollout FROM range(5)",
    "quotes": fx.QUOTES.format(**_NAMES),
    "trades": fx.TRADES.format(**_NAMES),
    "episodes": fx.EPISODES.format(**_NAMES),
    "rollout_pnl": fx.ROLLOUTS.format(**_NAMES),
    "files": "SELECT market_id, file FROM snapshots WHERE step = 0",
    "rates": "SELECT market_id, runner_count, coalesce(commission_rate, 0.05) AS rate FROM snapshots WHERE step = 0",
    "cleaned": """SELECT * REPLACE (coalesce(microprice, (back_price_1 + lay_price_1) / 2) AS microprice,
  coalesce(back_price_2, back_price_1) AS back_price_2, coalesce(lay_price_2, lay_price_1) AS lay_price_2, coalesce(back_price_3, back_price_1) AS back_price_3, coalesce(lay_price_3, lay_price_1) AS lay_price_3,
  coalesce(back_size_1, 0) AS back_size_1, coalesce(lay_size_1, 0) AS lay_size_1, coalesce(back_size_2, 0) AS back_size_2, coalesce(lay_size_2, 0) AS lay_size_2, coalesce(back_size_3, 0) AS back_size_3, coalesce(lay_size_3, 0) AS lay_size_3,
  coalesce(has_level_1, 1) AS has_level_1, coalesce(has_level_2, 0) AS has_level_2, coalesce(has_level_3, 0) AS has_level_3, coalesce(last_traded_price, back_price_1) AS last_traded_price,
  coalesce(traded_vol_total, 0) AS traded_vol_total, coalesce(traded_vol_60s, 0) AS traded_vol_60s, coalesce(secs_since_last_trade, 999.0) AS secs_since_last_trade) FROM quotes""",
    "clean": """SELECT * REPLACE (
  coalesce(ob_imbalance, CASE WHEN back_size_1 + lay_size_1 > 0 THEN (back_size_1 - lay_size_1) / (back_size_1 + lay_size_1) ELSE 0.0 END) AS ob_imbalance,
  coalesce(rel_spread, abs(back_price_1 - lay_price_1) / greatest(microprice, 1.01)) AS rel_spread,
  coalesce(prob_implied, CASE WHEN microprice > 1.01 THEN 1 / microprice ELSE 0.5 END) AS prob_implied) FROM cleaned""",
    "quoted": "SELECT * FROM clean WHERE back_price_1 IS NOT NULL AND lay_price_1 IS NOT NULL",
    "fav": _FAV,
    "live": "SELECT * FROM (SELECT *, min(CASE WHEN in_play = 1 THEN step END) OVER w AS off_step, coalesce(min(CASE WHEN in_play = 1 THEN step END) OVER w, max(step) OVER w) AS closing_step FROM snapshots WINDOW w AS (PARTITION BY market_id)) t WHERE off_step IS NULL OR step < off_step",
    "grid": "SELECT market_id, step, runner_idx, traded_vol_total, back_price_1 IS NOT NULL AND lay_price_1 IS NOT NULL AS ok, CASE WHEN back_price_1 IS NOT NULL AND lay_price_1 IS NOT NULL THEN microprice END AS m, CASE WHEN back_price_1 IS NOT NULL AND lay_price_1 IS NOT NULL THEN ob_imbalance END AS i, CASE WHEN back_price_1 IS NOT NULL AND lay_price_1 IS NOT NULL THEN traded_vol_60s END AS v, CASE WHEN back_price_1 IS NOT NULL AND lay_price_1 IS NOT NULL THEN rel_spread END AS s, prob_implied FROM clean",
    "lagged": "SELECT g.*, favourite, lag(m) OVER w AS m1, lag(i) OVER w AS i1, lag(v) OVER w AS v1, lag(s) OVER w AS s1, lag(m, 5) OVER w AS m5, sum(CASE WHEN ok AND traded_vol_total > 0 AND m > 1.01 THEN m * greatest(0, v) END) OVER w AS paid, sum(CASE WHEN ok AND traded_vol_total > 0 AND m > 1.01 THEN greatest(0, v) END) OVER w AS vol, min(CASE WHEN m > 1.01 THEN m END) OVER w AS low, max(CASE WHEN m > 1.01 THEN m END) OVER w AS high, max(CASE WHEN g.runner_idx = favourite THEN m END) OVER (PARTITION BY g.market_id, g.step) AS fm FROM grid g LEFT JOIN fav USING (market_id) WINDOW w AS (PARTITION BY g.market_id, g.runner_idx ORDER BY g.step)",
    "features": """SELECT *, greatest(-0.2, least(0.2, coalesce(CASE WHEN m1 > 1.01 THEN (m - m1) / m1 END, 0))) AS micro_delta_1,
  greatest(-0.5, least(0.5, coalesce(CASE WHEN m5 > 1.01 THEN (m - m5) / m5 END, 0))) AS micro_delta_5, greatest(-1, least(1, coalesce(i - i1, 0))) AS imbalance_delta,
  greatest(-2, least(2, coalesce(CASE WHEN v1 > 0 THEN (v - v1) / greatest(v1, 1) END, 0))) AS vol60_delta, greatest(-0.05, least(0.05, coalesce(s - s1, 0))) AS spread_delta,
  greatest(-0.5, least(0.5, CASE WHEN traded_vol_total > 0 AND m > 1.01 AND vol > 0 AND paid / vol > 1.01 THEN m / (paid / vol) - 1 ELSE 0 END)) AS vwap_ratio,
  CASE WHEN m > 1.01 AND high - low > 0.01 THEN (m - low) / (high - low) ELSE 0.5 END AS price_percentile,
  greatest(-2, least(2, CASE WHEN runner_idx <> favourite AND fm > 1.01 AND m > 1.01 THEN (ln(m + 1e-8) - ln(fm + 1e-8)) / ln(1001.0) ELSE 0 END)) AS favourite_delta FROM lagged WHERE ok""",
    "pre": "SELECT s.*, row_number() OVER w - 1 AS nth, count(*) OVER (PARTITION BY market_id) AS n_pre, row_number() OVER (PARTITION BY market_id ORDER BY step DESC) AS from_end FROM snapshots s WHERE in_play = 0 WINDOW w AS (PARTITION BY market_id ORDER BY step)",
    "prefav": "SELECT p.market_id, min(struct_pack(p := back_price_1, r := runner_idx)) AS f FROM pre p JOIN quotes q ON q.market_id = p.market_id AND q.step = p.step WHERE nth = 0 AND back_price_1 > 1.0 GROUP BY p.market_id",
    "favrows": "SELECT p.market_id, p.step, p.nth, p.n_pre, p.from_end, f.p AS start_price, q.back_price_1 AS fb, q.lay_price_1 AS fl FROM pre p JOIN prefav f USING (market_id) LEFT JOIN quotes q ON q.market_id = p.market_id AND q.step = p.step AND q.runner_idx = f.r",
    "runners": "SELECT q.market_id, q.runner_idx, CASE WHEN count(ob_imbalance) > 1 THEN stddev_samp(ob_imbalance) END AS sd, sum(CASE WHEN prob_implied IS NULL THEN 1 ELSE 0 END) AS nulls, count(*) AS n FROM quotes q JOIN pre USING (market_id, step) GROUP BY ALL",
    "checks": """SELECT m.market_id, m.few_rows, m.n_runners, coalesce(CASE WHEN p.n >= 2 THEN p.secs END, 0) AS pre_race_secs, coalesce(p.n, 0) AS pre_race_snapshots, p.matched AS liquidity_at_off, f.f.r AS fav, v.spread AS fav_spread,
  coalesce(abs(v.last_price - v.start_price) / v.start_price * 100, 0) AS fav_drift, coalesce(r.sd, 0) AS ob_imbalance, m.result_closed, m.winner_valid, coalesce(r.null_rate, 1.0) AS prob_null_rate
FROM (SELECT s.market_id, CASE WHEN count(DISTINCT s.step) < 10 OR count(q.back_price_1) = 0 THEN 1 ELSE 0 END AS few_rows, max(s.runner_count) AS n_runners, CAST(arg_max(s.result_closed, s.step) AS INT) AS result_closed,
    CASE WHEN arg_max(s.result_winner_idx_first, s.step) <> -1 AND trim(arg_max(s.result_winner_selids, s.step)) <> '' THEN 1 ELSE 0 END AS winner_valid
  FROM snapshots s LEFT JOIN quotes q ON q.market_id = s.market_id AND q.step = s.step AND q.runner_idx = 0 GROUP BY s.market_id) m
LEFT JOIN (SELECT market_id, count(*) AS n, CAST(max(ts_unix) - min(ts_unix) AS DOUBLE) / 1000 AS secs, max(CASE WHEN from_end = 1 THEN total_matched_market END) AS matched FROM pre GROUP BY market_id) p USING (market_id)
LEFT JOIN prefav f USING (market_id)
LEFT JOIN (SELECT market_id, avg(CASE WHEN nth % greatest(1, n_pre // 50) = 0 AND fb > 0 AND fl > fb THEN (fl - fb) / fb * 100 END) AS spread, max(CASE WHEN from_end = 1 THEN fb END) AS last_price, max(start_price) AS start_price FROM favrows GROUP BY market_id) v USING (market_id)
LEFT JOIN (SELECT market_id, avg(sd) AS sd, CAST(sum(nulls) AS DOUBLE) / sum(n) AS null_rate FROM runners GROUP BY market_id) r USING (market_id)""",
    "suitable": """SELECT market_id, reason = 'passed_all_9_checks' AS is_suitable, reason FROM (SELECT market_id, CASE WHEN few_rows = 1 THEN 'too_short_or_missing_columns' WHEN n_runners = 0 THEN 'no_runners' WHEN pre_race_secs < 60 THEN 'pre_race_window_too_short'
  WHEN pre_race_snapshots < 30 THEN 'too_few_pre_race_snapshots' WHEN liquidity_at_off < 5000 THEN 'low_liquidity' WHEN fav IS NULL THEN 'no_favourite_found' WHEN fav_spread IS NULL OR fav_spread > 8 THEN 'fav_spread_too_wide'
  WHEN fav_drift < 1 THEN 'fav_price_no_signal' WHEN ob_imbalance < 0.1 THEN 'ob_imbalance_flat' WHEN result_closed <> 1 THEN 'result_not_closed' WHEN winner_valid <> 1 THEN 'winner_invalid' WHEN prob_null_rate > 0.3 THEN 'prob_implied_too_null'
  ELSE 'passed_all_9_checks' END AS reason FROM checks) t""",
    "dated": "SELECT file, TRY_CAST(nullif(regexp_extract(file, '(20\\d{2})[-_]?(\\d{2})[-_]?(\\d{2})', 1), '') || '-' || regexp_extract(file, '(20\\d{2})[-_]?(\\d{2})[-_]?(\\d{2})', 2) || '-' || regexp_extract(file, '(20\\d{2})[-_]?(\\d{2})[-_]?(\\d{2})', 3) AS DATE) AS race_date FROM files",
    "split": "SELECT *, CASE WHEN race_date IS NULL THEN 'undated' WHEN race_date BETWEEN DATE '2025-10-01' AND DATE '2026-01-31' THEN 'train' WHEN race_date BETWEEN DATE '2026-02-01' AND DATE '2026-03-31' THEN 'validation' END AS split FROM dated",
    "periods": "SELECT range AS fold, 'train' AS split, DATE '2025-10-01' + CAST(range * 30 AS INT) AS first, DATE '2025-10-01' + CAST(range * 30 + 69 AS INT) AS last FROM range(4) UNION ALL SELECT range, 'validation', DATE '2025-10-01' + CAST(range * 30 + 73 - CASE WHEN range = 3 THEN 20 ELSE 0 END AS INT), DATE '2025-10-01' + CAST(range * 30 + 102 AS INT) FROM range(4)",
    "folds": "SELECT d.file, d.race_date, p.fold, p.split FROM dated d JOIN periods p ON d.race_date BETWEEN p.first AND p.last UNION ALL SELECT file, race_date, NULL, 'undated' FROM dated WHERE race_date IS NULL",
    "proposals": "SELECT q.*, 800.0::DOUBLE AS available, 800.0::DOUBLE * ((allocation + 1.0) / 2.0) * 1.5 AS budget FROM clean q JOIN live l ON l.market_id = q.market_id AND l.step = q.step WHERE l.market_status = 'OPEN'",
    "sized": """SELECT *, CASE WHEN side = 'BACK' THEN own WHEN price > 1.01 THEN own / (price - 1.0) ELSE 0 END AS intended, least(own, available * 0.3, CASE WHEN side = 'BACK' THEN total * 0.5 ELSE total * 0.5 * (price - 1.0) END) AS liability
FROM (SELECT *, CASE WHEN signal > 0 THEN 'BACK' ELSE 'LAY' END AS side, CASE WHEN signal > 0 THEN back_price_1 ELSE lay_price_1 END AS price, budget * abs(signal) * CASE WHEN ret_std_5s > 0.05 THEN 0.3 ELSE 1.0 END AS own,
  CASE WHEN signal > 0 THEN back_size_1 + back_size_2 + back_size_3 ELSE lay_size_1 + lay_size_2 + lay_size_3 END AS total FROM proposals) t""",
    "admitted": """SELECT *, CASE WHEN abs(signal) < 0.3 THEN 'below_threshold' WHEN back_price_1 IS NULL OR lay_price_1 IS NULL THEN 'no_quote' WHEN has_level_1 = 0 THEN 'no_level_1' WHEN secs_since_last_trade > 60 THEN 'stale'
  WHEN price < 1.01 OR price > 1000 THEN 'price_range' WHEN own < 5 THEN 'small_budget' WHEN intended > total * 0.5 THEN 'depth' WHEN liability < 5 THEN 'small_liability' WHEN stake < 2 THEN 'stake_floor' ELSE 'accepted' END AS reason
FROM (SELECT *, CASE WHEN side = 'BACK' THEN liability ELSE liability / (price - 1.0) END AS stake FROM sized) t""",
    "simple": """SELECT market_id, runner_idx, step, k, bs AS back_stake, CASE WHEN bs > 0 THEN bp / bs ELSE 0 END AS back_price, ls AS lay_stake, CASE WHEN ls > 0 THEN lp / ls ELSE 0 END AS lay_price, bs - ls AS net_stake FROM (
SELECT market_id, runner_idx, step, row_number() OVER w AS k, sum(CASE WHEN side = 'BACK' THEN stake ELSE 0.0 END) OVER w AS bs, sum(CASE WHEN side = 'BACK' THEN stake * price ELSE 0.0 END) OVER w AS bp,
  sum(CASE WHEN side = 'LAY' THEN stake ELSE 0.0 END) OVER w AS ls, sum(CASE WHEN side = 'LAY' THEN stake * price ELSE 0.0 END) OVER w AS lp FROM trades WINDOW w AS (PARTITION BY market_id, runner_idx ORDER BY step)) t""",
    "positions": "SELECT * FROM simple QUALIFY row_number() OVER (PARTITION BY market_id, runner_idx ORDER BY k DESC) = 1",
    "closing": "SELECT q.* FROM clean q JOIN (SELECT market_id, coalesce(min(CASE WHEN in_play = 1 THEN step END), max(step)) AS step FROM snapshots GROUP BY market_id) c USING (market_id, step)",
    "marked": """SELECT p.*, CASE WHEN c.back_price_1 IS NULL OR c.lay_price_1 IS NULL THEN 0 ELSE CASE WHEN back_stake > 0.01 AND back_price > 1.01 AND c.lay_price_1 > 1.01 THEN back_stake * (back_price - c.lay_price_1) / c.lay_price_1 ELSE 0 END
  + CASE WHEN lay_stake > 0.01 AND lay_price > 1.01 AND c.back_price_1 > 1.01 THEN lay_stake * (c.back_price_1 - lay_price) / c.back_price_1 ELSE 0 END END AS mtm FROM positions p LEFT JOIN closing c USING (market_id, runner_idx)""",
    "payoffs": """SELECT market_id, winner, CASE WHEN total > 0 THEN total * (1.0 - rate) ELSE total END AS payoff FROM (
SELECT r.market_id, j.runner_idx AS winner, r.rate, coalesce(sum(CASE WHEN p.runner_idx = j.runner_idx THEN CASE WHEN back_stake > 0.01 AND back_price > 1.01 THEN back_stake * (back_price - 1) ELSE 0 END - CASE WHEN lay_stake > 0.01 AND lay_price > 1.01 THEN lay_stake * (lay_price - 1) ELSE 0 END ELSE lay_stake - back_stake END), 0) AS total
FROM rates r JOIN slots j ON j.runner_idx < r.runner_count LEFT JOIN positions p ON p.market_id = r.market_id AND p.runner_idx < r.runner_count AND (back_stake > 0.01 OR lay_stake > 0.01) GROUP BY ALL) t""",
    "tr": "SELECT *, row_number() OVER (PARTITION BY market_id, runner_idx ORDER BY step) AS k FROM trades",
    "pool": "SELECT *, least(1, greatest(0, prob_implied)) AS f_prob, greatest(0, least(1, prob_implied)) <> 0 OR micro_delta_1 <> 0 OR price_percentile <> 0 AS act FROM features",
}

_LEDGER = """l AS (SELECT market_id, runner_idx, 0::BIGINT AS k, 0.0::DOUBLE AS bs, 0.0::DOUBLE AS wb, 0.0::DOUBLE AS ls, 0.0::DOUBLE AS wl, 0.0::DOUBLE AS realised, 0.0::DOUBLE AS paid FROM (SELECT DISTINCT market_id, runner_idx FROM tr) t0
UNION ALL
SELECT market_id, runner_idx, k, CASE WHEN side = 'BACK' THEN (CASE WHEN rem > 0.01 THEN bs + rem ELSE bs END) ELSE bs2 END, CASE WHEN side = 'BACK' THEN (CASE WHEN rem > 0.01 THEN (wb * bs + price * rem) / (bs + rem) ELSE wb END) ELSE (CASE WHEN bs2 = 0 THEN 0 ELSE wb END) END,
  CASE WHEN side = 'LAY' THEN (CASE WHEN rem > 0.01 THEN ls + rem ELSE ls END) ELSE ls2 END, CASE WHEN side = 'LAY' THEN (CASE WHEN rem > 0.01 THEN (wl * ls + price * rem) / (ls + rem) ELSE wl END) ELSE (CASE WHEN ls2 = 0 THEN 0 ELSE wl END) END,
  realised + CASE WHEN pnl > 0 THEN pnl * 0.95 ELSE pnl END, paid + CASE WHEN pnl > 0 THEN pnl * 0.05 ELSE 0 END
FROM (SELECT *, CASE WHEN side = 'LAY' AND bs > 0.01 THEN (CASE WHEN bs - c < 0.01 THEN 0 ELSE bs - c END) ELSE bs END AS bs2, CASE WHEN side = 'BACK' AND ls > 0.01 THEN (CASE WHEN ls - c < 0.01 THEN 0 ELSE ls - c END) ELSE ls END AS ls2, stake - c AS rem,
  CASE WHEN side = 'BACK' THEN c * (price - wl) / price ELSE c * (wb - price) / price END AS pnl
  FROM (SELECT l.market_id, l.runner_idx, t.k, l.bs, l.wb, l.ls, l.wl, l.realised, l.paid, t.side, t.price, t.stake, CASE WHEN t.side = 'BACK' AND l.ls > 0.01 THEN least(t.stake, l.ls) WHEN t.side = 'LAY' AND l.bs > 0.01 THEN least(t.stake, l.bs) ELSE 0.0 END AS c
    FROM l JOIN tr t ON t.market_id = l.market_id AND t.runner_idx = l.runner_idx AND t.k = l.k + 1) a) b)"""

#: The netted position of every runner as of each step, after the trades of the step (as_of) or before them (as_of_before), with its mark, and sums by step.
_AS_OF = """SELECT *, CASE WHEN back_price_1 IS NULL OR lay_price_1 IS NULL THEN 0 ELSE CASE WHEN bs > 0.01 AND wb > 1.01 AND lay_price_1 > 1.01 THEN bs * (wb - lay_price_1) / lay_price_1 ELSE 0 END
  + CASE WHEN ls > 0.01 AND wl > 1.01 AND back_price_1 > 1.01 THEN ls * (back_price_1 - wl) / back_price_1 ELSE 0 END END AS mtm
FROM (SELECT q.market_id, q.step, q.runner_idx, q.back_price_1, q.lay_price_1, m.rate, m.n_steps, coalesce(s.k, 0) AS n_trades, s.first_open, coalesce(s.bs, 0) AS bs, coalesce(s.wb, 0) AS wb, coalesce(s.ls, 0) AS ls, coalesce(s.wl, 0) AS wl,
    coalesce(s.bs - s.ls, 0) AS net, coalesce(s.realised, 0) AS realised, coalesce(s.paid, 0) AS paid
  FROM clean q JOIN (SELECT market_id, n_steps, coalesce(commission_rate, 0.05) AS rate FROM snapshots WHERE step = 0) m ON m.market_id = q.market_id
  ASOF LEFT JOIN netted s ON q.market_id = s.market_id AND q.runner_idx = s.runner_idx AND q.step {after} s.step) t"""
_STEPS = """SELECT market_id, step, sum(bs) + sum(CASE WHEN wl > 1 THEN ls * (wl - 1) ELSE 0 END) AS exposure, sum(net) AS net_exposure, count(*) FILTER (WHERE n_trades > 0) AS n_positions,
  coalesce(sum(CASE WHEN abs(net) > 1e-6 THEN net * net END) / (sum(CASE WHEN abs(net) > 1e-6 THEN abs(net) END) * sum(CASE WHEN abs(net) > 1e-6 THEN abs(net) END)), 0) AS concentration, sum(mtm) AS portfolio_mtm,
  sum(CASE WHEN mtm > 0 THEN mtm * (1 - rate) ELSE mtm END) AS green_up, sum(CASE WHEN mtm > 0 THEN mtm * rate ELSE 0 END) AS closing, CAST(least(10, sum(n_trades)) AS BIGINT) AS recent, 1000 + sum(realised) AS balance, sum(paid) AS paid FROM {of} GROUP BY market_id, step"""
_NETTED = {
    "netted": "SELECT l.market_id, l.runner_idx, t.step, l.k, l.bs, l.wb, l.ls, l.wl, l.realised, l.paid, min(t.step) OVER (PARTITION BY l.market_id, l.runner_idx) AS first_open FROM l JOIN tr t ON t.market_id = l.market_id AND t.runner_idx = l.runner_idx AND t.k = l.k",
    "as_of": _AS_OF.format(after=">="),
    "as_of_before": _AS_OF.format(after=">"),
    "asof_steps": _STEPS.format(of="as_of"),
    "before_steps": _STEPS.format(of="as_of_before"),
}

_KEY = "market_id, step, runner_idx"
_SIDE = "'BACK'"


def _r(expression: str, name: str = "", digits: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE) + 1e-9, {digits}) + 0.0 AS {name or expression}"


def _rs(names: str) -> str:
    return ", ".join(_r(n.strip()) for n in names.split(","))


def _price(c: str) -> str:
    return f"CASE WHEN {c} < 1.01 THEN 0.0 ELSE ln({c} + 1e-8) / ln(1001.0) END"


def _log(c: str) -> str:
    return f"ln(1 + (greatest(0.0, {c}) + 1e-8))"


def _unit(c: str, low: str, high: str) -> str:
    return f"greatest(0.0, least(1.0, ({c} - {low}) / ({high} - {low})))"


_BASE = (
    {f"f_{s}_{w}_{i}": (_price if w == "price" else _log)(f"{s}_{w}_{i}") for i in (1, 2, 3) for w in ("price", "size") for s in ("back", "lay")}
    | {"f_microprice": _price("microprice"), "f_imbalance": _unit("ob_imbalance", "(-1.0)", "1.0"), "f_spread": _unit("rel_spread", "0.0", "0.1"), "f_prob": _unit("prob_implied", "0.0", "1.0"), "f_ret_std_5s": _log("ret_std_5s"), "f_ret_std_20s": _log("ret_std_20s"),
       "f_ltp": _price("last_traded_price"), "f_vol_total": _log("traded_vol_total"), "f_vol_60s": _log("traded_vol_60s"), "f_since_trade": _log("secs_since_last_trade + 1"), **{f"f_has_level_{i}": f"has_level_{i}" for i in (1, 2, 3)},
       "f_back_depth": _log("(back_size_1 + back_size_2 + back_size_3)"), "f_lay_depth": _log("(lay_size_1 + lay_size_2 + lay_size_3)"), "f_depth_share": "CASE WHEN back_size_1 + back_size_2 + back_size_3 > 0 THEN back_size_1 / (back_size_1 + back_size_2 + back_size_3) ELSE 1.0 END",
       "f_vol_accel": "CASE WHEN traded_vol_total > 0 THEN greatest(0.0, least(1.0, traded_vol_60s / traded_vol_total)) ELSE 0.0 END"}
)
_GLOBAL = {"g_progress": "step / n_steps", "g_runner_count": _unit("runner_count", "2.0", "24.0"), "g_secs_to_off": f"greatest(0.0, least(1.5, {_log('secs_to_off')} / {_log('3600.0')}))", "g_total_matched": f"greatest(0.0, least(1.5, {_log('total_matched_market')} / {_log('1000000.0')}))", "g_prob_entropy": _unit("prob_entropy", "0.0", "3.2")}
_VECTOR = ["f_microprice", "f_imbalance", "f_spread", "f_prob", "f_vol_60s", "f_depth_share"]
_TEXT = "CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN 'abc' WHEN o_orderkey % 5 = 2 THEN 'NaN' WHEN o_orderkey % 5 = 3 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END"
_P = "CASE WHEN st < 50000 THEN 0.0 WHEN st >= 500000 THEN 1.0 ELSE pow((st - 50000) / 450000.0, 1.5) END"
_BASE_LIST = ", ".join(_r(e, n) for n, e in _BASE.items())
_MEANS = "realized_pnl, max_drawdown, num_trades, commission_paid, depth_violations, suspended_violations, back_trades, lay_trades, back_exposure, lay_exposure"
_STATS = " UNION ALL ".join(f"SELECT {i} AS feature, count(*) AS n, {_r(f'avg({_BASE[n]})', 'mean')}, {_r(f'var_pop({_BASE[n]})', 'variance')} FROM quoted" for i, n in enumerate(_VECTOR))

_BODIES = {
    "scan_snapshots": "SELECT s.market_id, s.step, s.ts_unix, s.runner_count, s.market_status, " + _r("s.total_matched_market", "total_matched_market") + ", " + _r("max(CASE WHEN q.runner_idx = 0 THEN back_price_1 END)", "b0") + ", " + _r("max(CASE WHEN q.runner_idx = 6 THEN lay_price_1 END)", "l6") + " FROM snapshots s JOIN quotes q ON q.market_id = s.market_id AND q.step = s.step GROUP BY s.market_id, s.step, s.ts_unix, s.runner_count, s.market_status, s.total_matched_market",
    "read_whitelist": "SELECT file FROM files JOIN suitable USING (market_id) WHERE is_suitable",
    "append_episode_metrics": "SELECT episode, step, num_trades, " + _r("realized_pnl") + ", back_trades, CAST(NULL AS DOUBLE) AS green_up_pnl FROM episodes",
    "append_validation_metrics": "SELECT val_episode, " + _r("quantile_cont(pnl, 0.5)", "realized_pnl") + ", " + _r("quantile_cont(pnl, 0.1)", "pnl_p10") + ", " + _r("quantile_cont(pnl, 0.9)", "pnl_p90") + ", count(*) AS stochastic_rollouts, CAST(NULL AS DOUBLE) AS final_balance FROM rollout_pnl GROUP BY val_episode",
    "append_episode_batches": "SELECT CASE WHEN episode % 3 <> 0 THEN 'old' ELSE 'new' END AS batch, episode, step, num_trades, " + _r("realized_pnl") + ", CAST(NULL AS DOUBLE) AS green_up_pnl FROM episodes",
    "resume_from_commits": "SELECT run_id, (SELECT count(*) FROM episodes WHERE episode % 3 <> 0) + row_number() OVER (ORDER BY step * 10 + run_id) AS episode, step FROM episodes WHERE episode % 3 = 0",
    "read_report": "SELECT 'g' || CAST(g AS VARCHAR) || '.parquet' AS file, n AS n_rows, g <> 1 AS whole, CASE WHEN g = 1 THEN 'read_in_part' END AS reason FROM (SELECT market_id % 4 AS g, count(*) AS n FROM snapshots GROUP BY market_id % 4) t UNION ALL SELECT 'none.parquet', NULL, false, 'read_error'",
    "whole_snapshots": "SELECT 'g' || CAST(market_id % 4 AS VARCHAR) || '.parquet' AS file, market_id, step, " + _r("total_matched_market") + " FROM snapshots WHERE market_id % 4 <> 1",
    "inspect_unread_files": "SELECT file, is_suitable AND market_id % 6 <> 5 AS is_suitable, CASE WHEN market_id % 6 = 5 THEN 'read_error' ELSE reason END AS reason, split FROM files JOIN suitable USING (market_id) JOIN split USING (file)",
    "reason_histogram_of_all_files": "SELECT CASE WHEN market_id % 6 = 5 THEN 'read_error' ELSE reason END AS reason, count(*) AS markets FROM suitable WHERE NOT is_suitable OR market_id % 6 = 5 GROUP BY 1",
    "temporal_folds": "SELECT file, race_date, fold, split FROM folds",
    "fold_leaks": "SELECT t.fold AS train_fold, v.fold AS validation_fold, t.d AS last_train, v.d AS first_validation, coalesce(s.n, 0) AS shared_files, coalesce(t.d < v.d, true) AND coalesce(s.n, 0) = 0 AS no_leak FROM (SELECT fold, max(race_date) FILTER (WHERE split = 'train') AS d FROM folds WHERE fold IS NOT NULL GROUP BY fold) t CROSS JOIN (SELECT fold, min(race_date) FILTER (WHERE split = 'validation') AS d FROM folds WHERE fold IS NOT NULL GROUP BY fold) v LEFT JOIN (SELECT a.fold AS tf, b.fold AS vf, count(*) AS n FROM folds a JOIN folds b USING (file) WHERE a.split = 'train' AND b.split = 'validation' GROUP BY a.fold, b.fold) s ON s.tf = t.fold AND s.vf = v.fold",
    "rollout_quantile_sketches": "SELECT val_episode, n, " + ", ".join(_r(f"l[CAST(ceil({p} * n) AS BIGINT)]", c) for c, p in (("pnl_p10", 0.1), ("realized_pnl", 0.5), ("pnl_p90", 0.9))) + " FROM (SELECT val_episode, count(*) AS n, list_sort(list(pnl)) AS l FROM rollout_pnl GROUP BY val_episode) t",
    "size_ratio_sketches": "SELECT bucket, count(*) AS n, true AS within FROM (SELECT *, CASE WHEN back_price_1 >= 2 AND back_price_1 < 3 THEN 0 WHEN back_price_1 >= 3 AND back_price_1 < 5 THEN 1 WHEN back_price_1 >= 5 AND back_price_1 < 8 THEN 2 WHEN back_price_1 >= 8 AND back_price_1 < 13 THEN 3 WHEN back_price_1 >= 13 AND back_price_1 < 25 THEN 4 END AS bucket FROM quotes) t WHERE bucket IS NOT NULL AND back_size_1 > 0 AND lay_size_1 IS NOT NULL GROUP BY bucket",
    "metrics_union": "SELECT episode, num_trades, " + _r("realized_pnl") + " FROM episodes",
    "resume_offset": "SELECT run_id, coalesce(k.n, 0) + row_number() OVER (PARTITION BY run_id ORDER BY step) AS episode, step FROM episodes e LEFT JOIN (SELECT run_id, count(*) AS n FROM episodes WHERE episode % 3 <> 0 GROUP BY run_id) k USING (run_id) WHERE episode % 3 = 0",
    "quarantine_files": "SELECT 'broken-' || CAST(i AS VARCHAR) || '.parquet' AS file, 'read_error' AS reason FROM range((SELECT least(3, count(DISTINCT file)) FROM split WHERE split = 'undated')) r(i)",
    "to_float": f"SELECT o_orderkey, {_r(f'coalesce(CASE WHEN NOT isnan(TRY_CAST(t AS DOUBLE)) THEN TRY_CAST(t AS DOUBLE) END, -1.0)', 'v')} FROM (SELECT o_orderkey, {_TEXT} AS t FROM orders) o",
    "safe_normalize": f"SELECT {_KEY}, CASE WHEN ob_imbalance IS NOT NULL THEN {_unit('ob_imbalance', '(-1.0)', '1.0')} END AS imbalance0, {_unit('back_size_1', '20.0', '150.0')} AS size0 FROM quotes",
    "safe_log_norm": f"SELECT {_KEY}, {_r(_log('back_size_1'), 'size')}, {_r(_log('signal'), 'signal')} FROM quotes",
    "safe_price_norm": f"SELECT {_KEY}, {_r(_price('back_price_1'), 'back')}, {_r(_price('(signal + 1)'), 'low')} FROM quotes",
    "unpivot_runners": f"SELECT {_KEY}, {_rs('back_price_1, lay_size_3, microprice, prob_implied, has_level_1')} FROM quotes",
    "clean_quotes": f"SELECT {_KEY}, {_rs('back_price_2, lay_price_2, back_size_2, lay_size_2, last_traded_price, secs_since_last_trade')}, has_level_1, has_level_2 FROM clean",
    "derive_quotes": f"SELECT {_KEY}, {_rs('microprice, ob_imbalance, rel_spread, prob_implied')} FROM quoted",
    "valid_quotes": f"SELECT {_KEY}, {_rs('back_price_1, lay_price_1')} FROM quotes WHERE back_price_1 IS NOT NULL AND lay_price_1 IS NOT NULL",
    "base_features": f"SELECT {_KEY}, {_BASE_LIST} FROM quoted",
    "exit_prices": f"SELECT {_KEY}, {_r('lay_price_1', 'back_exit')}, {_r('back_price_1', 'lay_exit')}, {_r('microprice', 'micro_exit')} FROM quoted",
    "runner_close_pnl": f"SELECT {_KEY}, " + _r("CASE WHEN back_size_1 > 0.01 AND last_traded_price > 1.01 AND lay_price_1 > 1.01 THEN back_size_1 * (last_traded_price - lay_price_1) / lay_price_1 ELSE 0 END + CASE WHEN lay_size_1 > 0.01 AND microprice > 1.01 AND back_price_1 > 1.01 THEN lay_size_1 * (back_price_1 - microprice) / back_price_1 ELSE 0 END", "pnl") + " FROM quoted",
    "curriculum_schedule": f"SELECT o_orderkey, {_r('p', 'progress')}, {_r('0.05 + 4.95 * p', 'min_liability')}, {_r('0.5 + 1.5 * p', 'min_stake')}, {_r('0.01 + 0.29 * p', 'threshold')} FROM (SELECT o_orderkey, {_P} AS p FROM (SELECT o_orderkey, (o_orderkey * 37) % 600000 AS st FROM orders) a) b",
    "race_date": "SELECT file, race_date FROM dated",
    "global_features": "SELECT market_id, step, " + ", ".join(_r(e, n) for n, e in _GLOBAL.items()) + " FROM snapshots",
    "opening_board": f"SELECT market_id, runner_idx, {_rs('back_price_1, lay_price_1, last_traded_price')}, {_r('prob_implied * 100', 'implied_pct')} FROM quoted WHERE step = 0",
    "race_card": f"SELECT market_id, max(CASE WHEN step = 0 THEN file END) AS file, max(CASE WHEN step = 0 THEN runner_count END) AS runner_count, {_r('coalesce(max(CASE WHEN step = 0 THEN commission_rate END), 0.05) * 100', 'commission_pct')}, count(*) AS snapshots FROM snapshots GROUP BY market_id",
    "race_card_metadata": "SELECT market_id, nullif(string_split(max(CASE WHEN step = 0 THEN file END), '_')[2], '') AS venue, string_split(max(CASE WHEN step = 0 THEN file END), '_')[3] AS race_number, CASE WHEN market_id % 7 <> 0 THEN 'GB' END AS country_code, CAST(NULL AS VARCHAR) AS race_type, CAST(max(CASE WHEN step = 0 THEN runner_count END) AS INT) AS runner_count, CAST(len(string_split(max(CASE WHEN step = 0 THEN file END), '_')) >= 2 AS INT) + CAST(len(string_split(max(CASE WHEN step = 0 THEN file END), '_')) >= 3 AS INT) + CAST(market_id % 7 <> 0 AS INT) AS n_known, count(*) AS snapshots FROM snapshots GROUP BY market_id",
    "race_date_of_column": "SELECT file, CAST(make_timestamp(arg_min(ts_unix, step) * 1000) AS DATE) AS race_date FROM snapshots GROUP BY file",
    "temporal_split_of_column": "SELECT file, CASE WHEN race_date IS NULL THEN 'undated' WHEN race_date BETWEEN DATE '2025-10-01' AND DATE '2026-01-31' THEN 'train' WHEN race_date BETWEEN DATE '2026-02-01' AND DATE '2026-03-31' THEN 'validation' END AS split FROM (SELECT file, CAST(make_timestamp(arg_min(ts_unix, step) * 1000) AS DATE) AS race_date FROM snapshots GROUP BY file) t",
    "episode_outcome": "SELECT episode, CASE WHEN realized_pnl > 0 THEN 'WIN' WHEN realized_pnl < 0 THEN 'LOSS' ELSE 'FLAT' END AS outcome FROM episodes",
    "observation_stats": _STATS,
    "pre_race_rows": "SELECT market_id, step FROM snapshots WHERE in_play = 0",
    "off_step": "SELECT market_id, step, off_step, closing_step FROM live",
    "open_market_rows": "SELECT market_id, count(*) FILTER (WHERE market_status = 'OPEN') AS open_rows, count(*) FILTER (WHERE market_status <> 'OPEN') AS suspended FROM live GROUP BY market_id",
    "trade_admission": f"SELECT {_KEY}, reason, side, {_r('CASE WHEN reason = {0} THEN liability END'.format(chr(39) + 'accepted' + chr(39)), 'liability')}, {_r('CASE WHEN reason = {0} THEN stake END'.format(chr(39) + 'accepted' + chr(39)), 'stake')} FROM admitted",
    "violation_counts": "SELECT market_id, suspended, coalesce(stale, 0) AS stale, coalesce(volatile, 0) AS volatile, coalesce(back_depth, 0) + coalesce(lay_depth, 0) AS depth, coalesce(back_depth, 0) AS back_depth, coalesce(lay_depth, 0) AS lay_depth, coalesce(back_stake, 0) + coalesce(lay_stake, 0) AS stake_floor, coalesce(back_stake, 0) AS back_stake, coalesce(lay_stake, 0) AS lay_stake, " + _r("coalesce(stale, 0) * -0.02", "stale_penalty") + " FROM (SELECT market_id, count(*) FILTER (WHERE market_status <> 'OPEN') AS suspended FROM live GROUP BY market_id) s LEFT JOIN (SELECT market_id, count(*) FILTER (WHERE reason = 'stale') AS stale, count(*) FILTER (WHERE ret_std_5s > 0.05 AND reason NOT IN ('below_threshold', 'no_quote', 'no_level_1', 'stale')) AS volatile, count(*) FILTER (WHERE reason = 'depth' AND side = 'BACK') AS back_depth, count(*) FILTER (WHERE reason = 'depth' AND side = 'LAY') AS lay_depth, count(*) FILTER (WHERE reason = 'stake_floor' AND side = 'BACK') AS back_stake, count(*) FILTER (WHERE reason = 'stake_floor' AND side = 'LAY') AS lay_stake FROM admitted GROUP BY market_id) a USING (market_id)",
    "stride_sample": "SELECT market_id, step FROM pre WHERE nth % greatest(1, n_pre // 50) = 0",
    "min_rows_and_columns": "SELECT market_id, few_rows FROM checks",
    "whitelisted_races": "SELECT file FROM files JOIN suitable USING (market_id) WHERE is_suitable",
    "filtered_out_races": "SELECT file FROM files JOIN suitable USING (market_id) WHERE NOT is_suitable",
    "temporal_split": "SELECT file, split FROM split",
    "validation_order": "SELECT file, race_date, row_number() OVER (ORDER BY race_date, file) AS place FROM split WHERE split = 'validation'",
    "train_shuffle": "SELECT file, row_number() OVER (ORDER BY md5('42:' || file), file) AS place FROM split WHERE split = 'train'",
    "tail_split": "SELECT file, CASE WHEN row_number() OVER (ORDER BY md5('42:' || file) DESC, file DESC) <= 20 THEN 'validation' ELSE 'train' END AS split FROM files",
    "no_temporal_leak": "SELECT max(race_date) FILTER (WHERE split = 'train') AS last_train, min(race_date) FILTER (WHERE split = 'validation') AS first_validation, coalesce(max(race_date) FILTER (WHERE split = 'train') < min(race_date) FILTER (WHERE split = 'validation'), true) AS no_leak FROM split",
    "trade_quotes": f"SELECT {_KEY}, {_rs('signal, back_price_1, lay_price_1')} FROM quoted WHERE signal >= 0.5",
    "closing_quote": f"SELECT {_KEY}, {_rs('back_price_1, lay_price_1')} FROM closing",
    "rollout_grid": "SELECT market_id, CAST(rollout AS INT) AS rollout FROM files CROSS JOIN rollouts",
    "suitability": "SELECT market_id, is_suitable, reason FROM suitable",
    "reason_histogram": "SELECT reason, count(*) AS markets FROM suitable WHERE NOT is_suitable GROUP BY reason",
    "favourite": "SELECT m.market_id, favourite FROM (SELECT DISTINCT market_id FROM quotes) m LEFT JOIN fav USING (market_id)",
    "momentum_deltas": f"SELECT {_KEY}, {_rs('micro_delta_1, imbalance_delta, vol60_delta, spread_delta')} FROM features",
    "momentum_5": f"SELECT {_KEY}, {_r('micro_delta_5')}, {_r('greatest(-0.1, least(0.1, CASE WHEN m5 > 1.01 AND m > 1.01 THEN micro_delta_5 / 5.0 ELSE 0 END))', 'ret_mean_5')} FROM features",
    "session_vwap": f"SELECT {_KEY}, {_r('vwap_ratio')} FROM features",
    "price_percentile": f"SELECT {_KEY}, {_r('price_percentile')} FROM features",
    "favourite_gap": f"SELECT {_KEY}, {_r('favourite_delta')} FROM features",
    "runner_pool": "SELECT market_id, step, " + ", ".join(_r(f"coalesce({a}({f}) FILTER (WHERE act), 0)", f"{n}_{f}") for f in ("f_prob", "micro_delta_1", "price_percentile") for a, n in (("avg", "mean"), ("max", "max"))) + " FROM pool GROUP BY market_id, step",
    "position_age": f"SELECT {_KEY}, {_r('CASE WHEN abs(net_stake) > 0.01 THEN least(1.0, (step - first_open) / n_steps) ELSE 0.0 END', 'position_age')} FROM (SELECT s.*, min(s.step) OVER (PARTITION BY s.market_id, s.runner_idx) AS first_open, n.n_steps FROM simple s JOIN (SELECT market_id, n_steps FROM snapshots WHERE step = 0) n ON n.market_id = s.market_id) t",
    "rolling_sharpe": f"SELECT market_id, step, {_r('CASE WHEN n < 20 OR sd < 1e-8 THEN 0.0 ELSE greatest(-3.0, least(3.0, a / sd)) * 0.01 END', 'sharpe')} FROM (SELECT market_id, step, count(c) OVER w AS n, avg(c) OVER w AS a, stddev_pop(c) OVER w AS sd FROM (SELECT market_id, step, (value_c % 1000 - 480) / 100 AS c FROM snapshots) t WINDOW w AS (PARTITION BY market_id ORDER BY step ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) u",
    "drawdown": f"SELECT market_id, step, {_rs('balance, peak')}, {_r('CASE WHEN peak > 0 THEN (peak - balance) / peak * 100 ELSE 0 END', 'drawdown')} FROM (SELECT *, max(balance) OVER (PARTITION BY market_id ORDER BY step) AS peak FROM (SELECT market_id, step, 1000 + ((cum_value_c * 7) % 20000 - 10000) / 100 AS balance FROM snapshots) t) u",
    "no_trade_streak": f"SELECT run_id, episode, streak, {_r('CASE WHEN streak >= 3 THEN greatest(-2.0, -0.5 * (streak - 2)) ELSE 0.0 END', 'penalty')} FROM (SELECT run_id, episode, CAST(CASE WHEN num_trades > 0 THEN 0 ELSE sum(CASE WHEN num_trades > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, island ORDER BY episode) END AS BIGINT) AS streak FROM (SELECT *, sum(CASE WHEN num_trades > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY episode) AS island FROM episodes) a) b",
    "recent_trades": f"SELECT {_KEY}, {_r('least(10, count(*) OVER (PARTITION BY market_id ORDER BY step, runner_idx ROWS UNBOUNDED PRECEDING)) / 10', 'recent')} FROM trades",
    "step_index": f"SELECT market_id, event_id, step, n_steps, {_r('step / n_steps', 'progress')} FROM snapshots",
    "trade_log": f"SELECT {_KEY}, place, side, {_r('stake')} FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY step, runner_idx) AS place, row_number() OVER (PARTITION BY market_id ORDER BY step DESC, runner_idx DESC) AS last_place FROM trades) t WHERE place <= 10 OR last_place <= 10",
    "position_ledger": f"SELECT market_id, runner_idx, k, {_r('bs', 'back_stake')}, {_r('wb', 'back_price')}, {_r('ls', 'lay_stake')}, {_r('wl', 'lay_price')}, {_r('realised')} FROM l WHERE k > 0",
    "position_ledger_simple": f"SELECT market_id, runner_idx, step, k, {_rs('back_stake, back_price, lay_stake, lay_price, net_stake')} FROM simple",
    "market_exposure": f"SELECT market_id, {_r('sum(back_stake) + sum(CASE WHEN lay_price > 1 THEN lay_stake * (lay_price - 1) ELSE 0 END)', 'exposure')}, {_r('sum(net_stake)', 'net_exposure')}, count(*) AS n_positions FROM positions GROUP BY market_id",
    "position_concentration": f"SELECT market_id, {_r('coalesce(sum(CASE WHEN abs(net_stake) > 1e-6 THEN net_stake * net_stake END) / (sum(CASE WHEN abs(net_stake) > 1e-6 THEN abs(net_stake) END) * sum(CASE WHEN abs(net_stake) > 1e-6 THEN abs(net_stake) END)), 0)', 'concentration')} FROM positions GROUP BY market_id",
    "mark_positions": f"SELECT market_id, runner_idx, {_r('mtm')} FROM marked",
    "portfolio_mtm": f"SELECT market_id, {_r('sum(mtm)', 'portfolio_mtm')} FROM marked GROUP BY market_id",
    "green_up": f"SELECT market_id, {_r('sum(CASE WHEN mtm > 0 THEN mtm * (1 - rate) ELSE mtm END)', 'green_up')}, {_r('sum(CASE WHEN mtm > 0 THEN mtm * rate ELSE 0 END)', 'commission')} FROM marked JOIN rates USING (market_id) GROUP BY market_id",
    "book_payoffs": f"SELECT market_id, winner, {_r('payoff')} FROM payoffs",
    "worst_case_book": f"SELECT market_id, {_r('min(payoff)', 'worst_case')}, {_r('max(payoff)', 'best_case')}, {_r('max(payoff) - min(payoff)', 'book_spread')}, min(payoff) > 0 AS is_green FROM payoffs GROUP BY market_id",
    "rollout_quantiles": f"SELECT val_episode, count(*) AS n_rollouts, {_r('quantile_cont(pnl, 0.5)', 'realized_pnl')}, {_r('quantile_cont(pnl, 0.1)', 'pnl_p10')}, {_r('quantile_cont(pnl, 0.9)', 'pnl_p90')}, {_r('arg_max(pnl, rollout)', 'last_pnl')}, arg_max(num_trades, rollout) AS num_trades, {_r('arg_max(mid_race_pnl, rollout)', 'mid_race_pnl')} FROM rollout_pnl GROUP BY val_episode",
    "validation_summary": "SELECT count(*) AS episodes, " + ", ".join([_r("avg(realized_pnl)", "mean_pnl"), _r("quantile_cont(realized_pnl, 0.5)", "median_pnl"), _r("stddev_samp(realized_pnl)", "std_pnl"), _r("avg(CASE WHEN realized_pnl > 0 THEN 100.0 ELSE 0 END)", "win_rate"), _r("avg(CASE WHEN num_trades > 0 THEN 100.0 ELSE 0 END)", "trade_rate"), _r("sum(back_trades) / greatest(sum(back_trades) + sum(lay_trades), 1) * 100", "back_pct"), _r("sum(back_trades) / greatest(sum(lay_trades), 1)", "back_lay_ratio"), *(_r(f"avg({c})", f"mean_{c}") for c in ("num_trades", "commission_paid", "back_exposure", "lay_exposure", "depth_violations", "suspended_violations", "pnl_p10", "pnl_p90", "mid_race_pnl"))]) + " FROM episodes JOIN (SELECT val_episode AS episode, quantile_cont(pnl, 0.1) AS pnl_p10, quantile_cont(pnl, 0.9) AS pnl_p90, arg_max(mid_race_pnl, rollout) AS mid_race_pnl FROM rollout_pnl GROUP BY val_episode) o USING (episode)",
    "training_block_summary": "SELECT (episode - 1) // 10 AS block, count(*) AS episodes, " + ", ".join([_r("avg(CASE WHEN num_trades > 0 THEN 100.0 ELSE 0 END)", "trade_rate"), _r("sum(back_trades) / greatest(sum(back_trades) + sum(lay_trades), 1) * 100", "back_pct"), *(_r(f"avg({c.strip()})", f"avg_{c.strip()}") for c in _MEANS.split(",")), _r("avg(back_trades) / greatest(avg(lay_trades), 0.01)", "back_lay_ratio")]) + " FROM episodes GROUP BY (episode - 1) // 10 HAVING count(*) = 10",
    "lay_share_by_band": "SELECT CAST(coalesce(band, -1) AS INT) AS band, CAST(sum(back_trades) AS BIGINT) AS back_trades, CAST(sum(lay_trades) AS BIGINT) AS lay_trades, " + ", ".join([_r("sum(back_exposure)", "back_exposure"), _r("sum(lay_exposure)", "lay_exposure"), _r("coalesce(sum(lay_trades) * 100.0 / nullif(sum(back_trades) + sum(lay_trades), 0), 0)", "lay_pct"), _r("sum(lay_exposure) / nullif(sum(back_exposure), 0)", "exposure_ratio")]) + " FROM (SELECT *, CASE WHEN episode <= 200 THEN 0 WHEN episode <= 600 THEN 1 WHEN episode <= 1200 THEN 2 WHEN episode <= 2000 THEN 3 ELSE 4 END AS band FROM episodes) t GROUP BY ROLLUP (band)",
    "size_ratio_by_price": f"SELECT bucket, {_r('quantile_cont(lay_size_1 / back_size_1, 0.5)', 'median_ratio')}, count(*) AS n FROM (SELECT *, CASE WHEN back_price_1 >= 2 AND back_price_1 < 3 THEN 0 WHEN back_price_1 >= 3 AND back_price_1 < 5 THEN 1 WHEN back_price_1 >= 5 AND back_price_1 < 8 THEN 2 WHEN back_price_1 >= 8 AND back_price_1 < 13 THEN 3 WHEN back_price_1 >= 13 AND back_price_1 < 25 THEN 4 END AS bucket FROM quotes) t WHERE bucket IS NOT NULL AND back_size_1 > 0 AND lay_size_1 IS NOT NULL GROUP BY bucket",
    "inspect_and_split": "SELECT file, is_suitable, reason, split FROM files JOIN suitable USING (market_id) JOIN split USING (file)",
}
_BODIES["safe_normalize"] = f"SELECT {_KEY}, {_r('imbalance0', 'imbalance')}, {_r('size0', 'size')}, CAST(CASE WHEN size0 IS NOT NULL THEN 0.5 END AS DOUBLE) AS flat FROM ({_BODIES['safe_normalize']}) t"
_DELTAS = ["micro_delta_1", "micro_delta_5", "imbalance_delta", "vol60_delta", "CASE WHEN m5 > 1.01 AND f.m > 1.01 THEN greatest(-0.1, least(0.1, micro_delta_5 / 5.0)) ELSE 0 END", "spread_delta", "vwap_ratio", "price_percentile", "favourite_delta"]
_SINGLE = lambda e: f"CAST(CAST({e} AS FLOAT) AS DOUBLE)"
_BODIES["build_observation"] = (
    "SELECT market_id, step, 999 AS places, " + ", ".join([_r(_SINGLE("coalesce(b0, 0)"), "first", 4), _r(_SINGLE("coalesce(m0, 0)"), "micro", 4), _r("1.0", "balance", 4), _r(_SINGLE(_GLOBAL["g_secs_to_off"]), "secs", 4), _r("coalesce(total, 0) + 2.0 + " + " + ".join(_SINGLE(e) for e in _GLOBAL.values()), "total", 2)])
    + " FROM snapshots s LEFT JOIN (SELECT market_id, step, max(CASE WHEN q.runner_idx = 0 THEN " + _BASE["f_back_price_1"] + " END) AS b0, max(CASE WHEN q.runner_idx = 0 THEN " + _BASE["f_microprice"].replace("microprice", "q.microprice") + " END) AS m0, sum("
    + " + ".join(_SINGLE(e) for e in _BASE.values()).replace(" ob_imbalance", " q.ob_imbalance") + " + " + " + ".join(_SINGLE(e) for e in _DELTAS) + ") AS total FROM quoted q JOIN (SELECT * EXCLUDE (traded_vol_total, prob_implied) FROM features) f USING (market_id, step, runner_idx) GROUP BY market_id, step) o USING (market_id, step)"
)
_BODIES["normalise_observation"] = (
    f"SELECT {_KEY}, " + ", ".join(_r(_SINGLE(f"greatest(-10.0, least(10.0, (x{i} - a{i}) / sqrt(s{i} + 1e-8)))"), f"v{i}", 4) for i in range(len(_VECTOR)))
    + f" FROM (SELECT {_KEY}, " + ", ".join(f"{_BASE[n]} AS x{i}" for i, n in enumerate(_VECTOR)) + " FROM quoted) x CROSS JOIN (SELECT " + ", ".join(f"avg({_BASE[n]}) AS a{i}, var_pop({_BASE[n]}) AS s{i}" for i, n in enumerate(_VECTOR)) + " FROM quoted WHERE market_id IN (SELECT market_id FROM snapshots JOIN split USING (file) WHERE split = 'train')) y"
)
for _check in ("pre_race_secs", "liquidity_at_off", "fav_spread", "fav_drift", "ob_imbalance", "prob_null_rate"):
    _BODIES[f"chk_{_check}"] = f"SELECT market_id, {_r(_check, 'value')} FROM checks"
for _check in ("pre_race_snapshots", "result_closed", "winner_valid"):
    _BODIES[f"chk_{_check}"] = f"SELECT market_id, {_check} AS value FROM checks"

_SLOT = [*_BASE.values(), "0", "0", *_DELTAS[:-1], "0", _DELTAS[-1]]
_WORLD = ["1", "0", "1", "0", _GLOBAL["g_progress"], "0", "0", _GLOBAL["g_runner_count"], "0", "0", "0", _GLOBAL["g_secs_to_off"], _GLOBAL["g_total_matched"], _GLOBAL["g_prob_entropy"], "0"]
_Z = lambda x: _SINGLE(f"greatest(-10.0, least(10.0, ({x} - mean) / sqrt(variance + 1e-8)))")
_OF_PLACES = "SELECT p.feature, n, coalesce(sum(x), 0) / n AS mean, greatest(0, coalesce(sum(x * x), 0) / n - (coalesce(sum(x), 0) / n) * (coalesce(sum(x), 0) / n)) AS variance FROM (SELECT range AS feature FROM range(999)) p CROSS JOIN (SELECT count(*) AS n FROM snapshots{where}) c LEFT JOIN (SELECT feature, x FROM obs_values{where}) o ON o.feature = p.feature GROUP BY p.feature, n"
_TABLES |= {
    "obs_slots": "SELECT q.market_id, q.step, q.runner_idx, [" + ", ".join(_SINGLE(e) for e in _SLOT) + "] AS vs FROM quoted q JOIN (SELECT market_id, step, runner_idx, m, m5, micro_delta_1, micro_delta_5, imbalance_delta, vol60_delta, spread_delta, vwap_ratio, price_percentile, favourite_delta FROM features) f ON f.market_id = q.market_id AND f.step = q.step AND f.runner_idx = q.runner_idx",
    "obs_values": "SELECT market_id, step, runner_idx * 41 + unnest(range(41)) AS feature, unnest(vs) AS x FROM obs_slots UNION ALL SELECT market_id, step, 984 + unnest(range(15)) AS feature, unnest([" + ", ".join(_SINGLE(e) for e in _WORLD) + "]) AS x FROM snapshots",
    "obs_train": _OF_PLACES.format(where=" WHERE market_id IN (SELECT market_id FROM snapshots JOIN split USING (file) WHERE split = 'train')"),
}
_BODIES["observation_stats_wide"] = f"SELECT feature, n, {_r('mean')}, {_r('variance')} FROM ({_OF_PLACES.format(where='')}) t"
_BODIES["normalise_observation_wide"] = (
    "SELECT market_id, step, 999 AS places, " + ", ".join(_r(f"coalesce(max(CASE WHEN feature = {i} THEN zx END), (SELECT {_Z(0)} FROM obs_train WHERE feature = {i}))", n, 4) for i, n in ((0, "first"), (12, "micro"), (995, "secs")))
    + f", {_r(f'(SELECT sum({_Z(0)}) FROM obs_train) + sum(zx - z0)', 'total', 2)} FROM (SELECT v.market_id, v.step, v.feature, {_Z('x')} AS zx, {_Z(0)} AS z0 FROM obs_values v JOIN obs_train t ON t.feature = v.feature) u GROUP BY market_id, step"
)
_AGE = "CASE WHEN abs(net) > 0.01 AND first_open IS NOT NULL AND n_trades > 0 THEN least(1.0, greatest(0.0, (step - first_open) / n_steps)) ELSE 0.0 END"
_BODIES |= {
    "mark_positions_by_step": f"SELECT {_KEY}, {_r('bs', 'back_stake')}, {_r('ls', 'lay_stake')}, {_r('net', 'net_stake')}, n_trades, {_r('mtm')} FROM as_of WHERE n_trades > 0",
    "market_exposure_by_step": f"SELECT market_id, step, {_rs('exposure, net_exposure')}, n_positions FROM asof_steps",
    "position_concentration_by_step": f"SELECT market_id, step, {_r('concentration')} FROM asof_steps",
    "portfolio_mtm_by_step": f"SELECT market_id, step, {_rs('portfolio_mtm, balance')}, {_r('paid', 'commission')} FROM asof_steps",
    "green_up_by_step": f"SELECT market_id, step, {_r('green_up')}, {_r('closing', 'commission')} FROM asof_steps",
    "position_age_by_step": f"SELECT {_KEY}, {_r(_AGE, 'position_age')} FROM as_of",
    "recent_trades_by_step": f"SELECT market_id, step, {_r('recent / 10', 'recent')} FROM asof_steps",
}
_HELD = [*_BASE.values(), "net / 1000", "mtm / 1000", *_DELTAS[:-1], _AGE.replace("step -", "q.step -"), _DELTAS[-1]]
_HELD_WORLD = [
    "balance / 1000", "exposure / 1000", "greatest(0, balance - exposure) / 1000", "n_positions / 24", _GLOBAL["g_progress"].replace("step", "s.step", 1), "paid / 1000", "recent / 10", _GLOBAL["g_runner_count"], "net_exposure / 1000", "concentration", "portfolio_mtm / 1000",
    _GLOBAL["g_secs_to_off"], _GLOBAL["g_total_matched"], _GLOBAL["g_prob_entropy"], "green_up / 1000",
]
_BODIES["build_observation_with_positions"] = (
    "SELECT q.market_id, q.step, q.runner_idx AS slot, " + ", ".join(_r(_SINGLE(e), f"v{i}", 4) for i, e in enumerate(_HELD))
    + " FROM quoted q JOIN (SELECT market_id, step, runner_idx, m, m5, micro_delta_1, micro_delta_5, imbalance_delta, vol60_delta, spread_delta, vwap_ratio, price_percentile, favourite_delta FROM features) f ON f.market_id = q.market_id AND f.step = q.step AND f.runner_idx = q.runner_idx"
    + " JOIN (SELECT market_id, step, runner_idx, net, mtm, first_open, n_trades, n_steps FROM as_of_before) h ON h.market_id = q.market_id AND h.step = q.step AND h.runner_idx = q.runner_idx"
    + " UNION ALL SELECT s.market_id, s.step, 24 AS slot, " + ", ".join([*(_r(_SINGLE(e), f"v{i}", 4) for i, e in enumerate(_HELD_WORLD)), *(f"CAST(NULL AS DOUBLE) AS v{i}" for i in range(15, 41))])
    + " FROM snapshots s JOIN before_steps b ON b.market_id = s.market_id AND b.step = s.step"
)


def _words(text: str) -> set[str]:
    return set("".join(c if c.isalnum() or c == "_" else " " for c in text).split())


def _with(name: str, body: str) -> str:
    """The body after the tables that it needs."""
    needed, netted = _words(body), {}
    for table in reversed(_NETTED):
        if table in needed:
            needed |= _words(_NETTED[table])
            netted = {table: _NETTED[table]} | netted
    folded = bool(netted) or name == "position_ledger"
    needed |= {"tr"} if folded else set()
    for table in reversed(_TABLES):
        if table in needed:
            needed |= _words(_TABLES[table]) - {table}
    parts = [f"{t} AS MATERIALIZED ({sql})" for t, sql in _TABLES.items() if t in needed]
    if folded:
        return f"WITH RECURSIVE {', '.join([*parts, _LEDGER, *(f'{t} AS MATERIALIZED ({sql})' for t, sql in netted.items())])} {body}"
    return f"WITH {', '.join(parts)} {body}" if parts else body


ORACLES: dict[str, str] = {name: _with(name, body) for name, body in _BODIES.items()}
