from __future__ import annotations

import duckdb
import pytest

from oddsbook import oracle, queries

SF = "/root/testdata/sf0.001"
#: Path-dependent jobs, held against a second replay in test_books.py.
WITHOUT_SQL = {"backtest", "step_pnl", "episode_summary"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return v if not isinstance(v, float) else round(v, 9)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    if name in WITHOUT_SQL:
        assert got
        return
    found = duck.execute(oracle.ORACLES[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == names
    assert got == sorted(repr([plain(r[at.index(c)]) for c in names]) for r in found.fetchall())
