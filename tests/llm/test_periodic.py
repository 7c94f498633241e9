from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oddsbook.llm import periodic
from oddsbook.llm import queries as corpus_queries
from tests.llm.helpers import clashing, documents, none


def brute(t):
    """(start, length, period) of the runs, by comparing all pairs of places."""
    found = {}
    for p in range(1, len(t) // 4 + 1):
        i, end = 0, len(t) - p
        while i < end:
            j = i
            while j < end and t[j] == t[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                found.setdefault((i, j - i + p), p)  # the smallest period of the stretch comes first
            i = j + 1
    return sorted(((a, n, p) for (a, n), p in found.items()), key=lambda r: (r[0], r[2]))


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def collapsed(words, runs):
    again = {i for a, n, p in runs for i in range(a + p, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in again)


def by_text(texts):
    got = periodic.runs_of([np.array(t, np.int64) for t in texts])
    return [[tuple(r[1:]) for r in got.tolist() if r[0] == i] for i in range(len(texts))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=6))
def test_runs_of_few_words(texts):
    assert by_text(texts) == [brute(t) for t in texts]


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_repeated_stretches(monkeypatch, seed):
    """Periods planted into longer texts, nested ones too; queries are answered in many stretches."""
    monkeypatch.setattr(periodic, "QUERIES", 500)
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        t = [rng.randrange(rng.choice([2, 5, 400])) for _ in range(rng.choice([0, 5, 6, 8, 90, 500]))]
        for _ in range(rng.randrange(4)):
            if len(t) > 8:
                a, p = rng.randrange(len(t)), rng.randint(1, len(t) // 4)
                for i in range(a, rng.randint(a, len(t))):
                    t[i] = t[a + (i - a) % p]
        texts.append(t)
    assert by_text(texts) == [brute(t) for t in texts]


def test_extensions_against_plain_comparison():
    rng = np.random.default_rng(4)
    for n, k in ((1, 2), (40, 1), (300, 2), (700, 1), (700, 40)):
        w = np.r_[np.tile(rng.integers(0, k, n), 3), -1]
        ext = periodic.Extensions(w)
        i, j = rng.integers(0, len(w), (2, 400))
        i, j = i[i != j], j[i != j]
        plain = [next(m for m in range(len(w)) if max(a, b) + m >= len(w) or w[a + m] != w[b + m]) for a, b in zip(i, j, strict=True)]
        assert ext.reach(i, j).tolist() == plain


def test_cover_has_each_difference_once():
    found = sorted((int(b) - int(a)) % periodic.STEP for a in periodic.COVER for b in periodic.COVER if a != b)
    assert found == list(range(1, periodic.STEP))


@pytest.mark.parametrize("names", ["plain", "clashing"])
def test_periodic_documents(spark, monkeypatch, names):
    monkeypatch.setattr(periodic, "WORDS", 200)
    docs = documents(spark) if names == "plain" else clashing(documents(spark))
    got = sorted(repr((r.doc_id, [tuple(x) for x in r.runs], r.collapsed)) for r in periodic.periodic_runs(docs).collect())
    want = []
    for r in docs.select("doc_id", "text").collect():
        words = words_of(r.text)
        runs = brute(words) if len(words) < 1000 else [(0, 18000, 6)]  # the long one is six words again and again
        want.append(repr((r.doc_id, runs, collapsed(words, runs))))
    assert got == sorted(want)
    assert periodic.periodic_runs(none(docs)).count() == 0


def test_long_texts_take_time_in_proportion():
    """A word again and again, a long period, and prose-like words, 300,000 each."""
    n = 300_000
    for t in (np.zeros(n, np.int64), np.arange(n) % 7000, np.random.default_rng(1).zipf(1.3, n)):
        began = time.perf_counter()
        periodic.runs_of([t])
        assert time.perf_counter() - began < 30


def test_periodic_query_follows_the_contract(spark, tmp_path):
    """Plants of the contract, digests and the longest run, on ids with and without a plant."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 60))) + rng.choice(["", "\n\tx x x x x x x y"])) for i in range(150)] + [(-3, "a b c"), (None, "z z z z z z z"), (200, None)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in corpus_queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        w = words_of(text)
        n, h = len(w), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs, r = brute(w), got[i]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
