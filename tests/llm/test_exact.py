from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from oddsbook.llm import exact
from tests.llm.helpers import clashing, documents, none


def weak(text):
    """A digest of four bits, so that unlike texts collide."""
    return F.substring(F.sha2(text, 256), 1, 1).cast("binary")


def classes(rows):
    """(doc_id, keep_id, group_size, digest) as often as they occur, by plain grouping of whole texts."""
    held = defaultdict(list)
    for i, t in rows:
        held[t or ""].append(i)
    least = lambda ids: max((i for i in ids if i is not None), default=None)
    return sorted(repr((i, least(held[t or ""]), len(held[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())) for i, t in rows)


def found(spark, docs, path, **how):
    docs.write.mode("append").parquet(path)
    return exact.exact_dedup(spark, path, **how)


@pytest.mark.parametrize("digest", [exact.sha256, weak], ids=["sha256", "weak"])
@pytest.mark.parametrize("batch_bytes", [None, 2000])
def test_exact(spark, tmp_path, digest, batch_bytes):
    """Nulls, empty and long texts, repeated rows and clashing names; small batches go through the state one after the other."""
    docs = clashing(documents(spark)).repartition(5)
    rows = docs.select("doc_id", "text").collect()
    got = found(spark, docs, str(tmp_path / "d"), digest=digest, batch_bytes=batch_bytes).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == classes(rows)
    kept = defaultdict(list)
    for r in got:
        kept[r.text_sha256].append(r)
    for own in kept.values():
        assert [r.doc_id for r in own if r.kept] == [own[0].keep_id]  # one row stays, also of rows that share the largest doc_id


def test_a_later_call_goes_on_from_the_state(spark, tmp_path):
    """The second call's stream reads the new files only, and the keeper moves to a larger doc_id."""
    path, state = str(tmp_path / "d"), str(tmp_path / "state")
    first = [(1, "a"), (2, "b"), (5, "b")]
    new = [(9, "a"), (3, "b"), (4, "c"), (None, "c")]
    schema = "doc_id long, text string"
    assert found(spark, spark.createDataFrame(first, schema), path, checkpoint=state).where("kept").count() == 2
    got = found(spark, spark.createDataFrame(new, schema), path, checkpoint=state).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == classes(first + new)
    seen = exact.retained(spark, path, state).collect()
    assert sorted((r.keep.doc_id, r.n) for r in seen) == [(4, 2), (5, 3), (9, 2)]


def test_exact_of_nothing(spark, tmp_path):
    got = found(spark, none(documents(spark)), str(tmp_path / "d"))
    assert got.count() == 0 and got.columns[:5] == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_exact_of_one_file(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([(1, "x"), (2, "x")], "doc_id long, text string").coalesce(1).write.parquet(path)
    (file,) = (tmp_path / "d").glob("part-*")
    assert sorted(tuple(r)[:4] for r in exact.exact_dedup(spark, str(file)).collect()) == [(1, 2, 2, False), (2, 2, 2, True)]


def test_exact_runs_no_python_and_leaves_settings(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    got = found(spark, documents(spark), str(tmp_path / "d"))
    plan = got._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
    assert spark.conf.get(key, None) == before
