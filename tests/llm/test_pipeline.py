from __future__ import annotations

import random
from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from tests.llm.helpers import DOCS, PASSAGE, clashing, documents, groups, none
from tests.llm.test_operators import contamination_brute, line_brute, simhash_brute

GOOD = ["river", "stone", "walks", "slowly", "over", "the", "green", "hill", "and", "under", "quiet", "trees"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good and bad labelled texts, near copies, shared lines, benchmark passages and awkward rows."""
    rng, path = random.Random(7), tmp_path_factory.mktemp("sf")
    text = lambda: " ".join(rng.choices(GOOD, k=rng.randint(40, 90))) + "."
    bad = lambda: " ".join(w + rng.choice(["!!", "$$$"]) for w in text().upper().split())
    rows = [(i, bad() if i % 4 == 0 else text()) for i in range(100, 400)]
    rows += [(500 + i, rows[1][1]) for i in range(5)] + [(510 + i, text() + "\nthis very line is in every one of them\n" + text()) for i in range(6)]
    rows += [(520, text() + " " + PASSAGE[:120] + " " + text()), (521, " ".join([text()] * 30) + " " + PASSAGE[:70])]
    docs = documents(spark).where("doc_id IS NOT NULL").unionByName(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS))
    docs.write.parquet(str(path / "documents.parquet"))
    labels = [(i, int(i % 4 != 0), 0) for i, _ in rows if i < 400] + [(i, 1, 0) for i in range(16)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages(spark, folder, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(i))
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
        rows = docs.collect()
        own = [(r.doc_id, r.text) for r in before]
        if name == "quality":
            kept = {r.doc_id for r in rows}
            assert sum((i in kept) == (i % 4 != 0) for i in range(100, 400)) >= 297 and {*range(510, 516), 520, 521} <= kept
            assert not Counter(map(tuple, rows)) - Counter(map(tuple, before))
        elif name == "line_dedup":
            assert Counter((r.doc_id, r.text) for r in rows) == Counter(k[:2] for k in line_brute(own).elements())
        elif name == "simhash":
            prints = {r.doc_id: simhash_brute(r.text) for r in before}
            near = groups([(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2], list(prints))
            assert Counter(map(tuple, rows)) == Counter(tuple(r) for r in before if near[r.doc_id] == r.doc_id)
        elif name == "decontaminate":
            hit = {k[0] for k in contamination_brute(own, [(1, PASSAGE)], 13) if k[2] and 20 * len(k[2]) >= k[1]}
            assert 520 in hit and 521 not in hit
            assert Counter(map(tuple, rows)) == Counter(tuple(r) for r in before if r.doc_id not in hit)
        else:
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            assert {r.doc_id: r.ids for r in rows} == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in own}
            continue
        assert docs.columns == columns and rows
        before = rows


def test_stages_take_null_ids_and_clashing_columns(spark, folder):
    """Each stage by itself on rows with null ids, repeated rows and columns of other tables' names."""
    docs = clashing(documents(spark))
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns
        kept = got.collect()
        own = {(r.doc_id, r.text or "") for r in rows}
        assert all((r.doc_id, r.text or "") in own for r in kept) or name == "line_dedup"
        assert all(r[f"{c}"] == f"own {c}" for r in kept for c in docs.columns[5:])
        if name == "line_dedup":
            assert Counter((r.doc_id, r.text) for r in kept) == Counter(k[:2] for k in line_brute([(r.doc_id, r.text) for r in rows]).elements())
        elif name == "simhash":
            least = {}
            for r in rows:
                p = simhash_brute(r.text)
                least[p] = min((x for x in (least.get(p), r.doc_id) if x is not None), default=None)
            assert Counter(r.doc_id for r in kept) == Counter(r.doc_id for r in rows if r.doc_id in set(least.values()))
        elif name == "decontaminate":
            bad = {k[0] for k in contamination_brute([(r.doc_id, r.text) for r in rows], [(1, PASSAGE)], 13) if k[2] and 20 * len(k[2]) >= k[1]}
            assert None in bad and Counter(r.doc_id for r in kept) == Counter(r.doc_id for r in rows if r.doc_id not in bad)
    assert corpus_pipeline.encode(spark, docs, folder).count() == len(rows)


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 100
    for name in ("documents", "labels", "benchmark"):
        none(spark.read.parquet(f"{folder}/{name}.parquet")).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
