from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict
from functools import partial

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from oddsbook.llm import bpe, components, decontaminate, embeddings, licenses, lines, quality, simhash, substrings, tokencounts, tokenids
from oddsbook.llm import queries as corpus_queries
from oddsbook.llm.common import work_path
from tests.llm.helpers import PASSAGE, clashing, documents, groups, none


@pytest.fixture(params=["plain", "clashing"])
def docs(spark, request):
    d = documents(spark)
    return d if request.param == "plain" else clashing(d)


def multiset(rows):
    return Counter(tuple(r) for r in rows)


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# 2


def line_brute(rows, min_docs=3, min_chars=20):
    key = lambda line: ascii_lower(line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k].append(-math.inf if i is None else i)
    common = {k: max(v) for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        own = -math.inf if i is None else i
        kept = [x for x in ls if common.get(key(x), own) == own]
        out.append((i, "\n".join(kept), len(ls), len(ls) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize("batches", [1, 4])
def test_line_dedup(docs, batches):
    got = lines.line_dedup(docs, batches=batches).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert multiset(got) == line_brute([(r.doc_id, r.text) for r in docs.collect()])
    same = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    assert multiset(lines.line_dedup(docs, batches=batches).select(same).collect()) == multiset(docs.select(same).collect())


def test_line_dedup_compacts(spark):
    rng = random.Random(3)
    pool = [f"a line of the pool with number {i:03d}" for i in range(60)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 6)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.line_dedup(docs, batches=7, fanout=2).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert multiset(got) == line_brute(rows)
    assert lines.line_dedup(none(docs)).count() == 0


def test_long_texts_take_time_in_proportion_to_their_lines(spark):
    """Three texts of 100,000 lines share one line; nothing of the runs is left behind."""
    shared = "a line that all three of the texts have"
    texts = ["\n".join([shared, *(f"line {i} of the text with number {k}" for i in range(100_000))]) for k in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tables = spark.sql("SHOW TABLES").count()
    lines.line_dedup(docs.limit(0)).count()
    began = time.perf_counter()
    got = {r.doc_id: r for r in lines.line_dedup(docs).collect()}
    assert time.perf_counter() - began < 40
    assert [(got[k].n_lines, got[k].n_dropped) for k in range(3)] == [(100_001, 1), (100_001, 1), (100_001, 0)]
    assert [got[k].text for k in range(3)] == [texts[0].partition("\n")[2], texts[1].partition("\n")[2], texts[2]]
    assert spark.sql("SHOW TABLES").count() == tables


def test_line_store_is_opened_extended_and_compacted(spark):
    """Many calls, each with its own session's view of the store; their keys and keepers against plain counts."""
    rng = random.Random(4)
    pool = [f"a line of the pool with number {i:03d}" for i in range(80)]
    path, seen = work_path(spark, "line-store"), []
    lines.LineRuns(spark, path, 3, 2, 5)._list()
    for _ in range(5):
        rows = [(rng.randrange(10_000), "\n".join(rng.choices(pool, k=rng.randint(0, 4)))) for _ in range(25)]
        seen += rows
        store = lines.LineRuns.open(spark, path)
        got = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), batches=2, store=store).select("doc_id", "text", "n_lines", "n_dropped").collect()
        held = defaultdict(list)
        for i, t in seen:
            for k in set(t.split("\n")):
                held[k].append(i)
        common = {k: max(v) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
        assert multiset((r.doc_id, r.text) for r in got) == Counter((i, "\n".join(x for x in t.split("\n") if common.get(x, i) == i)) for i, t in rows)
        assert all(len(level) < 2 for level in store.levels)
    assert len(store.levels) > 3 and len(store.runs()) == sum(map(len, store.levels))


def test_batches_merge_join_the_runs_in_their_order(spark):
    """Runs are read without an exchange or a sort: only the batch is dealt out and sorted."""
    counts = spark.range(1000).selectExpr("xxhash64(id) AS h1", "id AS h2", "id % 5 AS n_docs", "id AS keeper")
    store = lines.LineRuns(spark, work_path(spark, "line-store"), buckets=4)
    store.add(counts)
    store.add(counts.where("h2 % 7 = 0"))
    plan = store.fresh(counts)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange ") == 1 and plan.count("Sort [") == 1 and "Broadcast" not in plan
    assert store.fresh(counts).count() == counts.where("n_docs < 3").count()


# 5


def simhash_brute(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t or ""))
    sh = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs):
    rows = docs.collect()
    prints = [simhash_brute(r.text) for r in rows]
    ids = [r.doc_id for r in rows]
    near = groups([(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 2], set(prints))
    first = {}
    for i, p in zip(ids, prints, strict=True):
        if i is not None:
            first[near[p]] = min(i, first.get(near[p], i))
    got = simhash.simhash_groups(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert multiset(got) == Counter((i, f"{p:016x}", first.get(near[p])) for i, p in zip(ids, prints, strict=True))
    assert simhash.simhash_groups(none(docs)).count() == 0


def test_balls_lose_no_link(spark):
    rng = random.Random(5)
    prints = [0, -1]
    for _ in range(60):
        x = rng.getrandbits(64)
        prints += [x] + [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(rng.randint(0, 3))]
    signed = [struct.unpack("<q", struct.pack("<Q", p % (1 << 64)))[0] for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = [(r.a, r.b) for r in simhash.near_links(df).collect()]
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 2 for a, b in links)
    brute = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if a != b and ((a ^ b) % (1 << 64)).bit_count() <= 2]
    assert groups(links, set(signed)) == groups(brute, set(signed))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: c for n, c in groups(edges, {n for e in edges for n in e}).items() if n in nodes}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 4


def substring_brute(rows, length):
    split = [(i, (t or "").split(" ") if False else re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, ws in split:
        for s in range(len(ws) - length + 1):
            if i is not None:
                g = tuple(ws[s : s + length])
                first[g] = min(i, first.get(g, i))
    out = []
    for i, ws in split:
        gone = set()
        for s in range(len(ws) - length + 1):
            if i is not None and first[tuple(ws[s : s + length])] < i:
                gone |= set(range(s, s + length))
        out.append((i, len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone)))
    return Counter(out)


@pytest.mark.parametrize("length", [5, 50])
def test_substrings(docs, length):
    got = substrings.substring_dedup(docs, length).select("doc_id", "n_words", "n_removed", "text").collect()
    assert multiset(got) == substring_brute([(r.doc_id, r.text) for r in docs.collect()], length)


@pytest.mark.parametrize("most", [1, 300, 20_000])
def test_substrings_of_hot_passages(spark, monkeypatch, most):
    """However many words a shard may have: all anchors split, some, and none."""
    monkeypatch.setattr(substrings, "repeated_windows", partial(substrings.repeated_windows, shard_words=most))
    rng = random.Random(2)
    pool = [[f"p{i}x{j}" for j in range(rng.randint(20, 40))] for i in range(6)]
    rows = []
    for i in range(80):
        ws = [f"u{i}x{j}" for j in range(rng.randint(0, 20))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(pool)
            at = rng.randrange(10)
            ws += p[at:] + [f"v{i}x{rng.randrange(9)}" for _ in range(rng.randint(0, 5))]
        rows.append((i, " ".join(ws)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substrings.substring_dedup(docs, 15).select("doc_id", "n_words", "n_removed", "text").collect()
    assert multiset(got) == substring_brute(rows, 15)
    assert substrings.substring_dedup(none(docs)).count() == 0


def test_shards_are_bounded_by_words(spark):
    """A passage in 2,600 documents, each with other long texts around it, and periodic texts of all lengths."""
    rng = random.Random(3)
    passage = " ".join(f"p{j}" for j in range(70))
    around = lambda: " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))
    rows = [(i, f"{around()} {passage} {around()}") for i in range(2600)]
    rows += [(5000 + i, "to and fro " * (400 + 40 * i)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = substrings._segments(substrings._rows(docs), 50)
    _, different = substrings.shards(found, 50, substrings.SHARD_WORDS)
    words = {(r.anchor, r.split): r.w for r in different.groupBy("anchor", "split").agg(F.sum(F.col("n") + 49).alias("w")).collect()}
    assert any(split for _, split in words) and all(w <= substrings.SHARD_WORDS for (_, split), w in words.items() if not split)
    assert found.agg(F.max("n")).first()[0] <= substrings.SEGMENT_WINDOWS
    got = substrings.substring_dedup(docs).select("doc_id", "n_words", "n_removed", "text").collect()
    assert multiset(got) == substring_brute(rows, 50)


def test_split_segments_give_no_row_for_each_window(spark, monkeypatch):
    """One phrase over and over in every document, and a passage with other words around it: split segments are cut by longer shingles, and the rows
    of every level are fewer than the windows by far. Again where only whole windows are left to compare."""
    rng, made, write = random.Random(9), [], substrings.written
    monkeypatch.setattr(substrings, "written", lambda df, name: made.append((name, kept := write(df, name))) or kept)
    passage = " ".join(f"p{j}" for j in range(70))
    around = lambda: " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 60)))
    rows = [(i, f"{around()} {'to and fro ' * rng.randint(100, 130)} {around()} {passage} {around()}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for most in (5_000, 60):
        made.clear()
        spans = substrings.repeated_windows(substrings._rows(docs), 50, most)
        got = substrings._without(substrings._rows(docs), spans, 50).select("doc_id", "n_words", "n_removed", "text").collect()
        assert multiset(got) == substring_brute(rows, 50)
        sizes = [(name, df.count()) for name, df in made]
        assert max(n for _, n in sizes) < 60 * 400 / 10, sizes


def test_segments_that_a_document_has_twice(spark):
    """A document has a long passage twice, a smaller one only a part of it that ends within a segment: both places lose that part."""
    passage = [f"p{j}" for j in range(400)]
    text = lambda *parts: " ".join(w for p in parts for w in p)
    rows = [(i, text([f"a{i}"], passage[i : i + 70], [f"b{i}"])) for i in range(0, 300, 7)]
    rows += [(1000, text(passage, ["x", "y"], passage, ["z"])), (1000, text(["v"], passage)), (1001, text(["w"], passage[100:300], ["q"], passage[100:300]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for most in (substrings.SHARD_WORDS, 100):
        spans = substrings._without(substrings._rows(docs), substrings.repeated_windows(substrings._rows(docs), 50, most), 50)
        assert multiset(spans.select("doc_id", "n_words", "n_removed", "text").collect()) == substring_brute(rows, 50)


@pytest.mark.parametrize("shard_words", [4_000, 100_000])
def test_against_reference(docs, shard_words):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = substrings.against_reference(docs, docs.where("doc_id IS NOT NULL"), 5, shard_words).select("doc_id", "n_words", "n_removed", "text").collect()
    some = [i for i, _ in rows if i is not None]
    assert multiset(r for r in got if r.doc_id is not None) == Counter(k for k in substring_brute(rows, 5).elements() if k[0] in some)
    assert {(r.n_removed, r.text) for r in got if r.doc_id is None} == {(60, ""), (0, "")}
    assert substrings.against_reference(docs, none(docs), 5).where("n_removed > 0").count() == 0
    assert substrings.against_reference(none(docs), docs, 5).count() == 0


# 6


def words6(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))


def contamination_brute(rows, items, window):
    out = []
    for i, t in rows:
        ws, hit, named = words6(t), set(), set()
        for item, it in items:
            iw = words6(it)
            n = min(window, len(iw))
            grams = {tuple(iw[s : s + n]) for s in range(len(iw) - n + 1)} if n and item is not None else set()
            for s in range(len(ws) - n + 1) if grams else ():
                if tuple(ws[s : s + n]) in grams:
                    hit |= set(range(s, s + n))
                    named.add(str(item))
        out.append((i, len(ws), tuple(sorted(hit)), tuple(sorted(named))))
    return Counter(out)


ITEMS = [(1, PASSAGE), (2, "the cat"), (10, None), (11, "  !! "), (3, "W5 w6, w7"), (None, "one"), (3, "日本語 and"), (4, PASSAGE[20:150])]


@pytest.mark.parametrize("shard_words,block_words", [(2_000_000, 500_000), (50, 20)])
def test_contamination(spark, docs, shard_words, block_words):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(docs, items, 13, shard_words, block_words).collect()
    want = contamination_brute([(r.doc_id, r.text) for r in docs.collect()], ITEMS, 13)
    assert Counter((r.doc_id, r.n_words, tuple(r.hits), tuple(r["items"])) for r in got) == want
    assert decontaminate.contamination(none(docs), items).count() == 0
    empty = decontaminate.contamination(docs, none(items)).collect()
    assert len(empty) == docs.count() and not any(r.hits for r in empty)


def test_blocks_of_items_read_the_index_as_it_lies(spark, docs):
    """The index is dealt out once: looking a block up takes no exchange, whatever the number of blocks; only matches give rows."""
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    index = decontaminate.build_index(docs, items, 50)
    looked = index.rows().groupBy("shard").applyInPandas(lambda rows: rows[["shard"]].head(1), "shard long")
    assert "Exchange" not in looked._jdf.queryExecution().executedPlan().toString()
    shards = [r.shard for r in looked.collect()]
    assert len(shards) == len(set(shards)) > 3 and index.documents().count() == docs.count()
    index.drop()
    tables = spark.sql("SHOW TABLES").count()
    decontaminate.contamination(docs, items, shard_words=50, block_words=20)
    assert spark.sql("SHOW TABLES").count() == tables


@pytest.mark.parametrize("block_words", [500_000, 4])
def test_contamination_by_items_without_id(spark, tmp_path, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "contamination", partial(decontaminate.contamination, shard_words=50, block_words=block_words))
    spark.createDataFrame([(1, "x one two three y"), (2, "four five six one two three"), (3, "seven"), (4, None), (5, "four five six")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, "one two three"), (None, "x one"), (8, "four five six"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(corpus_queries.ORACLES["op6_decontaminate"])
    names = [d[0] for d in want.description]
    want = want.fetchall()
    assert multiset(corpus_queries.op6_decontaminate(spark, str(tmp_path)).select(*names).collect()) == multiset(want)
    hit = {r[names.index("doc_id")] for r in want if r[names.index("contaminated")]}
    assert hit == {1, 2, 5}
    kept = corpus_pipeline.drop_contaminated(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == [3, 4]


def test_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d a b c"), (2, "c x b y a"), (3, "a b"), (4, "c"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "A, b c!")], "item_id long, text string")
    got = decontaminate.matches(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.item_word, r.doc_word) for r in got) == [(1, "7", 0, 0), (1, "7", 0, 4)]
    near = decontaminate.matches(docs, items, span=4).collect()
    assert {r.doc_id for r in near} == {1, 2}
    assert {r.doc_id for r in decontaminate.matches(docs, items, span=2).collect()} == {1}


# 7, 8, 9


def test_token_ids(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = work_path(spark, "ids")
    tokenids.write_ids(docs, out, path)
    library = Tokenizer.from_file(path)
    rows = sorted(((-1 if r.doc_id is None else r.doc_id, r.text or "", r.doc_id) for r in docs.collect()), key=lambda r: r[:2])
    at, want = 0, []
    for _, text, doc in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    got = tokenids.token_index(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert multiset(got) == Counter(want)
    one = tokenids.read_ids(spark, out).where("doc_id = 11").collect()
    assert len(one) == 1 and one[0].ids[-1] == 2


def test_token_ids_of_nothing(spark):
    out = work_path(spark, "ids")
    tokenids.write_ids(none(documents(spark)), out, public_tokenizers.path("byte_bpe_50k.json"))
    assert tokenids.token_index(spark, out).count() == 0


def rows_read(df):
    """Rows that the scans of a collected plan handed on."""
    out, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        if node.nodeName().startswith("Scan"):
            out += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_indexes_and_bloom_filters_skip_rows(spark):
    """Ids are even: one that is there is read with its row group alone, one between them is stopped by the Bloom filters."""
    docs = spark.range(0, 40_000, 2).selectExpr("id AS doc_id", "concat('text ', id) AS text").coalesce(1)
    out = work_path(spark, "ids")
    tokenids.write_ids(docs, out, public_tokenizers.path("byte_bpe_50k.json"))
    for wanted, found, most in ((20_000, 1, 2000), (20_001, 0, 0)):
        df = tokenids.read_ids(spark, out).where(f"doc_id = {wanted}").select("doc_id")
        assert len(df.collect()) == found
        assert rows_read(df) <= most
    whole = tokenids.read_ids(spark, out).select("doc_id")
    whole.collect()
    assert rows_read(whole) == 20_000


def odd_texts():
    rng = random.Random(4)
    parts = ["the", "don't", "I'LL", " ", "  ", "\n", "\t", " \n", ".", "..", "é", "É", "ß", "Σς", "İ", "日本", "😀", " ", "　", "́", "<|endoftext|>", "<|startoftext|>", "123", "½", "\x1c", "\x85", "ab.", "x" * 40, "_", "'s"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(1500)] + ["y" * 3000 + " " + "ab" * 800]


def test_byte_bpe_agrees_with_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), tokenids.ByteBpe(path, cached=500)
    texts = odd_texts()
    got = [x for at in range(0, len(texts), 100) for x in own.encode([t.encode() for t in texts[at : at + 100]])]
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_segment_tree_bpe_agrees_with_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.WordBpe(path, cached_words=500)
    texts = odd_texts()
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        for text, ids, decoded in zip(part, *own.encode_decode([t.encode() for t in part]), strict=True):
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<i4").tolist() == want, repr(text)
            assert decoded.decode() == library.decode(want, skip_special_tokens=False), repr(text)


def test_few_long_words_are_merged_like_many():
    """Plain trees of few words against rows of one array, and 80,000 characters in time."""
    merges = bpe.Merges(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(6)
    words = ["".join(rng.choices("etaoinshrdlu", k=n)) for n in (1, 2, 3, 8, 9, 60, 700, 5000)] + ["a" * 3000, "ab" * 700]
    few = [merges.encode([w])[0] for w in words]
    many = [merges.encode([w] * bpe.FEW)[-1] for w in words]
    assert few == many
    began = time.perf_counter()
    merges.encode(["".join(rng.choices("etaoinshrdlu", k=80_000))])
    assert time.perf_counter() - began < 10


def test_encode_decode(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, tuple(ids), library.decode(ids, skip_special_tokens=False))] += 1
    got = bpe.encode_decode(docs, path).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert bpe.encode_decode(none(docs), path).count() == 0


def test_token_counts_agree_with_the_library(docs):
    from tokenizers import Tokenizer, models

    scores = tokencounts.zipf_scores(public_tokenizers.path("piece_bpe_32k.model"))
    vocabulary = [("<unk>", 0.0), *scores.items(), *((f"<0x{i:02X}>", -1000.0) for i in range(256))]
    library = Tokenizer(models.Unigram(vocabulary, 0, True))
    for counter in (tokencounts.TrieCounter(scores), tokencounts.TrieCounter(scores, nodes=50)):
        for text in odd_texts()[:400]:
            for w in text.split():
                assert counter.count("▁" + w) == len(library.encode("▁" + w).tokens), w
    for w in ("ab" * 4000 + "é" * 2000, "x" * 6000):
        assert counter.count(w) == len(library.encode(w).tokens)
    want = Counter()
    for r in docs.collect():
        ws = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        want[(r.doc_id, len(ws), sum(len(library.encode("▁" + w).tokens) for w in ws))] += 1
    assert multiset(tokencounts.token_counts(docs, scores).collect()) == want
    assert tokencounts.token_counts(none(docs), scores).count() == 0


# 1


@pytest.mark.parametrize("block", [8, 2048])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 16))
    vectors = [*base, *(base[i % 10] + 0.15 * rng.standard_normal(16) for i in range(90)), *base[:5], *(3 * base[:5])]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows += [(1000 + i, v) for i, v in enumerate(odd)]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], "vec_id long, embedding array<float>, label int")
    good = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(np.float64)
            good[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.9]
    count, least = Counter(n for e in links for n in e), groups(links, [i for i, _ in rows])
    got = embeddings.near_vectors(df, recall=0.999999).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(i, count[i], least[i], least[i] == i) for i, _ in rows}
    assert embeddings.near_vectors(none(df)).count() == 0


@pytest.mark.parametrize("block", [256, 2048])
def test_embedding_recall_at_the_default(spark, monkeypatch, block):
    """Clusters of different spread, most links near the threshold: nothing below it is linked, and over 0.99 of the links are found."""
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((150, 48))
    v = np.concatenate([rng.standard_normal((2000, 48)), *(c + s * rng.standard_normal((20, 48)) for c, s in zip(centres, np.linspace(0.2, 0.4, 150), strict=True))]).astype(np.float32)
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    want = near.sum(axis=1) - 1
    assert want.sum() > 10_000
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(df).collect()}
    found = np.array([got[i] for i in range(len(v))])
    assert (found <= want).all() and found.sum() / want.sum() >= 0.99


@pytest.mark.parametrize("block", [2, 2048])
def test_embeddings_keep_chains_and_stars_connected(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    order = [3, 0, 6, 1, 7, 2, 5, 4]
    chain = [(i, [math.cos(0.4 * k), math.sin(0.4 * k)]) for k, i in enumerate(order)]
    hub = 10 + len(order)
    star = [(hub, [0.0, 0.0, 1.0] + [0.0] * 8), *((10 + k, [0.0, 0.0, 1.0] + [0.42 * (j == k) for j in range(8)]) for k in range(len(order)))]
    df = spark.createDataFrame(chain + star, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df, recall=0.999999).collect()}
    want = {i: (1 + (0 < k < len(order) - 1), 0, i == 0) for k, i in enumerate(order)}
    want |= {i: (len(order) if i == hub else 1, 10, i == 10) for i, _ in star}
    assert got == want


def test_embeddings_without_id(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (None, [1.0, 0.05]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (5, [0.0, 0.0])]
    con = duckdb.connect()
    for name, more in (("apart", []), ("equal", [(6, [1.0, 0.05])])):
        df = spark.createDataFrame(rows + more, "vec_id long, embedding array<double>")
        df.write.parquet(str(tmp_path / name))
        con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
        want = con.execute(corpus_queries.ORACLES["op1_embedding_dedup"])
        names = [d[0] for d in want.description]
        assert multiset(embeddings.near_vectors(df, recall=0.999999).select(*names).collect()) == multiset(want.fetchall())
    assert embeddings.near_vectors(df.unionByName(df.where("vec_id IS NULL"))).where("vec_id IS NULL AND n_links = 0 AND component_id IS NULL AND kept IS NULL").count() == 2


# 3


def test_quality(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choices(["river", "stone", "walks", "slowly", "and", "the", "of"], k=rng.randint(20, 80))) + "."
    bad = lambda: " ".join(w + rng.choice(["!!", "$$$", "###"]) for w in good().upper().split())
    rows = [(i, good() if i % 3 else bad(), int(bool(i % 3))) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5, None, 0), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    scored = {r.doc_id: r.score for r in quality.with_scores(docs, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and sum((scored[i] >= 0.5) == bool(rows[i][2]) for i in held) / len(held) > 0.98
    flags = {r[0] for r in docs.where(quality.held_out(docs["doc_id"])).select("doc_id").collect()}
    assert flags == set(held)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality", "toxic")
    again = {r.doc_id: r.score for r in quality.with_scores(docs, quality.fit(docs, flipped)).collect()}
    assert again == scored


def tree_brute(g, h, depth, least, ridge):
    """The step of each bin by trying every cut with plain sums."""
    total = sum(g) ** 2 / (sum(h) + ridge)
    best, at = 1e-9, 0
    for cut in range(1, len(g)) if depth else ():
        if min(sum(h[:cut]), sum(h[cut:])) >= least:
            gain = sum(g[:cut]) ** 2 / (sum(h[:cut]) + ridge) + sum(g[cut:]) ** 2 / (sum(h[cut:]) + ridge) - total
            if gain > best + 1e-12:
                best, at = gain, cut
    if not at:
        return [-sum(g) / (sum(h) + ridge)] * len(g)
    return tree_brute(g[:at], h[:at], depth - 1, least, ridge) + tree_brute(g[at:], h[at:], depth - 1, least, ridge)


def pair_brute(g, h, least, ridge):
    """The gain of the best table of steps: every first cut of either side, each part cut once along the other."""
    best, loss = 0.0, lambda gs, hs, step: 2 * gs * step + (hs + 0.0) * step**2
    for turned in (False, True):
        a, b = (list(zip(*g, strict=True)), list(zip(*h, strict=True))) if turned else (g, h)
        for cut in range(1, len(a)):
            gain = -(sum(map(sum, g)) ** 2) / (sum(map(sum, h)) + ridge)
            for part in (slice(0, cut), slice(cut, None)):
                gs, hs = [sum(c) for c in zip(*a[part], strict=True)], [sum(c) for c in zip(*b[part], strict=True)]
                gain -= sum(loss(x, y, s) for x, y, s in zip(gs, hs, tree_brute(gs, hs, 1, least, ridge), strict=True))
            best = max(best, gain)
    return best


def test_boosting_steps_and_scores_against_plain_loops():
    rng = np.random.default_rng(2)
    for _ in range(40):
        g, h = rng.standard_normal(rng.integers(1, 14)), None
        h = rng.random(len(g))
        for depth in (0, 1, 2):
            assert np.allclose(quality._tree(g, h, depth, 0.5, 1.0), tree_brute(g.tolist(), h.tolist(), depth, 0.5, 1.0))
        g, h = rng.standard_normal((4, 5)), rng.random((4, 5))
        assert np.isclose(quality._pair_tree(g, h, 0.5, 1.0)[1], pair_brute(g.tolist(), h.tolist(), 0.5, 1.0))
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 5)).astype(float)
    model = quality.train(x, y, rounds=20, pair_rounds=20, n_pairs=2)
    scores = model.score(x)
    for row, score in zip(x.tolist(), scores.tolist(), strict=True):
        total = model.base + sum(t[sum(e <= v for e in es)] for v, es, t in zip(row, model.edges, model.tables, strict=True))
        total += sum(t[sum(e <= row[i] for e in model.coarse[i]), sum(e <= row[j] for e in model.coarse[j])] for i, j, t in model.pairs)
        assert math.isclose(score, 1 / (1 + math.exp(-total)))
    assert (((scores >= 0.5) == y).mean()) > 0.95 and any({i, j} == {0, 1} for i, j, _ in model.pairs)
    first = quality.train(x, y, rounds=1, pair_rounds=0, n_pairs=0)
    total, at = np.full(300, first.base), [[sum(e <= v for e in es) for v in x[:, f]] for f, es in enumerate(first.edges)]
    for f, values in enumerate(first.tables):
        p = [1 / (1 + math.exp(-t)) for t in total]
        g, h = [0.0] * len(values), [0.0] * len(values)
        for k, bin_of in enumerate(at[f]):
            g[bin_of] += p[k] - y[k]
            h[bin_of] += p[k] * (1 - p[k])
        step = [0.1 * s for s in tree_brute(g, h, 2, 2.0, 1.0)]
        assert np.allclose(values, step)
        total = total + np.array([step[b] for b in at[f]])


def test_quality_of_odd_texts(docs, spark):
    labels = spark.createDataFrame([(4, 1, 0), (13, 0, 0), (15, 0, 0)], "doc_id long, quality int, toxic int")
    for own in (labels, none(labels)):
        got = quality.with_scores(docs, quality.fit(docs, own)).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        assert set(docs.columns) <= set(got[0].asDict())
    assert quality.with_scores(none(docs), quality.fit(none(docs), labels)).count() == 0


# 10


def license_brute(text, least=0.8):
    cut = lambda t: [" ".join(ws[k : k + 5]) for ws in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())] if ws for k in range(max(1, len(ws) - 4))]
    sh = cut(text or "")
    out = []
    for name, body in sorted(licenses.TEMPLATES.items()):
        own = list(dict.fromkeys(cut(body)))
        best = max(((len(set(own) & set(sh[p : p + 2 * len(own)])) / len(own), -p) for p, x in enumerate(sh) if x in own), default=(0, 0))
        if best[0] >= least:
            out.append((name, best[0], -best[1]))
    return out


def test_licenses(spark, docs):
    rng = random.Random(8)
    texts = []
    for body in licenses.TEMPLATES.values():
        ws = body.split()
        texts += [body, f"some words before {body.upper()} and {' '.join(ws[:4])} after", " ".join(ws[: len(ws) * 9 // 10]), " ".join(ws[: len(ws) // 2]), " ".join(rng.sample(ws, len(ws)))]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for d in (docs, more):
        got = licenses.license_scan(d).select("doc_id", "text", "licenses").collect()
        assert len(got) == d.count()
        for r in got:
            assert [(x.license, x.containment, x.word) for x in r.licenses] == license_brute(r.text), r.text
    assert licenses.license_scan(none(docs)).count() == 0
    assert licenses.license_scan(docs, {"empty": "!!"}).where("size(licenses) > 0").count() == 0


def test_license_recall(spark):
    """Copies with words replaced and filler between: nearly all that brute force matches is found, and nothing else."""
    rng, texts = random.Random(11), []
    for body in licenses.TEMPLATES.values():
        for _ in range(25):
            ws = [w if rng.random() > 0.02 else "zzz" for w in body.split()]
            at = rng.randrange(len(ws) + 1)
            filler = [f"f{rng.randrange(99)}" for _ in range(rng.choice([0, 0, 3, len(ws) // 2]))]
            around = [f"a{rng.randrange(99)}" for _ in range(rng.randrange(200))]
            texts.append(" ".join([*around, *ws[:at], *filler, *ws[at:], *around]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    got = {(r.doc_id, x.license, x.containment, x.word) for r in licenses.license_scan(df).collect() for x in r.licenses}
    want = {(i, *m) for i, t in enumerate(texts) for m in license_brute(t)}
    assert got <= want and len(want) > 300 and len(got) / len(want) >= 0.99


def test_a_hundred_templates_are_planned_in_time(spark):
    """Templates are constants of the plan: a hundred of 200 words each, every one found in the document that has it."""
    rng = random.Random(8)
    made = {f"t{i:03d}": " ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for i in range(100)}
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(made.values())] + [(100, "none of them")], "doc_id long, text string")
    licenses.license_scan(docs)._jdf.queryExecution().executedPlan()
    began = time.perf_counter()
    found = licenses.license_scan(docs, made)
    found._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - began < 30
    assert {r.doc_id: [x.license for x in r.licenses] for r in found.collect()} == {i: [n] for i, n in enumerate(made)} | {100: []}


def test_short_templates_are_refused(spark):
    with pytest.raises(ValueError):
        licenses.license_scan(none(documents(spark)), {"short": "All rights reserved."})


def test_licenses_run_no_python(spark):
    plan = licenses.license_scan(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Queries and pipeline


def test_digests_follow_the_contract(spark, tmp_path):
    from oddsbook.llm import queries

    documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op4_substring_dedup"](spark, str(tmp_path)).collect()}
    assert got[0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[5].kept_sha256 == hashlib.sha256(b"before after it").hexdigest() and got[5].n_removed == 60
