"""Benchmark decontamination with a distributed positional inverted index of the training documents.

The index is made where the documents lie: a task numbers the words of its documents in one stream, document after
document with a gap between them, and every SHARD_WORDS words writes a shard: for each term its sorted positions (stored
as gaps), and the places of the documents. Postings are kept for the terms that some test item may have by a filter of fixed size
over the hashes of the items' terms. The index is a table bucketed by shard; the items are looked up in blocks of bounded size, one after the other, and
each block reads the buckets as they lie, without an exchange. Only documents with a match give rows.

A phrase is looked up from its rarest term in the shard: the positions of that term, less its offset, are intersected
with the equally adjusted positions of the other terms, rarest first. Shards are bounded and are dealt out by number.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsbook.llm.common import delete, small_batches, work_path, written

#: Words of documents in a shard, words of test items in a block that is broadcast, and slots of the filter of terms.
SHARD_WORDS, BLOCK_WORDS, FILTER_SLOTS = 2_000_000, 500_000, 1 << 22
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_INDEX = "shard long, term binary, gaps array<int>, docs array<long>, starts array<int>, sizes array<int>"


def words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in lower case; null has none."""
    return (text or b"").translate(_WORDS).split()


def _text_column(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))


def _slot(term: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(term) % FILTER_SLOTS


class _Terms(dict):
    """Numbers of the terms met in a shard; -1 for those that the filter says no item has."""

    def __init__(self, slots: np.ndarray):
        self.slots, self.names = slots, []

    def __missing__(self, term: bytes) -> int:
        if self.slots[_slot(term)]:
            self.names.append(term)
            self[term] = number = len(self.names) - 1
        else:
            self[term] = number = -1
        return number


def term_filter(items: DataFrame) -> np.ndarray:
    """Which slots the terms of the items hash to: as many booleans whatever the items hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({_slot(w) for t in b.column(0).cast(pa.binary()).to_pylist() for w in words(t)}), pa.int32())], ["slot"])

    small_batches(items.sparkSession)
    slots = np.zeros(FILTER_SLOTS, bool)
    slots[[r.slot for r in items.select(F.col("text").cast("string")).mapInArrow(run, "slot int").distinct().collect()]] = True
    return slots


class Index:
    """The index as a table of its own, bucketed by shard: a row (shard, term, gaps) for each term of a shard, and one without a term that has its documents."""

    def __init__(self, rows: DataFrame):
        self.spark, self.name = rows.sparkSession, f"postings_{uuid.uuid4().hex}"
        self.path, buckets = work_path(self.spark, "postings"), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows.repartition(buckets, "shard").write.format("parquet").bucketBy(buckets, "shard").option("path", self.path).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def documents(self) -> DataFrame:
        """(shard, place, doc_id, n_words) of every document, by its place in its shard; each row once."""
        held = self.spark.read.schema(_INDEX).parquet(self.path).where("term IS NULL")
        return held.select("shard", F.posexplode(F.arrays_zip("docs", "sizes")).alias("place", "d")).select("shard", F.col("place").cast("long").alias("place"), F.col("d.docs").alias("doc_id"), F.col("d.sizes").cast("long").alias("n_words"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def build_index(docs: DataFrame, items: DataFrame, shard_words: int = SHARD_WORDS) -> Index:
    """The index of docs; postings are those of the terms that pass the filter of the items' terms."""
    small_batches(docs.sparkSession)
    held_slots = docs.sparkSession.sparkContext.broadcast(np.packbits(term_filter(items)))

    def flush(shard: int, ids: list[np.ndarray], names: list[bytes], docs: list[int | None], sizes: list[int]) -> pa.RecordBatch:
        stream = np.concatenate([*ids, np.empty(0, np.int32)])
        at = np.flatnonzero(stream >= 0)
        at = at[np.argsort(stream[at], kind="stable")]
        found, first = np.unique(stream[at], return_index=True)
        gaps = np.diff(at, prepend=0)
        gaps[first] = at[first]
        n = len(found)
        starts = np.cumsum([0, *(s + 1 for s in sizes)])[:-1]
        lists = pa.ListArray.from_arrays(pa.array([*first.tolist(), len(at), len(at)], pa.int32()), pa.array(gaps.astype(np.int32)))
        return pa.RecordBatch.from_arrays([
            pa.array([shard] * (n + 1), pa.int64()), pa.array([*(names[i] for i in found.tolist()), None], pa.binary()), lists,
            pa.array([*repeat(None, n), docs], pa.list_(pa.int64())), pa.array([*repeat(None, n), starts.tolist()], pa.list_(pa.int32())), pa.array([*repeat(None, n), sizes], pa.list_(pa.int32())),
        ], ["shard", "term", "gaps", "docs", "starts", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, gap = TaskContext.get().partitionId() << 32, np.array([-1], np.int32)
        slots = np.unpackbits(held_slots.value)
        lookup, ids, docs, sizes, held = _Terms(slots), [], [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found = words(text)
                ids += [np.fromiter(map(lookup.__getitem__, found), np.int32, count=len(found)), gap]
                docs.append(doc)
                sizes.append(len(found))
                held += len(found) + 1
                if held >= shard_words:
                    yield flush(shard, ids, lookup.names, docs, sizes)
                    lookup, shard, ids, docs, sizes, held = _Terms(slots), shard + 1, [], [], [], 0
        if docs:
            yield flush(shard, ids, lookup.names, docs, sizes)

    return Index(_text_column(docs, "doc_id").mapInArrow(run, _INDEX))


class Shard:
    """The posting lists of a shard, from its rows of the index."""

    def __init__(self, rows: pd.DataFrame):
        own = rows[rows.term.isna()].iloc[0]
        self.docs, self.starts, self.sizes = list(own.docs), np.asarray(own.starts, np.int64), np.asarray(own.sizes, np.int64)
        self.gaps = {bytes(t): g for t, g in zip(rows.term, rows.gaps, strict=True) if t is not None}
        self.lists: dict[bytes, np.ndarray] = {}

    def count(self, term: bytes) -> int:
        return len(self.gaps.get(term, ()))

    def positions(self, term: bytes) -> np.ndarray:
        if term not in self.lists:
            self.lists[term] = np.cumsum(np.asarray(self.gaps.get(term, ()), np.int64))
        return self.lists[term]

    def has(self, term: bytes, at: np.ndarray) -> np.ndarray:
        """Which of the positions hold the term."""
        own = self.positions(term)
        return own[np.minimum(np.searchsorted(own, at), len(own) - 1)] == at if len(own) else np.zeros(len(at), bool)

    def near(self, term: bytes, at: np.ndarray, span: int) -> np.ndarray:
        """Which of the positions have the term at most span words away."""
        own = self.positions(term)
        return np.searchsorted(own, at + span, "right") > np.searchsorted(own, at - span, "left")

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def phrases(self, item: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of the item's windows of that many words (an item of fewer is one): places in the stream and window numbers."""
        size = min(window, len(item))
        counts = np.array([self.count(w) for w in item])
        at, number = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if size:
            starts = np.arange(len(item) - size + 1)
            spans = np.lib.stride_tricks.sliding_window_view(counts, size)
            anchors = starts + spans.argmin(axis=1)
            for anchor in np.unique(anchors[spans.min(axis=1) > 0]):
                own = starts[(anchors == anchor) & (spans.min(axis=1) > 0)]
                places, alive = self.positions(item[anchor]), np.ones((len(own), counts[anchor]), bool)
                offsets = [i for i in range(own[0], own[-1] + size) if i != anchor]
                for i in sorted(offsets, key=lambda i: (counts[i], abs(i - anchor))):
                    over = (own <= i) & (i < own + size)
                    if over.any():
                        alive[over] &= self.has(item[i], places + (i - anchor))
                        keep = alive.any(axis=0)
                        places, alive = places[keep], alive[:, keep]
                    if not len(places):
                        break
                w, p = np.nonzero(alive)
                at.append(places[p] + own[w] - anchor)
                number.append(own[w])
        return np.concatenate(at), np.concatenate(number)

    def together(self, item: list[bytes], span: int) -> np.ndarray:
        """Places of the item's rarest word that have all its other words at most span words away, in the same document."""
        terms = sorted(set(item), key=self.count)
        places = self.positions(terms[0]) if terms else np.empty(0, np.int64)
        for t in terms[1:]:
            doc = self.doc_of(places)
            low, high = self.starts[doc], self.starts[doc] + self.sizes[doc]
            own = self.positions(t)
            first = np.searchsorted(own, np.maximum(places - span, low), "left")
            last = np.searchsorted(own, np.minimum(places + span + 1, high), "left")
            places = places[last > first]
        return places


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS, unnamed: bool = False) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Blocks of items as [(item_id as text, words)] of about so many words at most, read one at a time; one at least.

    Items with a null id are left out, unless unnamed is true.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), text.alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (2 * block_words)))  # a word and its gap have two characters at least
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        yield [(r.item_id, w) for r in part if (unnamed or r.item_id is not None) and (w := words(r.text.encode()))]


def _matches(index: Index, items: DataFrame, schema: str, find, block_words: int, unnamed: bool = False) -> DataFrame:
    """The rows of find(shard, number, items) for each block of items, written block by block, so that one is broadcast at a time."""

    def over(held: Broadcast):
        return lambda rows: find(Shard(rows), int(rows.shard.iloc[0]), held.value)

    spark, path = index.spark, work_path(index.spark, "matches")
    for i, block in enumerate(item_blocks(items, block_words, unnamed)):
        held = spark.sparkContext.broadcast(block)
        index.rows().groupBy("shard").applyInPandas(over(held), schema).write.parquet(f"{path}/block={i}")
        held.destroy()
    return spark.read.schema(f"{schema}, block int").parquet(path).drop("block")


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, unnamed: bool = False) -> DataFrame:
    """(doc_id, n_words, hits, items) of every row of docs: the numbers of the words inside an occurrence of a window of an item, and those items.

    A window is `window` consecutive words of an item; an item of fewer, but not none, is one window. Null texts have no words,
    items of one id are one item. Items with a null id are left out, or with unnamed are hits like others and together one
    item, a null in items. Rows of one doc_id are separate rows.
    """

    def find(shard: Shard, number: int, block: list[tuple[str | None, list[bytes]]]) -> pd.DataFrame:
        total = int(shard.starts[-1] + shard.sizes[-1]) + 1
        edges, of = np.zeros(total + 1, np.int64), [set() for _ in shard.docs]
        for item, ws in block:
            at, _ = shard.phrases(ws, window)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + min(window, len(ws)), -1)
            for d in np.unique(shard.doc_of(at)).tolist():
                of[d].add(item)
        hit = np.flatnonzero(np.cumsum(edges) > 0)
        some = [d for d, names in enumerate(of) if names]
        hits = [hit[np.searchsorted(hit, shard.starts[d]) : np.searchsorted(hit, shard.starts[d] + shard.sizes[d])] - shard.starts[d] for d in some]
        return pd.DataFrame({"shard": number, "place": some, "hits": pd.Series(hits, dtype=object), "items": pd.Series([sorted(of[d], key=lambda i: (i is not None, i)) for d in some], dtype=object)})

    index = build_index(docs, items, shard_words)
    found = _matches(index, items, "shard long, place long, hits array<int>, items array<string>", find, block_words, unnamed)
    gathered = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    found = found.groupBy("shard", "place").agg(gathered("hits"), gathered("items"))
    sizes = written(index.documents(), "index-documents")
    index.drop()
    none = {"hits": F.array().cast("array<int>"), "items": F.array().cast("array<string>")}
    return sizes.join(found.hint("merge"), ["shard", "place"], "left").select("doc_id", "n_words", *(F.coalesce(c, v).alias(c) for c, v in none.items()))


def matches(docs: DataFrame, items: DataFrame, window: int = 13, span: int | None = None, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, item_word, doc_word) of every exact phrase match: the window that starts at item_word occurs at doc_word.

    With span, the proximity matches instead: doc_word is a place of the item's rarest word with all its other words
    at most span words away in the document, and item_word is null.
    """

    def find(shard: Shard, _: int, block: list[tuple[str, list[bytes]]]) -> pd.DataFrame:
        parts = []
        for item, ws in block:
            at, number = shard.phrases(ws, window) if span is None else (shard.together(ws, span), None)
            doc = shard.doc_of(at)
            parts.append(pd.DataFrame({"doc_id": pd.array([shard.docs[d] for d in doc], "Int64"), "item_id": item, "item_word": pd.array([None] * len(at) if number is None else number, "Int64"), "doc_word": at - shard.starts[doc]}))
        return pd.concat(parts) if parts else pd.DataFrame({"doc_id": [], "item_id": [], "item_word": [], "doc_word": []})

    index = build_index(docs, items, shard_words)
    found = _matches(index, items, "doc_id long, item_id string, item_word long, doc_word long", find, block_words)
    index.drop()
    return found


def is_contaminated(n_hit, n_words):
    """The rule: some word is hit, and hit words are a twentieth of all words or more."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
