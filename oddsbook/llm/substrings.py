"""Substring dedup with suffix automata of reference shards.

A window is `length` consecutive words; a word goes if a window over it also starts in a document with a smaller doc_id.

against_reference() is the plain form: automata of the shards of a reference table are broadcast round by round and all documents
are streamed through each for their matching statistics. Its work is documents times shards, so it suits a bounded reference.

substring_dedup() has the corpus itself as reference, where that would be quadratic. So the windows are dealt to shards by
content: a window's anchor is the least hash of its ANCHOR_WORDS-word shingles, equal windows have equal anchors, and
neighbouring windows mostly share theirs, so that a document is cut into segments of windows with one anchor. Only anchors
of two or more documents go on. Equal segments are one row (the smallest doc_id has its words; in all other documents the whole
segment is a repeat). The different segments of an anchor go to one shard, whose suffix automaton knows, for every substring, the
smallest doc_id that has it; the segments are streamed through it for their matching statistics, and the windows matched over the
full length in a smaller doc_id are repeats.

A shard has a bounded number of words. An anchor whose different segments have more (a passage that very many documents share, each
with other words around it) is split: the same is done with its segments as texts and longer shingles, halfway to a whole window
each time, which stand in fewer windows and apart from other words around them. Where whole windows are the shingles, equal ones
alone stand together. The rows of a level are segments, one for all that come again in a text without a gap between them, so that
neither a passage nor a phrase over and over gives a row for each window. Segments are equal if two independent 64-bit hashes of
their words are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsbook.llm.common import small_batches, written

#: Words of a shingle, windows of a segment at most, and words of a shard of a reference that is broadcast.
ANCHOR_WORDS, SEGMENT_WINDOWS, REFERENCE_WORDS = 12, 1000, 100_000
#: Words that one anchor's automaton may have (half a kilobyte of memory each), and up to which small anchors are gathered in one.
SHARD_WORDS, GATHERED_WORDS = 200_000, 20_000
#: Of whole windows as shingles, an anchor has one segment unless hashes collide.
_NO_LIMIT = (1 << 63) - 1
_BASES = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


class _Hashes(dict):
    """128-bit XXH3 of words, each computed once."""

    def __missing__(self, word: bytes) -> bytes:
        from xxhash import xxh3_128_digest

        self[word] = value = xxh3_128_digest(word)
        return value


@lru_cache(maxsize=1)
def _word_hashes() -> _Hashes:
    """The word hashes of a Python worker."""
    return _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of a base and its inverse modulo 2^64, as far as a text needed them."""

    def __init__(self, base: int):
        self.factors = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, f, np.uint64)])) for f in self.factors)
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b) for b in _BASES]


class Rolled:
    """Two independent 64-bit hashes of any run of words of a text, from sums of prefixes."""

    def __init__(self, words: list[bytes]):
        known = _word_hashes()
        if len(known) > 500_000:
            known.clear()
        h = np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint64).reshape(-1, 2)
        self.sums, self.down = [], []
        for lane, powers in enumerate(_POWERS):
            up, down = powers.get(len(words) + 1)
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(h[:, lane] * up[:-1], dtype=np.uint64)]))
            self.down.append(down)

    def run(self, start: np.ndarray, end: np.ndarray, lane: int) -> np.ndarray:
        sums = self.sums[lane]
        return _mixed((sums[end] - sums[start]) * self.down[lane][start] + (end - start).astype(np.uint64))

    def grams(self, n: int) -> np.ndarray:
        at = np.arange(len(self.sums[0]) - n)
        return self.run(at, at + n, 0)


def segments(words: list[bytes], length: int, size: int = ANCHOR_WORDS) -> tuple[np.ndarray, ...]:
    """The segments of a text by its shingles of size words: anchor, two hashes of their words, first window, number of windows, reach.

    Equal segments that follow within `length` words of each other are one: the first, and how far from it the last begins. Whatever window of the first is a
    repeat, it is one in all, and they cover all words between.
    """
    n = len(words) - length + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 6
    rolled = Rolled(words)
    size = min(size, length)
    least, width, wanted = rolled.grams(size), 1, length - size + 1
    while 2 * width <= wanted:  # the least of twice as many shingles each time
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if wanted > width:
        least = np.minimum(least[: n], least[wanted - width : wanted - width + n])
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]])) if size < length else np.arange(n)
    count = np.diff(np.concatenate([start, [n]]))
    if count.max() > SEGMENT_WINDOWS:  # the same words over and over: cut evenly from the first
        more = (count - 1) // SEGMENT_WINDOWS
        nth = np.arange(len(start) + more.sum()) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
        start = np.repeat(start, more + 1) + nth * SEGMENT_WINDOWS
        count = np.diff(np.concatenate([start, [n]]))
    h1, h2 = (rolled.run(start, start + count + length - 1, lane).view(np.int64) for lane in (0, 1))
    anchor = least[start].view(np.int64)
    order = np.lexsort((start, count, h2, h1, anchor))
    anchor, h1, h2, count, start = (c[order] for c in (anchor, h1, h2, count, start))
    new = start[1:] - start[:-1] > length
    for c in (anchor, h1, h2, count):
        new |= c[1:] != c[:-1]
    first, last = (np.flatnonzero(np.concatenate(e)) for e in (([True], new), (new, [True])))
    return *(c[first] for c in (anchor, h1, h2, start, count)), start[last] - start[first]


class Automaton:
    """The suffix automaton of several word sequences; each state knows the smallest document that has its words."""

    def __init__(self):
        self.follow: list[dict[bytes, int]] = [{}]
        self.link, self.size, self.first = [-1], [0], [1 << 63]

    def _state(self, follow: dict[bytes, int], size: int, link: int, first: int) -> int:
        self.follow.append(follow)
        self.size.append(size)
        self.link.append(link)
        self.first.append(first)
        return len(self.size) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state of the longest suffix at p followed by word: q, or a copy of q cut to that size."""
        if self.size[q] == self.size[p] + 1:
            return q
        copy = self._state(dict(self.follow[q]), self.size[p] + 1, self.link[q], self.first[q])
        while p >= 0 and self.follow[p].get(word) == q:
            self.follow[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list[bytes], doc: int) -> None:
        last = 0
        for word in words:
            q = self.follow[last].get(word)
            if q is not None:
                last = self._split(last, word, q)
            else:
                new, p = self._state({}, self.size[last] + 1, 0, doc), last
                while p >= 0 and word not in self.follow[p]:
                    self.follow[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, word, self.follow[p][word])
                last = new
            if doc < self.first[last]:
                self.first[last] = doc

    def finish(self) -> None:
        """Makes each state know the documents of all longer words that end in its own."""
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.first[state] < self.first[self.link[state]]:
                self.first[self.link[state]] = self.first[state]

    def repeats(self, words: list[bytes], doc: int, length: int) -> list[int]:
        """Starts of the windows that a smaller document has: where the matched suffix is as long as a window."""
        state, matched, out = 0, 0, []
        follow, link, size, first = self.follow, self.link, self.size, self.first
        for i, word in enumerate(words):
            while state and word not in follow[state]:
                state = link[state]
                matched = size[state]
            if word in follow[state]:
                state = follow[state][word]
                matched += 1
            if matched >= length:
                while size[link[state]] >= length:
                    state = link[state]
                matched = min(matched, size[state])
                if first[state] < doc:
                    out.append(i - length + 1)
        return out


def _columns(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _segments(texts: DataFrame, length: int, size: int = ANCHOR_WORDS) -> DataFrame:
    """The segments of texts (doc, body, text, own), whose first word has the number own in its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [segments(t.split(), length, size) for t in b.column(2).cast(pa.binary()).to_pylist()]
            times = [len(p[0]) for p in parts]
            cols = [np.concatenate([np.empty(0, np.int64), *(p[i] for p in parts)]) for i in range(6)]
            doc, body, own = (np.repeat(b.column(i).to_numpy(), times) for i in (0, 1, 3))
            out = [doc, body, own, *cols[:3], (own + cols[3]).astype(np.int32), *(c.astype(np.int32) for c in cols[4:])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["doc", "body", "own", "anchor", "h1", "h2", "at", "n", "reach"])

    return texts.select("doc", "body", "text", "own").mapInArrow(run, "doc long, body long, own int, anchor long, h1 long, h2 long, at int, n int, reach int")


def _taken(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The words of the wanted segments, a row each."""
    names, kinds = ["anchor", "split", "doc", "body", "at", "words"], [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, body, own, text, parts in zip(*(c.to_pylist() for c in (*b.columns[:3], b.column(3).cast(pa.binary()), b.column(4))), strict=True):
                words = text.split()
                for w in parts:
                    first = w["at"] - own
                    out.append((w["anchor"], w["split"], doc, body, w["at"], b" ".join(words[first : first + w["n"] + length - 1])))
            yield _columns(out, names, kinds)

    asked = wanted.groupBy("doc", "body", "own").agg(F.collect_list(F.struct("anchor", "at", "n", "split")).alias("parts"))
    return texts.join(asked, ["doc", "body", "own"]).select("doc", "body", "own", "text", "parts").mapInArrow(run, "anchor long, split boolean, doc long, body long, at int, words binary")


def _runs(starts: list[int]) -> list[tuple[int, int]]:
    """Ascending numbers as runs (first, how many)."""
    at = np.array(starts, np.int64)
    return [(int(r[0]), len(r)) for r in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1) if len(r)]


def _matched(taken: DataFrame, length: int) -> DataFrame:
    """(doc, body, part, at, n): the repeated windows of the segments, which `part` names by their first window, from the automata of their shards."""

    def shard(rows: list[tuple]) -> list[tuple]:
        automaton, split = Automaton(), [(doc, body, at, words.split()) for _, doc, body, at, words in rows]
        for doc, _, _, words in split:
            automaton.add(words, doc)
        automaton.finish()
        out = []
        for doc, body, at, words in split:
            out += [(doc, body, at, at + first, n) for first, n in _runs(automaton.repeats(words, doc, length))]
        return out

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return _columns(shard(rows), ["doc", "body", "part", "at", "n"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        words = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if words >= GATHERED_WORDS and row[0] != held[-1][0]:  # whole anchors only
                    yield batch(held)
                    held, words = [], 0
                held.append(row)
                words += row[4].count(b" ") + 1
        if held:
            yield batch(held)

    dealt = taken.where("NOT split").select("anchor", "doc", "body", "at", "words").repartition("anchor").sortWithinPartitions("anchor", "doc")
    return dealt.mapInArrow(run, "doc long, body long, part int, at int, n int")


def shards(found: DataFrame, length: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """From segments of anchors that several documents have: those that equal one of a smaller doc, as (doc, body, own, at, n), and the different ones of
    anchors that have several, with `split` where those of an anchor have more than shard_words words."""
    key = ["anchor", "h1", "h2", "n"]
    first = F.min(F.struct("doc", "body", "own", "at")).alias("first")
    distinct = written(found.groupBy(*key).agg(first).select(*key, *(F.col(f"first.{c}").alias(c) for c in ("doc", "body", "own", "at"))), "distinct-segments")
    copies = found.join(distinct.select(*key, F.col("doc").alias("owner")), key).where("doc > owner").select("doc", "body", "own", "at", (F.col("n") + F.col("reach")).alias("n"))
    words = F.sum(F.col("n") + (length - 1))
    several = written(distinct.groupBy("anchor").agg(F.count("*").alias("k"), words.alias("w")).where("k > 1").select("anchor", (F.col("w") > shard_words).alias("split")), "several")
    return copies, distinct.join(several, "anchor")


def _everywhere(inner: DataFrame, found: DataFrame, different: DataFrame) -> DataFrame:
    """(doc, body, own, at, n) from repeats (doc, body, part, at, n) within the different segments: at every place where their document has the segment."""
    key = ["anchor", "h1", "h2", "n", "doc"]
    first = different.select(*key, F.col("body").alias("__body"), F.col("at").alias("part"))
    places = found.join(first, key).select("doc", "__body", "part", F.col("body").alias("of"), "own", F.col("at").alias("place"), "reach").distinct()
    moved = (F.col("place") + F.col("at") - F.col("part")).alias("at")
    return inner.withColumnRenamed("body", "__body").join(places, ["doc", "__body", "part"]).select("doc", F.col("of").alias("body"), "own", moved, (F.col("n") + F.col("reach")).alias("n"))


def _repeats(texts: DataFrame, length: int, size: int, shard_words: int) -> DataFrame:
    """(doc, body, own, at, n): the repeated windows of texts (doc, body, text, own), by shingles of size words and, for the segments that are split, longer ones."""
    found = written(_segments(texts, length, size), "segments")
    shared = written(found.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("anchor"), "anchors")
    found = written(found.join(shared, "anchor"), "shared-segments")
    copies, different = shards(found, length, shard_words if size < length else _NO_LIMIT)
    taken = written(_taken(texts, different, length), "taken")
    inner = _matched(taken, length)
    split = taken.where("split").select("doc", "body", F.col("words").alias("text"), F.col("at").alias("own"))
    if not split.isEmpty():
        deeper = _repeats(split, length, (size + length + 1) // 2, shard_words)
        inner = inner.unionByName(deeper.withColumnRenamed("own", "part"))
    return copies.unionByName(_everywhere(inner, found, different))


def repeated_windows(docs: DataFrame, length: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc, body, at, n): n windows from word `at` on that documents with a smaller doc share, or that such windows cover between them, for docs (doc, body, text, own)."""
    return _repeats(docs, length, min(ANCHOR_WORDS, length), shard_words).select("doc", "body", "at", "n")


def _rows(docs: DataFrame) -> DataFrame:
    """Rows as texts (doc, body, text, own): own is the number of a text's first word."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(body).alias("body"), body.alias("text"), F.lit(0).alias("own"))


def substring_dedup(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, text) of every row of docs: text is what is left of its words, joined by one space.

    Words are runs without ASCII blanks; null, empty and blank texts have none. A word goes if a window of `length` words over
    it also starts in a row with a smaller doc_id; windows are those of the input. Rows of one doc_id are not smaller than each
    other; rows with a null doc_id lose and take nothing. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = _rows(docs)
    return _without(rows, repeated_windows(rows.where("doc IS NOT NULL"), length), length)


def against_reference(docs: DataFrame, reference: DataFrame, length: int = 50, shard_words: int = REFERENCE_WORDS) -> DataFrame:
    """The same for windows that a row of reference (doc_id, text) with a smaller doc_id has; a null doc_id there is below all others, one in docs above.

    The automata of the reference are broadcast shard by shard, each about shard_words words and made of whole rows, and all documents are
    streamed through each: for a reference of bounded size. Documents and reference may be null, empty or long texts, or none.
    """
    small_batches(docs.sparkSession)
    rows, known = _rows(docs), _rows(reference)
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // (6 * shard_words))  # words of five letters and a space
    spark, spans = docs.sparkSession, None
    lowest, highest = -(1 << 63), (1 << 63) - 1
    for i in range(n):
        automaton = Automaton()
        for r in known.where(F.pmod("body", F.lit(n)) == i).collect():
            automaton.add(r.text.encode().split(), lowest if r.doc is None else r.doc)
        automaton.finish()
        held = spark.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[tuple] = []
                for doc, body, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    out += [(doc, body, *r) for r in _runs(held.value.repeats(text.split(), highest if doc is None else doc, length))]
                yield _columns(out, ["doc", "body", "at", "n"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()])

        found = written(rows.mapInArrow(run, "doc long, body long, at int, n int"), "reference-spans")
        held.destroy()
        spans = found if spans is None else spans.unionByName(found)
    return _without(rows, spans if n else spark.createDataFrame([], "doc long, body long, at int, n int"), length)


def _without(rows: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """(doc_id, n_words, n_removed, text) of rows without the words that the windows of the spans cover."""
    gone = spans.groupBy(F.col("doc").alias("of"), F.col("body").alias("hash")).agg(F.collect_list(F.struct("at", "n")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, removed, texts = [], [], []
            for text, spans in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = text.split()
                edges = np.zeros(len(words) + 1, np.int64)
                for s in spans or ():
                    edges[s["at"]] += 1
                    edges[s["at"] + s["n"] + length - 1] -= 1
                keep = np.cumsum(edges[:-1]) == 0
                sizes.append(len(words))
                removed.append(len(words) - int(keep.sum()))
                texts.append(b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k] if removed[-1] else words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    same = F.col("doc").eqNullSafe(F.col("of")) & (F.col("body") == F.col("hash"))
    return rows.join(gone, same, "left").select("doc", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")
