"""Token ids of documents in ORC files.

Documents are dealt by ranges of doc_id and sorted, encoded, and written by Spark's ORC writer: ids are integer columns under
ORC's run-length encoding, in stripes that are read in parallel; row indexes and Bloom filters on doc_id let a reader with
a filter on doc_id skip stripes and row groups. Each row holds its place in its file and the number of the file, so
that the place of a document in the whole sequence needs only a sum per file.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsbook.llm.common import small_batches

SCHEMA = "part int, at_token long, doc_id long, n_tokens int, ids array<int>"
#: Pieces of text in a worker's cache, and the ids of all of them; pieces that the library encodes in one text.
CACHED_PIECES, CACHED_IDS, PIECES_AT_ONCE = 600_000, 8_000_000, 4_000
_LETTER, _DIGIT, _MARK, _WIDE, _BLANK = 1, 2, 3, 4, 5
_KIND = np.array([_BLANK if c in (9, 10, 11, 12, 13, 32) else 0 if c < 32 or c == 127 else _WIDE if c > 127 else _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _MARK for c in range(256)], np.uint8)
#: First bytes of characters that are never white space: printable ASCII, and beyond it those that no white space begins with.
_SOLID = (_KIND > 0) & (_KIND < _BLANK) & ~np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_JOINED = re.compile(rb"( ?)[\x21-\x7e\x80-\xc1\xc3-\xe0\xe4-\xff][^\x00-\x20\x7f]*")


class ByteBpe:
    """Encodes texts with the tokenizers library, each distinct piece once as long as it stays in the cache.

    The pre-tokenizer of a byte-level file takes runs of letters, of digits or of other marks with a space before them, contractions
    after an apostrophe, and white space, of which it leaves the last character to what follows. So it always cuts
    before a space and around a line end that a solid character follows, and between ASCII letters, digits and marks (but not after an
    apostrophe). There texts are cut into pieces and the ids of the pieces are joined. A text with a special token is one piece, and
    so are all texts where the file has another pre-tokenizer or a normaliser.
    """

    def __init__(self, path: str, cached: int = CACHED_PIECES, cached_ids: int = CACHED_IDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.library = Tokenizer.from_file(path)
        state = json.loads(self.library.to_str())
        before = state["pre_tokenizer"] or {}
        self.cuts = state["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.spaced = np.array([t is not None and t.startswith("\u0120") for t in map(self.library.id_to_token, range(self.library.get_vocab_size()))])
        self.line_end = self._encode(["\n"])[0]
        self.most, self.most_ids = cached, cached_ids
        self.places: dict[bytes, int] = {}
        self.starts, self.sizes, self.uses = (np.zeros(1024, np.int64) for _ in range(3))
        self.ids, self.held = np.zeros(1 << 16, np.int32), 0

    def _forget(self) -> None:
        """Keeps the pieces that several batches used; if these are over half of what may be held, nothing."""
        kept = [(p, i) for p, i in self.places.items() if self.uses[i] > 1]
        at = np.fromiter((i for _, i in kept), np.int64, count=len(kept))
        sizes = self.sizes[at]
        if 2 * len(kept) > self.most or 2 * sizes.sum() > self.most_ids:
            kept, at, sizes = [], at[:0], sizes[:0]
        ends = np.cumsum(sizes)
        flat = self.ids[np.arange(sizes.sum()) + np.repeat(self.starts[at] - (ends - sizes), sizes)]
        self.places = {p: i for i, (p, _) in enumerate(kept)}
        self.starts, self.sizes, self.uses = (np.concatenate([x, np.zeros(1024, np.int64)]) for x in (ends - sizes, sizes, np.zeros(len(kept), np.int64)))
        self.ids, self.held = np.concatenate([flat, np.zeros(1 << 16, np.int32)]), len(flat)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, pieces: list[bytes], spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces that all begin with a space, or all follow a line end, encoded as one text; and their sizes."""
        flat = self._encode([(b"" if spaced else b"\n").join(pieces).decode("utf-8", "replace")])[0]
        if spaced:
            first = np.flatnonzero(self.spaced[flat])
            sizes = np.diff(first, append=len(flat))
        else:
            apart = np.flatnonzero(flat == self.line_end[0])
            sizes = np.diff(apart, prepend=-1, append=len(flat)) - 1
            flat = np.delete(flat, apart)
        if len(sizes) != len(pieces):  # can only be where a file's tokens go beyond its pre-tokenizer's cuts
            return self._apart(pieces)
        return flat, sizes

    def _apart(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._encode([p.decode("utf-8", "replace") for p in pieces])
        return np.concatenate([*ids, np.empty(0, np.int32)]), np.fromiter(map(len, ids), np.int64, count=len(ids))

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        """Encodes pieces that are not in the cache and appends them to it; their places."""
        kinds: tuple[list[int], list[int], list[int]] = ([], [], [])
        for i, p in enumerate(pieces):
            m = _JOINED.fullmatch(p) if self.cuts else None
            kinds[2 if m is None else 1 if m.end(1) else 0].append(i)
        places = np.empty(len(pieces), np.int64)
        for kind, own in enumerate(kinds):
            for at in range(0, len(own), PIECES_AT_ONCE):
                which = own[at : at + PIECES_AT_ONCE]
                part = [pieces[i] for i in which]
                flat, sizes = self._apart(part) if kind == 2 else self._together(part, kind == 1)
                n = len(self.places)
                if self.held + len(flat) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.int32)])
                if n + len(part) > len(self.starts):
                    more = np.zeros(max(len(self.starts), len(part)), np.int64)
                    self.starts, self.sizes, self.uses = (np.concatenate([x, more]) for x in (self.starts, self.sizes, self.uses))
                self.places.update(zip(part, range(n, n + len(part)), strict=True))
                places[which] = np.arange(n, n + len(part))
                self.ids[self.held : self.held + len(flat)] = flat
                self.sizes[n : n + len(part)] = sizes
                self.starts[n : n + len(part)] = self.held + np.cumsum(sizes) - sizes
                self.held += len(flat)
        return places

    def _pieces(self, texts: pa.Array, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of the texts begin in their bytes, with the end of the last; and how many pieces stand before each text's end."""
        mark = np.zeros(len(data) + 1, bool)
        if self.cuts and len(data) > 1:
            kind, solid = _KIND[data], _SOLID[data]
            solid[ends[(ends > 0) & (ends < len(data))]] = False  # the first character of a text follows nothing
            a, b = kind[:-1], kind[1:]
            mark[1:-1] = (a != b) & (a > 0) & (b > 0) & (np.maximum(a, b) < _WIDE) & ~((data[:-1] == 39) & (b == _LETTER))
            mark[:-2] |= (data[:-1] == 32) & solid[1:]
            line = np.flatnonzero((data[:-1] == 10) & solid[1:])
            mark[line] = mark[line + 1] = True
            for s in self.special:
                for i in np.flatnonzero(pc.match_substring(texts, s.encode())).tolist():
                    mark[ends[i] + 1 : ends[i + 1]] = False
        mark[ends] = True
        mark[len(data)] = True
        starts = np.flatnonzero(mark)
        return starts, np.searchsorted(starts, ends)

    def encode_array(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (a binary array without nulls), text after text, and where each begins, with the end; end_id is appended to each."""
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        starts, counts = self._pieces(texts, data, ends)
        found = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        names, cut = found.dictionary.buffers()[2], np.frombuffer(found.dictionary.buffers()[1], np.int32)[: len(found.dictionary) + 1].tolist()
        names = names.to_pybytes() if names else b""
        distinct = [names[x:y] for x, y in pairwise(cut)]
        if len(self.places) + len(distinct) > self.most or self.held > self.most_ids:
            self._forget()
        known = np.fromiter(map(self.places.get, distinct, repeat(-1)), np.int64, count=len(distinct))
        new = np.flatnonzero(known < 0)
        known[new] = self._add([distinct[i] for i in new.tolist()])
        self.uses[known] += 1
        place = known[found.indices.to_numpy()]
        sizes, starts, flat = self.sizes[place], self.starts[place], self.ids[: self.held]
        if end_id is not None:
            sizes, starts, flat = np.insert(sizes, counts[1:], 1), np.insert(starts, counts[1:], self.held), np.append(flat, np.int32(end_id))
            counts = counts + np.arange(len(counts))
        to = np.concatenate([[0], np.cumsum(sizes)])
        return flat[np.arange(to[-1]) + np.repeat(starts - to[:-1], sizes)], to[counts]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text, 32-bit little-endian; null is an empty text."""
        ids, ends = self.encode_array(pa.array([t or b"" for t in texts], pa.binary()))
        return [ids[x:y].astype("<i4").tobytes() for x, y in pairwise(ends.tolist())]


@lru_cache(maxsize=1)
def _worker_bpe(path: str) -> ByteBpe:
    """One encoder for all tasks of a Python worker, so that they share its cache."""
    return ByteBpe(path)


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Writes the ids of every row of docs, each followed by end_id, to ORC files at path in ascending doc_id order.

    Null and empty texts have end_id alone. Rows with a null doc_id come first, rows of one doc_id stand together in the
    order of their texts; other columns are ignored, an empty table gives files without rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, at = _worker_bpe(tokenizer_path), TaskContext.get().partitionId(), 0
        for b in batches:
            ids, ends = bpe.encode_array(b.column(1).cast(pa.binary()).fill_null(b""), end_id)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), part, np.int32)), pa.array(at + ends[:-1]), b.column(0), pa.array(np.diff(ends).astype(np.int32)), lists], ["part", "at_token", "doc_id", "n_tokens", "ids"])
            at += int(ends[-1])

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    coded = dealt.mapInArrow(run, SCHEMA)
    coded.write.option("orc.bloom.filter.columns", "doc_id").option("orc.row.index.stride", 1000).option("orc.stripe.size", 64 << 20).option("compression", "snappy").orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files; a filter on doc_id is pushed to their indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, from its ids as they are read.

    start is the number of ids of all documents before it: its place in its file, and the ids of the files before. The
    sums of the files are one row a file, so they are broadcast and run through one ordered window.
    """
    rows = read_ids(spark, path)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("at_token")).alias("start"), "ids")
    return placed.mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long")
