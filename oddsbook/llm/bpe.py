"""BPE encoding and decoding with segment trees over adjacent pair ranks.

A word's symbols stand at the leaves of a complete binary tree; leaf i holds the rank of the pair that starts at symbol i
together with i, and every inner node the least of its two children. The root is thus the leftmost pair of lowest rank.
A merge changes three leaves (the merged pair, the pair before it and the symbol that went), whose ancestors alone are
updated, until the root says that no pair can merge. Trees of equal size are held as rows of one array, so one numpy
operation does the same step of many words.

Spark deals out the documents; each Python worker keeps the words it has encoded in a bounded cache, so that a frequent
word is merged once per worker and the memory does not grow with the corpus.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsbook.llm.common import small_batches

_NONE = int(np.iinfo(np.int64).max)
#: Words in a worker's cache, and tree leaves that are merged at a time.
CACHED_WORDS, LEAVES_AT_ONCE = 400_000, 1 << 19
#: Words of one tree size below which they are merged one by one in plain lists.
FEW = 8


# The word rule of the files that the encoder takes, as they state it.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(others)) for b in range(256)]


class Merges:
    """The vocabulary and the ranked merges of a tokenizer file in the JSON format of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([(self.ids[a] << 32) | self.ids[b] for a, b in pairs], dtype=np.int64)
        self.merged = np.array([self.ids[a + b] for a, b in pairs], dtype=np.int64)
        self.rank_of, self.merged_of = dict(zip(keys.tolist(), range(len(keys)), strict=True)), self.merged.tolist()
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.inner, self.last = np.full(512, -1, np.int64), np.full(512, -1, np.int64)  # by character
        for c in byte_alphabet():
            self.inner[ord(c)], self.last[ord(c)] = self.ids[c], self.ids[c + self.suffix]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; _NONE where they do not merge (a symbol of -1 merges with nothing)."""
        key = (left << 32) | (right & 0xFFFFFFFF)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], _NONE)

    def encode(self, words: list[str]) -> list[bytes]:
        """The merged symbols of each word of byte-level characters, as 32-bit little-endian ids."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        symbols = self.inner[chars]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.last[chars[ends - 1]]
        out: list[bytes] = [b""] * len(words)
        caps = np.maximum(2, 2 ** np.ceil(np.log2(sizes)).astype(np.int64))
        for cap in np.unique(caps):
            rows = np.flatnonzero(caps == cap)
            if len(rows) < FEW:  # a step of all rows at once is worth its while for many rows only
                for r in rows.tolist():
                    out[r] = np.array(self._merge_one(symbols[ends[r] - sizes[r] : ends[r]].tolist(), int(cap)), "<i4").tobytes()
                continue
            for at in range(0, len(rows), step := max(1, LEAVES_AT_ONCE // int(cap))):
                part = rows[at : at + step]
                within = np.arange(cap)
                filled = within < sizes[part, None]
                leaves = np.full((len(part), cap + 1), -1, dtype=np.int64)  # the last column stands for "no symbol"
                leaves[:, :cap][filled] = symbols[((ends - sizes)[part, None] + within)[filled]]
                flat, counts = self._merge(leaves, sizes[part], int(cap))
                data, to = flat.astype("<i4").tobytes(), (np.cumsum(counts) * 4).tolist()
                for r, x, y in zip(part.tolist(), [0, *to], to, strict=False):
                    out[r] = data[x:y]
        return out

    def _merge_one(self, symbols: list[int], cap: int) -> list[int]:
        """The same for the symbols of one word, step by step in plain lists: a merge updates three leaves and what changes above them."""
        n, ranks, merged = len(symbols), self.rank_of, self.merged_of
        tree = [_NONE] * (2 * cap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            rank = ranks.get((symbols[i] << 32) | symbols[i + 1]) if symbols[i] >= 0 and symbols[i + 1] >= 0 else None
            if rank is not None:
                tree[cap + i] = rank * cap + i
        for node in range(cap - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at: int) -> None:
            """The leaf of the pair that begins at a place, and the nodes above it as far as they change."""
            right, rank = after[at], None
            if right < n and symbols[at] >= 0 and symbols[right] >= 0:
                rank = ranks.get((symbols[at] << 32) | symbols[right])
            value, node = _NONE if rank is None else rank * cap + at, cap + at
            while node and tree[node] != value:
                tree[node] = value
                node >>= 1
                if node:
                    value = min(tree[2 * node], tree[2 * node + 1])

        while (root := tree[1]) != _NONE:
            at = root % cap
            gone = after[at]
            symbols[at], symbols[gone] = merged[root // cap], -1
            after[at] = following = after[gone]
            if following < n:
                before[following] = at
            put(gone)
            put(at)
            if before[at] >= 0:
                put(before[at])
        return [x for x in symbols if x >= 0]

    def _merge(self, symbols: np.ndarray, sizes: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
        """Merges the symbols of each row to the end; what is left, row after row, and how much of each row."""
        m = len(symbols)
        after = np.tile(np.arange(1, cap + 2), (m, 1))
        after[np.arange(m), np.maximum(sizes - 1, 0)] = cap
        before = np.tile(np.arange(-1, cap), (m, 1))
        tree = np.full((m, 2 * cap), _NONE, dtype=np.int64)
        ranks = self.pair_ranks(symbols[:, : cap - 1], symbols[:, 1:cap])
        tree[:, cap : 2 * cap - 1] = np.where(ranks == _NONE, _NONE, ranks * cap + np.arange(cap - 1))
        width = cap // 2
        while width:
            tree[:, width : 2 * width] = np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2])
            width //= 2
        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            root = tree[rows, 1]
            at = root % cap
            gone = after[rows, at]
            following = after[rows, gone]
            symbols[rows, at] = merged = self.merged[root // cap]
            symbols[rows, gone] = -1
            after[rows, at] = following
            more = following < cap
            before[rows[more], following[more]] = at[more]
            prior = before[rows, at]
            tree[rows, cap + gone] = _NONE
            rank = self.pair_ranks(merged, symbols[rows, following])
            tree[rows, cap + at] = np.where(rank == _NONE, _NONE, rank * cap + at)
            led = prior >= 0
            rank = self.pair_ranks(symbols[rows[led], prior[led]], merged[led])
            tree[rows[led], cap + prior[led]] = np.where(rank == _NONE, _NONE, rank * cap + prior[led])
            r3, node = np.concatenate([rows, rows, rows[led]]), cap + np.concatenate([at, gone, prior[led]])
            while node[0] > 1:
                node = node >> 1
                tree[r3, node] = np.minimum(tree[r3, 2 * node], tree[r3, 2 * node + 1])
            rows = rows[tree[rows, 1] != _NONE]
        left = symbols[:, :cap] >= 0
        return symbols[:, :cap][left], left.sum(axis=1)


class WordBpe:
    """Encodes and decodes as the tokenizers library does with a word-level BPE file (normaliser, words, merges, special tokens)."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        if (whole["normalizer"], whole["pre_tokenizer"]) != (_NORMALIZER, _PRE_TOKENIZER):
            raise ValueError("the file's normalizer or pre-tokenizer is another than the word rule of this encoder")
        self.special = {a["content"]: a["id"] for a in whole["added_tokens"]}
        known = Tokenizer.from_file(path)
        self.normalise, self.split = known.normalizer.normalize_str, known.pre_tokenizer.pre_tokenize_str
        names = self.merges.ids | self.special
        self.names = {i: t.encode() for t, i in names.items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.plain = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\s0-9a-z]+")
        self.latin = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.bytes = dict(enumerate(byte_alphabet()))
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.most = cached_words

    def _pieces(self, chunk: bytes) -> list[str | int]:
        """The words of a text without blanks, as byte-level strings; special tokens as their ids."""
        if chunk.isalpha():
            return [chunk.lower().decode()]
        text = chunk.decode("utf-8", "replace")
        out: list[str | int] = []
        for part in self.marks.split(text) if self.marks and self.marks.search(text) else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part.isascii() and part.isprintable():
                out += self.plain.findall(part.lower())
            elif part and part.isprintable() and max(part) < "\u0250":  # Latin letters, which are in normal form
                out += [w.encode().decode("latin-1").translate(self.bytes) for w in self.latin.findall(part.lower())]
            elif part:
                out += [w for w, _ in self.split(self.normalise(part))]
        return out

    def _add(self, chunks: Iterable[bytes]) -> None:
        """Encodes chunks that are not in the cache; their new words in one go."""
        pieces = {c: self._pieces(c) for c in chunks}
        new = list({w for ps in pieces.values() for w in ps if isinstance(w, str)} - self.words.keys())
        self.words.update(zip(new, self.merges.encode(new), strict=True))
        for chunk, ps in pieces.items():
            self.chunks[chunk] = b"".join([self.words[p] if isinstance(p, str) else p.to_bytes(4, "little") for p in ps])

    def decode(self, ids: bytes) -> bytes:
        """The names of the tokens, joined by a space: the files have no decoder, and that is what the library does then."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, dtype="<i4").tolist()))

    def encode_decode(self, texts: list[bytes | None]) -> tuple[list[bytes], list[bytes]]:
        """The ids (32-bit, little-endian) and the decoded text of each text."""
        split = [(t or b"").split() for t in texts]
        if new := set().union(*split) - self.chunks.keys():
            if len(self.chunks) + len(new) > self.most:  # what this batch uses stays
                self.chunks = {c: self.chunks[c] for c in set().union(*split) - new}
                self.words.clear()
            self._add(new)
        ids, decoded = [], []
        for chunks in split:
            ids.append(b"".join(map(self.chunks.__getitem__, chunks)))
            decoded.append(self.decode(ids[-1]))
        return ids, decoded


@lru_cache(maxsize=1)
def _worker_bpe(path: str) -> WordBpe:
    """One encoder for all tasks of a Python worker, so that they share its cache."""
    return WordBpe(path)


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row of docs, for whole texts.

    ids are those of the tokenizers library without special tokens added, decoded is its decode of them with special
    tokens kept. Null and empty texts give no ids and an empty text. Other columns are ignored; repeated rows stay rows. A very long text is
    taken whole; a word of very many characters has a tree of its own, of some 200 bytes a character, and takes time in proportion to n log n. A tokenizer file with another word rule is refused.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker_bpe(tokenizer_path)
        for b in batches:
            ids, decoded = bpe.encode_decode(b.column(1).cast(pa.binary()).to_pylist())
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(decoded, pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
