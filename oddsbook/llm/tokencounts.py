"""Token counts under a unigram model, by dynamic programming shared along a trie.

The best score of a pre-token's first k characters depends on those characters alone. The distinct pre-tokens of a batch
are therefore put in a trie and the forward step is done once per trie node: the best score of its prefix is the best
over the pieces that end there of the score at the node where the piece begins plus the piece's own. A terminal node gives
the token count of its pre-token, which is kept in a bounded cache; documents add up counts.

No public unigram model is at hand and tokenizers are not trained here, so the pieces of a sentencepiece file are taken with
Zipf's law over their ranks as log probabilities.
"""

from __future__ import annotations

import math
import uuid
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsbook.llm.common import small_batches

#: Pre-tokens in a worker's cache, and nodes of a trie before it is begun anew.
CACHED_WORDS, TRIE_NODES = 600_000, 200_000
#: Characters of a pre-token that the trie holds; what follows them is shared by few words.
DEPTH = 1_000
#: Marks the start of a pre-token, as in the pieces.
START = "▁"


def zipf_scores(path: str) -> dict[str, float]:
    """The ordinary pieces of a sentencepiece file with ln(1 / (rank H)), rank from 1 in the file's order and H the harmonic sum."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = list(dict.fromkeys(pieces))
    total = sum(1 / (r + 1) for r in range(len(pieces)))
    return {p: -math.log((r + 1) * total) for r, p in enumerate(pieces)}


class TrieCounter:
    """Counts the tokens of pre-tokens. A character that no piece covers has one token for each of its UTF-8 bytes, at the least piece score less 10."""

    def __init__(self, scores: dict[str, float], nodes: int = TRIE_NODES):
        self.scores, self.longest, self.most = scores, max(map(len, scores), default=1), nodes
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self._begin()

    def _begin(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.best: list[float] = [0.0]
        self.tokens: list[int] = [0]

    def _step(self, word: str, end: int, best: deque, tokens: deque) -> tuple[float, int]:
        """The forward step to the prefix word[:end], from the last prefixes as far as a piece can reach: its score and its tokens."""
        top, n, before, scores = -math.inf, 0, len(best), self.scores
        for k in range(before):  # the longest piece first
            score = scores.get(word[end - before + k : end])
            if score is None:
                if k < before - 1:
                    continue
                score, more = self.unknown, len(word[end - 1].encode())
            else:
                more = 1
            if (total := best[k] + score) > top:
                top, n = total, tokens[k] + more
        return top, n

    def count(self, word: str) -> int:
        """Tokens on the best path of a pre-token; of equal paths the one whose last piece is longest, at every prefix.

        Prefixes of up to DEPTH characters are nodes of the trie and computed once for all words that share them; of what follows, as many prefixes are held as
        a piece has characters.
        """
        if len(self.best) > self.most:
            self._begin()
        node, best, tokens = 0, deque([0.0], self.longest), deque([0], self.longest)
        for end in range(1, len(word) + 1):
            following = self.children[node].get(word[end - 1]) if end <= DEPTH else None
            if following is None:
                top, n = self._step(word, end, best, tokens)
                if end <= DEPTH:
                    following = self.children[node][word[end - 1]] = len(self.best)
                    self.children.append({})
                    self.best.append(top)
                    self.tokens.append(n)
            else:
                top, n = self.best[following], self.tokens[following]
            best.append(top)
            tokens.append(n)
            node = following
        return tokens[-1]


#: The counter and the known counts of a Python worker, by the run they belong to.
_WORKER: dict[str, tuple[TrieCounter, dict[bytes, int]]] = {}


def _of_worker(run: str, scores: dict[str, float]) -> tuple[TrieCounter, dict[bytes, int]]:
    """The same for all tasks of a run in a worker, so that they share its cache."""
    if run not in _WORKER:
        _WORKER.clear()
        _WORKER[run] = TrieCounter(scores), {}
    return _WORKER[run]


def token_counts(docs: DataFrame, scores: dict[str, float], cached_words: int = CACHED_WORDS) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row of docs: pre-tokens between ASCII blanks, and their tokens under the unigram model.

    Whole texts are counted; null, empty and blank texts have none. Other columns are ignored, repeated rows stay rows. Memory is bounded for very long texts and pre-tokens.
    """
    small_batches(docs.sparkSession)
    name = uuid.uuid4().hex
    held = docs.sparkSession.sparkContext.broadcast(scores)  # a vocabulary, of fixed size

    def new_counts(counter: TrieCounter, words: Iterable[bytes]) -> Iterator[tuple[bytes, int]]:
        for w in sorted(words):  # neighbours share prefixes
            yield w, counter.count(START + w.decode("utf-8", "replace"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, known = _of_worker(name, held.value)
        for b in batches:
            split = [(t or b"").split() for t in b.column(1).cast(pa.binary()).to_pylist()]
            words = set().union(*split)
            new = words - known.keys()
            if len(known) + len(new) > cached_words:  # what this batch uses stays
                used = {w: known[w] for w in words - new}
                known.clear()
                known.update(used)
            known.update(new_counts(counter, new))
            totals = [sum(map(known.get, ws, repeat(0))) for ws in split]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.fromiter(map(len, split), np.int64, count=len(split))), pa.array(totals, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
