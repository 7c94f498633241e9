"""Periodic runs of words: longest common extensions by a difference cover, and runs from a harmonic grid of queries.

A run of period p and length max(6, 4p) or more has, in every stretch of max(6, 4p) - p words, a place x whose word is that at x + p. So
for each period the places at that distance from one another are asked how far the text agrees with itself p words on, forwards and
backwards: n / 3p places for each p, n log n in all. Nearly all of them disagree at once or within a few words.

The others ask for longest common extensions. Of the suffixes only those that begin at places in a perfect difference cover (6 of 31 residues)
are sorted: by blocks of 31 words, then by doubling. Any two places reach a pair of such places at the same distance of at most 30 words; so a query compares
these few words, and then takes the least common prefix between two sorted suffixes from a sparse table. Texts of a batch are searched
as one sequence with distinct marks between them; only those with a query that needs it are sorted.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsbook.llm.common import small_batches

#: Fixed value: a perfect difference set, each difference but 0 modulo STEP being that of one pair.
COVER, STEP = np.array([0, 1, 3, 8, 12, 18]), 31
#: The least length of a run and how many times its period it has.
SHORTEST, TIMES = 6, 4
#: Words searched as one sequence, but for a longer text, and queries answered at a time.
WORDS, QUERIES = 1 << 19, 1 << 20

_RANK = np.full(STEP, -1)
_RANK[COVER] = np.arange(len(COVER))
#: By difference: the residue of the first of the pair of cover places.
_FIRST = np.array([next(int(x) for x in COVER if _RANK[(x + d) % STEP] >= 0) for d in range(STEP)])


def agreeing(w: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from i and from j on are the same, up to `most`."""
    found = np.zeros(len(i), np.int64)
    active = np.flatnonzero(most > 0)
    k = 0
    while len(active):
        active = active[w[i[active] + k] == w[j[active] + k]]
        k += 1
        found[active] = k
        active = active[most[active] > k]
    return found


class Extensions:
    """Longest common extensions of places of w, whose words end in a mark that occurs once."""

    def __init__(self, w: np.ndarray):
        n, c = len(w), len(COVER)
        self.w = w
        places = np.arange(n)
        self.places = places = places[_RANK[places % STEP] >= 0]
        padded = np.concatenate([w, w.max() + 1 + np.arange(STEP)])
        blocks = np.lib.stride_tricks.sliding_window_view((padded - padded.min()).astype(">u4"), STEP)[places]
        rank = np.unique(np.ascontiguousarray(blocks).view(f"V{4 * STEP}").ravel(), return_inverse=True)[1].astype(np.int64)
        levels, ahead = [rank], c
        while rank.max() + 1 < len(places) and ahead < len(places):
            then = np.zeros_like(rank)
            then[:-ahead] = rank[ahead:] + 1
            rank = np.unique(rank * (len(places) + 1) + then, return_inverse=True)[1]
            levels.append(rank)
            ahead *= 2
        self.rank = rank
        order = np.argsort(rank)
        self.least = self._table(self._common(levels, order[:-1], order[1:]))

    def _common(self, levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of the suffixes at cover places a and b: whole blocks by the ranks of the doublings, then words."""
        a, b = a.copy(), b.copy()
        size, start = len(COVER) << (len(levels) - 1), a.copy()
        for rank in reversed(levels):
            inside = np.flatnonzero((a < len(rank)) & (b < len(rank)))
            same = inside[rank[a[inside]] == rank[b[inside]]]
            a[same] += size
            b[same] += size
            size >>= 1
        blocks = (a - start) // len(COVER) * STEP
        ends = lambda x: np.where(x < len(self.places), self.places[np.minimum(x, len(self.places) - 1)], len(self.w))
        i, j = ends(a), ends(b)
        return blocks + agreeing(self.w, i, j, np.minimum(STEP, len(self.w) - np.maximum(i, j)))

    @staticmethod
    def _table(common: np.ndarray) -> list[np.ndarray]:
        table, k = [common], 1
        while 2 * k <= len(common):
            table.append(np.minimum(table[-1][:-k], table[-1][k:]))
            k *= 2
        return table

    def reach(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are the same, i and j being different places."""
        ahead = (_FIRST[(j - i) % STEP] - i) % STEP
        found = agreeing(self.w, i, j, ahead)
        on = np.flatnonzero(found == ahead)
        at = lambda x: self.rank[x // STEP * len(COVER) + _RANK[x % STEP]]
        a, b = at(i[on] + ahead[on]), at(j[on] + ahead[on])
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(high - low)[1] - 1
        for k in np.unique(level):
            own = level == k
            found[on[own]] += np.minimum(self.least[k][low[own]], self.least[k][high[own] - (1 << k)])
        return found


def _least_length(p: np.ndarray) -> np.ndarray:
    return np.maximum(SHORTEST, TIMES * p)


def _grid(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grid of each text, in stretches of bounded size."""
    periods = np.where(sizes >= SHORTEST, np.maximum(1, sizes // TIMES), 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    p = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    each = (sizes[text] - 1 - p) // (_least_length(p) - p) + 1
    ends = np.cumsum(each)
    lo = 0
    while lo < len(p):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + QUERIES, "right")))
        own, n = p[lo:hi], each[lo:hi]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        apart = np.repeat(own, n)
        yield np.repeat(starts[text[lo:hi]], n) + nth * (_least_length(apart) - apart), apart
        lo = hi


def runs_of(texts: list[np.ndarray]) -> np.ndarray:
    """Rows (text, start, length, period) of the runs of each text of word numbers, by text, start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    joined, starts = _joined(texts, sizes)
    found, open_x, open_p = [], [], []
    for x, p in _grid(starts, sizes):
        some = joined[x] == joined[x + p]
        x, p = x[some], p[some]
        most = np.full(len(x), STEP)
        on = agreeing(joined, x, x + p, np.minimum(most, len(joined) - x - p))
        back = agreeing(joined[::-1], len(joined) - x, len(joined) - x - p, np.minimum(most, x))
        done = (on < STEP) & (back < STEP)
        take = done & (on + back + p >= _least_length(p))
        found.append(np.stack([x[take] - back[take], x[take] + p[take] + on[take], p[take]]))
        open_x.append(x[~done])
        open_p.append(p[~done])
    x, p = np.concatenate([*open_x, np.zeros(0, np.int64)]), np.concatenate([*open_p, np.zeros(0, np.int64)])
    if len(x):
        text = np.searchsorted(starts, x, "right") - 1
        own = np.unique(text)
        sub, at = _joined([texts[t] for t in own], sizes[own])
        place = x - starts[text] + at[np.searchsorted(own, text)]
        on, back = Extensions(sub), Extensions(sub[::-1])
        for lo in range(0, len(x), QUERIES):
            part = slice(lo, lo + QUERIES)
            i, q = place[part], p[part]
            f, b = on.reach(i, i + q), back.reach(len(sub) - i, len(sub) - i - q)
            take = f + b + q >= _least_length(q)
            found.append(np.stack([x[part] - b, x[part] + q + f, q])[:, take])
    start, end, period = np.concatenate([*found, np.zeros((3, 0), np.int64)], axis=1)
    order = np.lexsort([period, end, start])  # a stretch that several periods give has the least of them
    start, end, period = start[order], end[order], period[order]
    first = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    start, end, period = start[first], end[first], period[first]
    text = np.searchsorted(starts, start, "right") - 1
    order = np.lexsort([period, start])
    return np.stack([text, start - starts[text], end - start, period], axis=1)[order]


def _joined(texts: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one sequence with a mark of its own before each and after the last, and where each begins."""
    marks = -1 - np.arange(len(texts) + 1)
    pieces = [piece for m, t in zip(marks, texts, strict=False) for piece in (np.array([m]), t)]
    return np.concatenate([*pieces, marks[-1:]]), np.cumsum(np.r_[0, sizes[:-1] + 1]) + 1


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, joined by spaces, without those of each run after its first period."""
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 1] + runs[:, 3], 1)
        np.add.at(change, runs[:, 1] + runs[:, 2], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """(doc_id, runs, collapsed) of every row of docs: runs array<struct<start, length, period>> by start and period, collapsed the text without repeats.

    Words are what blanks (0x20, 0x09-0x0D) separate, numbered from 0. A run is a stretch of words with smallest period p and a length of max(6, 4p) or more that
    neither neighbour extends. collapsed has the words, joined by spaces, that no run contains after its first p words; it is never null.
    Null, empty and blank texts have no words and no runs; very long texts are taken whole, in memory of some 200 bytes a word. Repeated rows and ids are rows like others; only doc_id and text
    (or the column given for it) are read, whatever other columns there are; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    body = F.coalesce((F.col("text") if text is None else text).cast("string"), F.lit("")).cast("binary")

    def searched(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        sizes = [len(t) for t in texts]
        flat = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), np.int64, sum(sizes))
        runs = runs_of(np.split(flat, np.cumsum(sizes)[:-1]))
        cuts = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
        parts = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(RUN))
        collapsed = [_collapsed(t, runs[a:b]) for t, a, b in zip(texts, cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), parts), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, n = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(i)
                texts.append(t.as_py().split())  # of bytes: at ASCII blanks only
                n += len(texts[-1])
                if n >= WORDS:
                    yield searched(ids, texts)
                    ids, texts, n = [], [], 0
            if ids:
                yield searched(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body")).mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
