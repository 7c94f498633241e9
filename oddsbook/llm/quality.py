"""A quality classifier: a generalised additive model with pairwise interactions over statistics of whole texts.

Each feature is cut into bins. Boosting goes round the features: a shallow tree over one feature's bins is fitted to the
gradient and its leaves are added, shrunk, to that feature's lookup table; then the pairs of features whose joint
tables promise most are boosted in the same way. A score is a sum of table entries, added for all rows of a batch at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsbook.llm.common import small_batches

FEATURES = [
    "log_bytes", "log_words", "bytes_per_word", "word_length_sd", "upper", "digits", "symbols", "marks", "beyond_ascii", "blanks",
    "distinct_words", "top_word", "short_words", "distinct_lines", "log_line_bytes", "compressed", "repeated_next", "symbol_ends", "shouted",
]
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_MARKS, _SYMBOLS = b".,;:?'\"()-", b"!#$%&*+/<=>@[\\]^_`{|}~"
_BEYOND, _BLANKS = bytes(range(128, 256)), b" \t\n\x0b\x0c\r"
_STEP = 1 << 16


def features(text: str | None) -> list[float]:
    """The features of a whole text, in the order of FEATURES; null is an empty text, which has zeros."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return [float(np.log1p(len(data)))] + [0.0] * (len(FEATURES) - 1)
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / len(data)
    counts = Counter(words)
    sizes = np.fromiter(map(len, counts), np.float64, count=len(counts))
    times = np.fromiter(counts.values(), np.float64, count=len(counts))
    n = len(words)
    mean = float(sizes @ times) / n
    lines = data.split(b"\n")
    odd = sum(k for w, k in counts.items() if w[-1] in _SYMBOLS)
    loud = sum(k for w, k in counts.items() if w.isupper() and len(w) > 1)
    packed = zlib.compressobj(1)
    small = sum(len(packed.compress(data[at : at + _STEP])) for at in range(0, len(data), _STEP)) + len(packed.flush())
    return [
        float(np.log1p(len(data))), float(np.log1p(n)), len(data) / n, float(np.sqrt(max(0.0, (sizes - mean) ** 2 @ times / n))), share(_UPPER), share(_DIGITS), share(_SYMBOLS), share(_MARKS), share(_BEYOND), share(_BLANKS),
        len(counts) / n, float(times.max()) / n, float(times[sizes <= 2].sum()) / n, len(set(lines)) / len(lines), float(np.log1p(len(data) / len(lines))), small / len(data), sum(map(bytes.__eq__, words, words[1:])) / n, odd / n, loud / n,
    ]


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float, ridge: float) -> np.ndarray:
    """A regression tree over ordered bins, as the step of each bin: Newton steps of leaves with at least that much weight."""
    best, at = 1e-9, 0
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge), 0.0)
        at = int(gain.argmax()) + 1
        best = gain[at - 1]
    if not at or best <= 1e-9:
        return np.full(len(g), -g.sum() / (h.sum() + ridge))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1, least, ridge), _tree(g[at:], h[at:], depth - 1, least, ridge)])


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float, ridge: float) -> tuple[np.ndarray, float]:
    """A tree over a table of two features: the best cut of either, each side cut once along the other; its steps and gain."""
    best, steps = 0.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(a)):
            out, gain = np.empty_like(a), -(g.sum() ** 2) / (h.sum() + ridge)
            for part in (slice(0, cut), slice(cut, None)):
                gs, hs = a[part].sum(axis=0), b[part].sum(axis=0)
                out[part] = step = _tree(gs, hs, 1, least, ridge)
                gain += float(-(2 * gs * step + hs * step**2).sum())
            if gain > best + 1e-12:
                best, steps = gain, out.T if turned else out
    return steps, best


@dataclass
class Model:
    """Bin edges and lookup tables; score() is the chance of label 1."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, f], "right")]
        for i, j, values in self.pairs:
            total += values[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.1, bins: int = 64, coarse_bins: int = 8, least: float = 2.0, ridge: float = 1.0) -> Model:
    """The model of labels y (0 or 1) on features x. Without rows the score is 0.5, with one label only it leans to that label."""
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    cuts = lambda k: [np.unique(np.quantile(x[:, f], np.arange(1, k) / k)) if len(x) else np.empty(0) for f in range(x.shape[1])]
    edges, coarse = cuts(bins), cuts(coarse_bins)
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Model(base, edges, tables, coarse, [])
    if not 0 < y.sum() < len(y):
        return model
    at = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    total = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f, values in enumerate(tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[f], g, len(values)), np.bincount(at[f], h, len(values)), 2, least, ridge)
            values += step
            total += step[at[f]]
    at = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]

    def grids(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        cell = at[i] * shape[1] + at[j]
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    g, h = slopes()
    promise = sorted(((-_pair_tree(*grids(i, j, g, h), least, ridge)[1], i, j) for i, j in combinations(range(x.shape[1]), 2)))
    model.pairs = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in promise[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, values in model.pairs:
            step = rate * _pair_tree(*grids(i, j, *slopes()), least, ridge)[0]
            values += step
            total += step[at[i], at[j]]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Model:
    """Learns from at most max_rows labelled documents that are not held out: those least by a hash of doc_id.

    Labels that are null or of no document are left out; of several labels of a document the largest counts. Only max_rows
    ids and as many feature rows reach the driver, of rows that share an id too; the features are computed on the executors.
    """
    small_batches(docs.sparkSession)
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    own = own.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    found = rows.mapInArrow(run, "doc_id long, quality int, x array<double>")
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_rows)  # rows may share an id
    got = sorted((r.doc_id, r.quality, *r.x) for r in found.collect())
    x = np.array([r[2:] for r in got], dtype=np.float64).reshape(len(got), len(FEATURES))
    return train(x, np.array([r[1] for r in got], dtype=np.float64))


def with_scores(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """docs with the score of each row's whole text in a double column of that name (one already there is replaced).

    Null, empty and very long texts have a score like others, repeated rows one each; other columns stay as they are.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(score)
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.string()).to_pylist()
            scores = model.score(np.array([features(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], schema=pa.schema([*b.schema, pa.field(score, pa.float64())]))

    return docs.mapInArrow(run, schema)
