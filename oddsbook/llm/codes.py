"""Vector code compression by dual-tree Lloyd rounds: product codes of integer vectors, all sums and distances in integers.

Vectors are gathered into chunks of at most CHUNK rows. For each part position a chunk has a balanced tree over its parts: points in the tree's
order, and boxes and sums of all nodes, made once and written to the shared folder. Each round has a tree over the entries of every codebook too.
A task walks both trees together, level by level: from the distances of a node's box to the boxes of entry nodes, combinations that cannot hold a
nearest entry go; once entries stand alone, one goes if the entry nearest to the box's middle is nearer at every place of the box. A node with one entry left
is assigned whole by its stored sums, whatever number of points it has (copies of one vector are one box); at the leaves that stay
uncertain, integer distances to the entries that are left decide. A task gives one row of sums per entry, and the driver holds the codebooks only.

Bounds are exact integers and nothing that ties with the nearest is dropped, so codes are those of comparing every part with every entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsbook.llm.common import discard, written

CHUNK, LEAF = 4096, 128
#: Components are below this in magnitude: products, boxes' bounds and squared distances of a part of up to 10,000 places are whole numbers
#: that doubles hold exactly, so matrix products and bounds work on doubles without rounding. Sums are in 64-bit integers.
LARGEST = 1 << 18


@dataclass
class Tree:
    """A balanced tree over the rows of x: row numbers in the tree's order, and boxes (and sums) of the nodes, level by level from the root.

    Node j of level k has the rows from j * n >> k to (j + 1) * n >> k.
    """

    order: np.ndarray
    x: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    depth: int

    def rows(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return node * len(self.x) >> level, (node + 1) * len(self.x) >> level


def grow(x: np.ndarray, leaf: int) -> Tree:
    """The tree over whole rows x whose leaves have `leaf` rows at most, or one or two where leaf is 1."""
    n, depth = len(x), 0
    while (n >> depth) > leaf and (2 << depth) <= n:
        depth += 1
    order = np.arange(n)
    for level in range(depth):
        for j in range(1 << level):
            lo, mid, hi = j * n >> level, (2 * j + 1) * n >> (level + 1), (j + 1) * n >> level
            own = x[order[lo:hi]]
            order[lo:hi] = order[lo:hi][np.argpartition(own[:, np.ptp(own, axis=0).argmax()], mid - lo)]
    x = x[order]
    starts = np.arange(1 << depth) * n >> depth
    levels = [(np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts), np.add.reduceat(x.astype(np.int64), starts))]
    for _ in range(depth):
        low, high, sums = levels[0]
        levels.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), sums[::2] + sums[1::2]))
    return Tree(order, x, *(np.concatenate(a) for a in zip(*levels, strict=True)), depth)


def _unlike(points: Tree, entries: Tree, at: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Which pairs (node at, entry node e) cannot hold a nearest entry, by the distances of their boxes; pairs are sorted by node."""
    gap = np.maximum(0.0, np.maximum(entries.low[e] - points.high[at], points.low[at] - entries.high[e]))
    span = np.maximum(points.high[at] - entries.low[e], entries.high[e] - points.low[at])
    near, far = (gap * gap).sum(axis=1), (span * span).sum(axis=1)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return near > np.repeat(np.minimum.reduceat(far, starts), np.diff(np.r_[starts, len(at)]))


def _beaten(points: Tree, book: np.ndarray, at: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Which pairs (node at, entry e) have an entry that is nearer at every place of the node's box: that nearest to its middle is tried."""
    low, high = points.low[at], points.high[at]
    middle = 2 * book[e] - low - high
    off = (middle * middle).sum(axis=1)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    sizes = np.diff(np.r_[starts, len(at)])
    first = np.flatnonzero(off == np.repeat(np.minimum.reduceat(off, starts), sizes))
    rival = e[first[np.searchsorted(first, starts)]]  # the first of the nearest of each node
    rival = book[np.repeat(rival, sizes)]
    w = book[e] - rival
    return (rival * rival - book[e] * book[e] + 2 * np.where(w > 0, high * w, low * w)).sum(axis=1) < 0


def assign(points: Tree, entries: Tree, book: np.ndarray) -> Iterator[tuple[slice, np.ndarray | int, np.ndarray | None]]:
    """(places in the tree's order, entry or entries, sum of the points or None): whole nodes with one entry left, and leaves point by point."""
    at, e, level, deep = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    while deep < entries.depth:  # the entries' tree down to its leaves, for the whole chunk
        kept = ~_unlike(points, entries, (1 << level) - 1 + at, (1 << deep) - 1 + e)
        at, e = at[kept], e[kept]
        deep += 1
        at, e = np.repeat(at, 2), (2 * e[:, None] + np.arange(2)).ravel()
    lo, hi = entries.rows(deep, e)
    at = np.repeat(at, hi - lo)
    e = entries.order[np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])]
    while len(at):
        kept = ~_beaten(points, book, (1 << level) - 1 + at, e)
        at, e = at[kept], e[kept]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        sizes = np.diff(np.r_[starts, len(at)])
        alone = starts[sizes == 1]
        for node, entry, a, b in zip(at[alone], e[alone], *points.rows(level, at[alone]), strict=True):
            yield slice(a, b), entry, points.sums[(1 << level) - 1 + node]
        if level == points.depth:
            break
        more = np.repeat(sizes > 1, sizes)
        at, e = at[more], e[more]
        level += 1
        at, e = np.concatenate([2 * at, 2 * at + 1]), np.concatenate([e, e])
        order = np.argsort(at, kind="stable")
        at, e = at[order], e[order]
    else:
        return
    for start, size, a, b in zip(starts, sizes, *points.rows(level, at[starts]), strict=True):
        if size > 1:
            own = np.sort(e[start : start + size])  # of equal distances the first has the lowest index
            yield slice(a, b), own[((book[own] ** 2).sum(axis=1) - 2 * points.x[a:b] @ book[own].T).argmin(axis=1)], None


def _chunks(batches: Iterator[pa.RecordBatch], parts: int, chunk: int, leaf: int) -> Iterator[pa.RecordBatch]:
    """A row per chunk: ids, labels, and for each part position the tree's arrays as bytes."""
    held, n = [], 0

    def made(rows: pa.Table) -> pa.RecordBatch:
        ids, labels, vectors = (c.combine_chunks() for c in rows.columns)
        x = vectors.flatten().to_numpy().astype(np.float64).reshape(len(ids), parts, -1)
        whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        trees = [grow(x[:, p], leaf) for p in range(parts)]
        packed = lambda f: pa.array([[f(t).tobytes() for t in trees]], pa.list_(pa.binary()))
        small = [packed(lambda t, c=c: getattr(t, c).astype(np.int32)) for c in ("order", "x", "low", "high")]
        return pa.RecordBatch.from_arrays([whole(ids), whole(labels), *small, packed(lambda t: t.sums), pa.array([trees[0].depth], pa.int32())], ["ids", "labels", "orders", "points", "lows", "highs", "sums", "depth"])

    for b in batches:
        held.append(b)
        n += b.num_rows
        while n >= chunk:
            rows = pa.Table.from_batches(held)
            yield made(rows.slice(0, chunk))
            held, n = rows.slice(chunk).to_batches(), n - chunk
    if n:
        yield made(pa.Table.from_batches(held))


def _trees(row: dict, parts: int) -> list[Tree]:
    n = len(row["ids"])
    wide = lambda name, p: np.frombuffer(row[name][p], np.int32).astype(np.float64).reshape(-1, len(row["points"][p]) // 4 // n)
    return [Tree(np.frombuffer(row["orders"][p], np.int32), x := wide("points", p), wide("lows", p), wide("highs", p), np.frombuffer(row["sums"][p], np.int64).reshape(-1, x.shape[1]), row["depth"]) for p in range(parts)]


def _sums(chunks: DataFrame, books: np.ndarray) -> np.ndarray:
    """[parts, entries, 1 + places]: number and sum of the parts that each entry is nearest to."""
    parts, entries, width = books.shape
    doubles = books.astype(np.float64)
    grown = [grow(b, 1) for b in doubles]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, 1 + width), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                for p, points in enumerate(_trees(b.slice(i, 1).to_pylist()[0], parts)):
                    for at, entry, whole in assign(points, grown[p], doubles[p]):
                        if whole is not None:
                            total[p, entry, 0] += at.stop - at.start
                            total[p, entry, 1:] += whole
                        else:
                            np.add.at(total[p, :, 0], entry, 1)
                            np.add.at(total[p, :, 1:], entry, points.x[at].astype(np.int64))
        own = np.argwhere(total[:, :, 0] > 0)
        values = total[own[:, 0], own[:, 1]]
        columns = [pa.array(own[:, 0].astype(np.int32)), pa.array(own[:, 1].astype(np.int32)), *(pa.array(values[:, i]) for i in range(1 + width))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", *(f"v{i}" for i in range(1 + width))])

    names = [f"v{i}" for i in range(1 + width)]
    rows = chunks.select("ids", "orders", "points", "lows", "highs", "sums", "depth").mapInArrow(run, "part int, entry int, " + ", ".join(f"{v} long" for v in names))
    out = np.zeros((parts, entries, 1 + width), np.int64)
    for r in rows.groupBy("part", "entry").agg(*(F.sum(v).alias(v) for v in names)).collect():  # a row per entry
        out[r.part, r.entry] = r[2:]
    return out


def _coded(chunks: DataFrame, books: np.ndarray, label: str) -> DataFrame:
    """(vec_id, label, code, error) of every vector of the chunks."""
    parts, books = len(books), books.astype(np.float64)
    grown = [grow(b, 1) for b in books]
    labels = chunks.schema["labels"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                n = len(row.column("ids").flatten())
                code, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
                for p, points in enumerate(_trees(row.to_pylist()[0], parts)):
                    nearest = np.zeros(n, np.int64)
                    for at, entry, _ in assign(points, grown[p], books[p]):
                        nearest[at] = entry
                    code[points.order, p] = nearest
                    error[points.order] += ((points.x - books[p][nearest]) ** 2).sum(axis=1).astype(np.int64)
                text = code.tobytes().hex()
                codes = pa.array([text[j : j + 2 * parts] for j in range(0, len(text), 2 * parts)])
                yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), row.column("labels").flatten(), codes, pa.array(error)], ["vec_id", label, "code", "error"])

    return chunks.mapInArrow(run, f"vec_id long, {label} {labels.simpleString()}, code string, error long")


def fit(spark: SparkSession, kept: DataFrame, parts: int, entries: int, rounds: int) -> tuple[DataFrame | None, np.ndarray]:
    """(chunks, codebooks [parts, entries, places]) of rows (vec_id, label, vector array<long>); no chunks where there are no rows."""
    order = [F.col("vec_id").isNull(), F.col("vec_id"), F.col("vector")]
    first = kept.orderBy(*order).limit(entries).select("vector").collect()
    if not first:
        return None, np.zeros((parts, 0, 0), np.int64)
    width = len(first[0].vector)
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    kept = kept.where(F.size("vector") == width)
    if any(len(r.vector) != width for r in first):
        first = kept.orderBy(*order).limit(entries).select("vector").collect()
    books = np.array([r.vector for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    label = kept.schema["label"].dataType.simpleString()
    schema = f"ids array<long>, labels array<{label}>, orders array<binary>, points array<binary>, lows array<binary>, highs array<binary>, sums array<binary>, depth int"
    chunk, leaf = CHUNK, LEAF
    chunks = written(kept.select("vec_id", "label", "vector").mapInArrow(lambda batches: _chunks(batches, parts, chunk, leaf), schema), "vector-chunks")
    for _ in range(rounds):
        sums = _sums(chunks, books)
        used = sums[:, :, 0] > 0
        books[used] = sums[used][:, 1:] // sums[used][:, :1]  # rounds down
    return chunks, books


def vector_codes(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every row of rows (vec_id, embedding, label) with a whole vector.

    A component x counts as floor(scale * x). Each part position has a codebook that starts as the parts of the smallest vec_ids (null ids
    last, equal ones by vector), and `rounds` rounds assign all parts to their nearest entries and replace entries by floored means; unused
    entries stay. code has two hex digits per part, error is the squared distance left, label_error its sum over equal labels, nulls together.
    Vectors that are null, empty or have a null or non-finite component are left out, so are those of another length than that of
    the smallest vec_id; repeated rows and ids are rows like others; fewer than `entries` vectors give as many entries. A component of 2**18 / scale or more is an error
    ("too large"), as are lengths that parts do not divide. Other columns may have any names and are not returned; an empty table gives no rows.
    """
    spark = rows.sparkSession
    c = F.col("embedding")
    whole = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = lambda x: F.floor(F.when(F.abs(x.cast("double") * scale) < LARGEST, x.cast("double") * scale).otherwise(F.raise_error(F.lit("a component is too large")).cast("double")))
    kept = rows.where(F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(c, scaled).alias("vector"))
    chunks, books = fit(spark, kept, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    if chunks is None:
        none = kept.where("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none.withColumn("codebooks_sha256", F.lit(digest))
    coded = written(_coded(chunks, books, "label"), "vector-codes")
    discard(chunks)
    sums = coded.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("own")), "left")
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
