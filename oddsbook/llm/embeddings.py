"""Embedding near-duplicates: sign hashing by random hyperplanes in several tables, exact cosines, connected components.

A vector's code in a table is the signs of its products with k random hyperplanes; vectors at cosine c agree in a table
with probability p(c)^k, p(c) = 1 - acos(c)/pi. k grows with the logarithm of the number of vectors, so that buckets of
unlike vectors stay small, and the number of tables is what makes a pair at the threshold meet with the wanted
probability. Equal vectors are one row before.

The tables shuffle no vectors: a row has the code, the id and a sketch of SKETCH more signs. Vectors whose sketches differ in
far more bits than a pair at the threshold does (by five standard deviations) are no candidates; only vectors with some candidate
in a bucket are sent there. Buckets are cut into blocks of bounded size, and each pair of blocks of a bucket is a
task's unit of work, in which all cosines are computed by matrix products; a pair counts in the first table in which it
meets, so nothing needs to be listed pair by pair: a unit gives link counts per vector and edges that connect the linked vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsbook.llm.common import discard, written
from oddsbook.llm.components import connected_components

#: Vectors in a block of a bucket, vectors a bucket of unlike vectors has on average, and bits of a sketch.
BLOCK, PER_BUCKET, SKETCH = 2048, 256, 128
UNIT = ["dim", "t", "code", "x", "y"]


def tables_for(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a code, number of tables) for n vectors."""
    bits = max(4, min(30, math.ceil(math.log2(max(n, 1) / PER_BUCKET + 1))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def sketch_limit(threshold: float) -> int:
    """Bits in which the sketches of a pair at the threshold differ at most: the mean and five standard deviations."""
    share = math.acos(threshold) / math.pi
    return math.ceil(SKETCH * share + 5 * math.sqrt(SKETCH * share * (1 - share)))


def _valid(c):
    """Vectors that can have links: not null, not zero, every component there and finite."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return c.isNotNull() & finite & F.exists(c, lambda x: x != 0)


def _codes(vectors: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """vectors with the array codes, one code per table, and a sketch in two longs; hyperplanes are drawn from the seed for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            ends, flat = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy(zero_copy_only=False)
            rows = [flat[x:y].astype(np.float64) for x, y in zip(ends[:-1], ends[1:], strict=True)]
            codes: list = [None] * len(rows)
            sketches = np.zeros((len(rows), 2), np.int64)
            for dim in {len(v) for v in rows}:
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits + SKETCH))
                own = [i for i, v in enumerate(rows) if len(v) == dim]
                block = np.stack([rows[i] for i in own])
                block /= np.abs(block).max(axis=1, keepdims=True)
                signs = block @ planes[dim] > 0
                sketches[own] = np.packbits(signs[:, tables * bits :], axis=1).view(np.int64)
                for i, code in zip(own, signs[:, : tables * bits].reshape(len(own), tables, bits) @ weights, strict=True):
                    codes[i] = code
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.list_(pa.int32())), pa.array(sketches[:, 0]), pa.array(sketches[:, 1])], ["id", "vector", "n", "codes", "s1", "s2"])

    return vectors.mapInArrow(run, f"id long, vector {dict(vectors.dtypes)['vector']}, n long, codes array<int>, s1 long, s2 long")


def _by_unit(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table, np.ndarray, list[int]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Calls work with stretches of whole units from rows sorted by unit: the rows, their units' columns and where units begin and end."""
    held: list[pa.RecordBatch] = []

    def heads(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
        return np.stack([rows.column(c).to_numpy() for c in UNIT])

    def out() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        own = heads(rows)
        return work(rows, own, [0, *(np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1).tolist(), rows.num_rows])

    for b in batches:
        keys = heads(b)
        new = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
        cut = int(new[-1]) + 1 if len(new) else 0
        if held and len(new) or cut:  # the last unit of the batch may go on in the next
            held.append(b.slice(0, cut))
            yield out()
            held = []
        held.append(b.slice(cut))
    if held:
        yield out()


def _near_sketches(s: np.ndarray, low: np.ndarray, high: np.ndarray, limit: int) -> np.ndarray:
    """Which rows of a unit have a sketch of the other block (or another one of their own) within limit bits."""
    found = np.zeros(len(s), bool)
    a, b = np.flatnonzero(low), np.flatnonzero(high)
    for at in range(0, len(a), 256):
        part = a[at : at + 256]
        near = (np.bitwise_count(s[part, None, 0] ^ s[None, b, 0]) + np.bitwise_count(s[part, None, 1] ^ s[None, b, 1])) <= limit
        near &= part[:, None] != b[None, :]
        found[part] |= near.any(axis=1)
        found[b] |= near.any(axis=0)
    return found


def _joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """root, the least place of each place's tree, after the trees of the pairs of places (x, y) are joined."""
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            return root
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root != (up := root[root])).any():
            root = up


def _unit_links(ids: np.ndarray, vectors: np.ndarray, n: np.ndarray, codes: np.ndarray, table: int, low: np.ndarray, high: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """What one pair of blocks gives: link counts by row, and for each row the smallest id that its new links reach, over other rows too."""
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    order = np.argsort(ids, kind="stable")
    place = np.empty_like(order)
    place[order] = root
    a, b = np.flatnonzero(low), np.flatnonzero(high)
    close = vectors[a] @ vectors[b].T >= threshold
    if a is b or np.array_equal(a, b):
        close &= ~np.eye(len(a), dtype=bool)
        both = False
    else:
        both = True
    i, j = np.nonzero(close)
    for at in range(0, len(i), 1 << 18):
        x, y = a[i[at : at + (1 << 18)]], b[j[at : at + (1 << 18)]]
        new = ~(codes[x, :table] == codes[y, :table]).any(axis=1)
        x, y = x[new], y[new]
        np.add.at(links, x, n[y])
        if both:
            np.add.at(links, y, n[x])
        root = _joined(root, place[x], place[y])
    return links, ids[order[root[place]]]


def _links(coded: DataFrame, tables: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, links, least): partial link counts of distinct vectors, and the smallest id that the links of a unit connect them with; (id, least) span its links.
    With it come the tables written for it."""
    placed = coded.select("id", "s1", "s2", F.posexplode("codes").alias("t", "code"), F.size("vector").alias("dim"))
    key = ["dim", "t", "code"]
    sizes = written(placed.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1").withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int")), "bucket-sizes")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y")))
    units = placed.join(sizes, key).withColumn("block", block).withColumn("pair", F.explode(pairs))
    units = units.select(*key, "pair.x", "pair.y", "block", "id", "s1", "s2").repartition(*UNIT).sortWithinPartitions(*UNIT)
    limit = sketch_limit(threshold)

    def sift(rows: pa.Table, heads: np.ndarray, cuts: list[int]) -> pa.RecordBatch:
        block, s = rows.column("block").to_numpy(), np.stack([rows.column("s1").to_numpy(), rows.column("s2").to_numpy()], axis=1).view(np.uint64)
        some = np.zeros(rows.num_rows, bool)
        for lo, hi in pairwise(cuts):
            own = block[lo:hi]
            some[lo:hi] = _near_sketches(s[lo:hi], own == heads[3, lo], own == heads[4, lo], limit)
        kept = rows.select([*UNIT, "block", "id"]).filter(pa.array(some)).combine_chunks()
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in kept.columns], kept.schema.names)

    sifted = units.mapInArrow(lambda batches: _by_unit(batches, sift), "dim int, t int, code int, x int, y int, block int, id long")
    candidates = written(sifted, "vector-candidates")
    dealt = candidates.join(coded.select("id", "vector", "n", "codes"), "id").select(*UNIT, "block", "id", "vector", "n", "codes").repartition(*UNIT).sortWithinPartitions(*UNIT)

    def work(rows: pa.Table, heads: np.ndarray, cuts: list[int]) -> pa.RecordBatch:
        ids, n, block = (rows.column(c).to_numpy() for c in ("id", "n", "block"))
        links, least = np.zeros(len(ids), np.int64), ids.copy()
        codes = rows.column("codes").combine_chunks().flatten().to_numpy().reshape(len(ids), tables)
        flat, at = rows.column("vector").combine_chunks().flatten().to_numpy(), np.cumsum([0, *heads[0].tolist()])
        for lo, hi in pairwise(cuts):
            if hi - lo < 2:
                continue
            v = flat[at[lo] : at[hi]].reshape(hi - lo, -1).astype(np.float64)
            v /= np.abs(v).max(axis=1, keepdims=True)
            v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
            own = block[lo:hi]
            links[lo:hi], least[lo:hi] = _unit_links(ids[lo:hi], v, n[lo:hi], codes[lo:hi], int(heads[1, lo]), own == heads[3, lo], own == heads[4, lo], threshold)
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(least[some])], ["id", "links", "least"])

    return dealt.mapInArrow(lambda batches: _by_unit(batches, work), "id long, links long, least long"), sizes, candidates


def near_vectors(rows: DataFrame, threshold: float = 0.9, recall: float = 0.998, seed: int = 17) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of rows (vec_id, embedding), whatever its other columns.

    n_links counts the other rows whose cosine, in double precision, is threshold or more; a pair at the threshold is found
    with probability `recall`, closer pairs with more, and none below it is. component_id is the smallest vec_id that links
    reach, itself included; kept is vec_id = component_id. Vectors that are null, empty, zero or have a null or
    non-finite component link with nothing; vectors of different length do not link. Rows of equal vectors are rows.
    Rows with a null vec_id link with nothing either, as in the query's SQL: no links, and component_id and kept are null.
    """
    component = "float" if dict(rows.dtypes)["embedding"] == "array<float>" else "double"
    vector = F.transform("embedding", lambda x: x.cast(component) + F.lit(0.0).cast(component))  # -0.0 becomes 0.0
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    linked = F.col("vec_id").isNotNull() & F.coalesce(_valid(F.col("vector")), F.lit(False))
    valid = rows.where(linked)
    distinct = written(valid.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).select("id", "vector", "n"), "vectors")
    n = distinct.count()
    bits, tables = tables_for(n, threshold, recall)
    coded = written(_codes(distinct, bits, tables, seed), "coded")
    found, *parts = _links(coded, tables, threshold)
    links = written(found, "vector-links")
    discard(coded, *parts)
    counts = written(links.groupBy("id").agg(F.sum("links").alias("links")), "vector-counts")
    joined = written(connected_components(links.select(F.col("id").alias("a"), F.col("least").alias("b"))), "vector-components")
    known = distinct.join(counts, "id", "left").join(joined, distinct.id == joined.node, "left")
    known = written(known.select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")), "vector-known")
    discard(distinct, links, counts, joined)
    found = valid.join(known, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where(~linked).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
