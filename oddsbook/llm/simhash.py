"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at most 2r bits apart share a value within r bits of both. So every distinct fingerprint emits
its ball of radius r (itself and each value one bit away: 65 values for r = 1), the values are shuffled, and the
fingerprints that meet at a value are the candidates. A value has at most 65 fingerprints of radius 1, whatever the
data hold, so no bucket can grow; equal fingerprints are one row before the balls are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsbook.llm.common import small_batches
from oddsbook.llm.components import connected_components

#: A fingerprint is summed over so many shingles at a time, which bounds the memory of a very long text.
_STEP = 1 << 15


def fingerprint(text: bytes | None, words_in_shingle: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a text: a bit is 1 if it is set in over half the XXH64 values of its word shingles.

    A-Z are lower-cased, words are runs without ASCII blanks, shingles count as often as they occur; a shorter text has
    one shingle of all its words, and null or blank texts have fingerprint 0.
    """
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - words_in_shingle + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(words_in_shingle)), strict=False)) if len(words) >= words_in_shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), dtype="<u8", count=n)
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _STEP):
        bits += np.unpackbits(hashes[at : at + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row of docs; a narrow step over whole texts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in texts], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def near_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints of the column fp that connect all those at most 2 bits apart.

    Fingerprints that meet at a value are all within 1 bit of it and thus within 2 of each other; one link from the
    smallest to each of the others keeps them connected without listing all pairs. Each link is verified.
    """
    if radius != 2:
        raise ValueError("balls of radius 1 meet for fingerprints at most 2 bits apart; other radii are not offered")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(v).cast("long") for v in [1 << i for i in range(63)] + [-(1 << 63)]))
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = prints.select("fp").distinct().repartition(tasks, F.xxhash64("fp"))  # so that the balls, 65 rows for one, are made in as many tasks
    balls = dealt.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    met = balls.groupBy("value").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    links = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()
    return links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def simhash_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint hex, component_id) of every row of docs; component_id is the smallest doc_id of its group.

    Rows with a null doc_id keep their fingerprint and belong to the group of the fingerprint; a group whose ids are all null
    has a null component_id. Repeated rows are rows of one group. An empty table gives none.
    """
    from oddsbook.llm.common import discard, written

    prints = written(fingerprints(docs), "simhash")
    least = written(prints.groupBy("fp").agg(F.min("doc_id").alias("doc")), "simhash-distinct")
    joined = written(connected_components(near_links(least)), "simhash-components")
    rooted = least.join(joined, least.fp == joined.node, "left").select("fp", "doc", F.coalesce("component", "fp").alias("root"))
    rooted = written(rooted, "simhash-rooted")
    discard(least, joined)
    first = written(rooted.groupBy("root").agg(F.min("doc").alias("component_id")), "simhash-first")
    named = written(rooted.join(first, "root").select("fp", "component_id"), "simhash-named")
    discard(rooted, first)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
