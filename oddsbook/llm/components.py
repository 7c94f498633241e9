"""Connected components of an undirected graph, by alternating large-star and small-star steps on edge tables.

No neighbourhood is gathered into one row or task: each step is a minimum per node (combined before the shuffle) joined
back to the edges. The minima are written first, so that both sides of the join are plain exchanges and Spark can split
the partitions of a node with very many edges. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsbook.llm.common import delete, work_path


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


class _Kept:
    """Tables of one run of rounds, each written to the shared folder; those that no later step reads are deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.paths.append(work_path(self.spark, "components"))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop_all_but_last(self) -> None:
        for path in self.paths[:-1]:
            delete(self.spark, path)
        self.paths = self.paths[-1:]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node that can be reached.

    Edges may repeat, run either way and join a node to itself (a node that only does that is left out, as are edges
    with a null end); no edges give no rows.
    """
    kept = _Kept(edges.sparkSession)
    edges = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    while before[0]:
        both = _both_ways(edges)
        least = kept(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = kept(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = kept(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = kept(small)
        kept.drop_all_but_last()
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
