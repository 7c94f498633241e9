"""Numbers over a whole table without sending it through one task: range partitions, a count of each, and sums of the counts before it."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsbook.sources.work import work_path

#: monotonically_increasing_id has the row's number in its partition below this bit, and the partition's above it.
_ROW_BITS = 33


def numbered(rows: DataFrame, order: list[Column], name: str = "place", start: int = 1) -> DataFrame:
    """rows with a column `name`: start, start + 1, ... in the given order, which should have no ties (tied rows are numbered in any order).

    Rows are dealt by ranges of the order and sorted within them, and written once to the shared folder with their number in their partition, as another
    run would draw other ranges. What the driver sees is one count per partition. A null comes where the order has it; an empty table gives no rows.
    """
    spark = rows.sparkSession
    path = work_path(spark, "numbered")
    at = F.monotonically_increasing_id()
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at).write.parquet(path)
    dealt = spark.read.parquet(path)
    part = F.shiftright("__at", _ROW_BITS)
    counts = sorted((r.part, r.n) for r in dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row per partition
    before = dict(zip((p for p, _ in counts), accumulate([0, *(n for _, n in counts)]), strict=False))
    offsets = spark.createDataFrame([(p, n + start) for p, n in before.items()], "__part long, __before long")
    nth = F.col("__at").bitwiseAND((1 << _ROW_BITS) - 1)
    joined = dealt.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # as many rows as partitions
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns if c != name), (F.col("__before") + nth).alias(name))
