"""Exact dedup by a stateful stream: keyed state on disk, without expiry, and full bytes compared on every hit.

Files of documents are read as a stream. The state has one row per digest of a text, kept in RocksDB with its checkpoint in the shared
folder and never expired: the stable identifier of the document that stays (the largest doc_id), the locator of its content (file
and row in the file) and the number of documents. Rows of one digest are combined before the shuffle, so a text that a third of all rows have
is one row per task. A later call with the same checkpoint reads only files it has not seen, and goes on from the state.

A digest that more than one document has is a hit. The state's locators give the contents that stay, and the bytes of every hit are compared with them, each distinct
text of a task once. Texts that differ in spite of their digest are classes of their own, so that no result rests on the digest.
Everything is columns and stream aggregation; no Python runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsbook.llm.common import delete, settings, work_path

SCHEMA = "doc_id long, text string"
#: The state store on disk, with bounded memory for all the partitions that an executor has and no disk reserved beyond what they hold.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _any(path: str) -> str:
    """A pattern that only path itself fits: a stream takes a single file by a pattern, a folder either way."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def _rows(source: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    return source.select("doc_id", body.alias("body"), digest(body).alias("digest"), F.struct(F.col("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"))


def retained(spark: SparkSession, path: str, checkpoint: str, digest: Callable[[Column], Column] = sha256, batch_bytes: int | None = None) -> DataFrame:
    """(digest, keep, n) of all documents that the stream with this checkpoint has seen, after it has read the new files at path.

    keep is (doc_id, file, row) of the document that stays, n the number of documents. batch_bytes bounds the files of one
    micro-batch; without it all new files are one. The stream's shuffle partitions are those of its first call.
    """
    reader = spark.readStream.schema(SCHEMA)
    if batch_bytes:
        reader = reader.option("maxBytesPerTrigger", batch_bytes)
    state = _rows(reader.parquet(_any(path)), digest).groupBy("digest").agg(F.max("at").alias("keep"), F.count("*").alias("n"))
    with settings(spark, STORE):
        stream = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        stream.awaitTermination()
        held = spark.read.format("statestore").load(checkpoint)
    return held.select(F.col("key.digest").alias("digest"), F.col("value.max").alias("keep"), F.col("value.count").alias("n"))


def exact_dedup(spark: SparkSession, path: str, checkpoint: str | None = None, digest: Callable[[Column], Column] = sha256, batch_bytes: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, file, row) of every row of the Parquet file or folder at path.

    Texts are equal when all their bytes are; null is the empty text, very long texts are taken whole. Of equal texts the row with the
    largest doc_id stays; of rows that share it, the last by file and place in it, so that exactly one row of a class is kept. A null doc_id
    is below all others, and keep_id is null where no row of the class has one. Only doc_id and text are read, whatever other columns there are; an empty
    table gives no rows. With a checkpoint of earlier calls only new files go through the stream; the files of those calls must still be there.
    """
    seen = retained(spark, path, checkpoint or work_path(spark, "exact-state"), digest, batch_bytes)
    hits = seen.where("n > 1").hint("merge")  # these grow with the corpus
    rows = _rows(spark.read.schema(SCHEMA).parquet(_any(path)), digest).withColumn("sha", F.sha2("body", 256))
    placed_at, odd_at = work_path(spark, "exact-placed"), work_path(spark, "exact-collisions")
    joined = rows.join(hits, "digest", "left")
    joined.select("digest", "sha", "at", "keep", "n", F.when(F.col("n").isNotNull(), F.col("body")).alias("body")).write.parquet(placed_at)
    placed = spark.read.parquet(placed_at)

    found = placed.where("n IS NOT NULL")
    kept = found.where("at = keep").select("digest", F.col("body").alias("content")).hint("merge")
    texts = found.groupBy("digest", "body").agg(F.max("at").alias("own_keep"), F.count("*").alias("own_n"))
    texts.join(kept, "digest").where("body <> content").drop("content").write.parquet(odd_at)
    odd = spark.read.parquet(odd_at)
    if odd.isEmpty():
        delete(spark, odd_at)
        out = placed
    else:
        left = odd.groupBy("digest").agg(F.sum("own_n").alias("less"))
        out = placed.join(left.hint("merge"), "digest", "left").join(odd.hint("merge"), ["digest", "body"], "left")
        out = out.withColumns({"keep": F.coalesce("own_keep", "keep"), "n": F.coalesce(F.col("own_n"), F.col("n") - F.coalesce("less", F.lit(0)))})
    keep = F.coalesce("keep", "at")
    return out.select(F.col("at.doc_id").alias("doc_id"), keep["doc_id"].alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (keep == F.col("at")).alias("kept"), F.col("sha").alias("text_sha256"), "at.file", "at.row")
