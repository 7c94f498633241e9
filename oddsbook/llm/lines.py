"""Line dedup over levelled sorted runs of line hashes.

The keys of a batch of documents are hashed and counted within the batch. The batch is merge-anti-joined with the runs:
keys that some run already knows to be common, with a keeper at least as large, need no new entry. The rest is written as a sorted
run of its own on the lowest level; when a level holds `fanout` runs they are merged into one run of the next. Runs hold one row per
key, (h1, h2, n_docs, keeper), so a line that a third of all documents share is one row.

A run is a table bucketed and sorted by its key, all with the same number of buckets and one file a bucket: a merge join reads it without
an exchange or a sort, and only the batch is dealt out. Which runs there are is kept in a small table beside them, so that a later call
can open the store and add to it. Batches of one call go from the largest doc_id down; so most keepers are known when a key becomes common.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsbook.llm.common import BLANKS, ascii_lower, delete, work_path, written

KEY = ["h1", "h2"]
#: The doc_id that stands for a null one, below all others.
NO_ID = -(1 << 63)


class LineRuns:
    """A store of sorted runs at path. add() takes key counts of a batch, common() returns the keys found in min_docs documents.

    Setting it up turns on spark.sql.legacy.bucketedTableScan.outputOrdering for the session, by which Spark trusts the order of sorted buckets.
    """

    def __init__(self, spark: SparkSession, path: str, min_docs: int = 3, fanout: int = 3, buckets: int | None = None):
        self.spark, self.path, self.min_docs, self.fanout = spark, path, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.version = 0
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineRuns:
        """The store that earlier calls, of this or another session, left at path."""
        listed = spark.read.parquet(f"{path}/list")
        last = listed.agg(F.max("version")).first()[0]
        rows = listed.where(F.col("version") == last).collect()
        store = cls(spark, path, rows[0].min_docs, rows[0].fanout, rows[0].buckets)
        store.version = last
        for r in sorted(rows, key=lambda r: (r.level, r.place)):
            store.levels += [[] for _ in range(r.level + 1 - len(store.levels))]
            if r.run:
                store.levels[r.level].append(r.run)
                spark.sql(f"CREATE TABLE IF NOT EXISTS {r.run} (h1 BIGINT, h2 BIGINT, n_docs BIGINT, keeper BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {store.buckets} BUCKETS LOCATION '{path}/{r.run}'")
        return store

    def _list(self) -> None:
        """Writes the list of runs under a new version."""
        self.version += 1
        rows = [(level, i, run, self.min_docs, self.fanout, self.buckets) for level, own in enumerate(self.levels) for i, run in enumerate(own)] or [(0, 0, None, self.min_docs, self.fanout, self.buckets)]
        self.spark.createDataFrame(rows, "level int, place int, run string, min_docs int, fanout int, buckets int").coalesce(1).write.parquet(f"{self.path}/list/version={self.version}")

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(run) for level in self.levels for run in level]

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.select(*KEY, "n_docs", "keeper").repartition(self.buckets, *KEY).sortWithinPartitions(*KEY)

    def _merge(self, runs: list[str]) -> DataFrame:
        """One row per key of the runs, dealt as runs are. They are read as plain files: Spark 4.1 takes a union of scans by bucket
        for dealt by bucket, though it is not, and would group it as it lies."""
        rows = self.spark.read.schema("h1 long, h2 long, n_docs long, keeper long").parquet(*(f"{self.path}/{run}" for run in runs))
        return rows.repartition(self.buckets, *KEY).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def _put(self, level: int, rows: DataFrame) -> None:
        """Writes rows as a sorted run, and compacts the level when it is full; the runs it was made from are deleted."""
        run = f"line_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/{run}").saveAsTable(run)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merge(full).sortWithinPartitions(*KEY))
            for r in full:
                self.spark.sql(f"DROP TABLE {r}")
                delete(self.spark, f"{self.path}/{r}")

    def fresh(self, counts: DataFrame) -> DataFrame:
        """The rows of counts that the runs do not make needless, dealt and sorted as runs are."""
        out = self._dealt(counts).alias("b")
        for run in self.runs():
            known = run.where(F.col("n_docs") >= self.min_docs).select(*KEY, "keeper").hint("merge").alias("r")
            out = out.join(known, (F.col("b.h1") == F.col("r.h1")) & (F.col("b.h2") == F.col("r.h2")) & (F.col("r.keeper") >= F.col("b.keeper")), "left_anti").alias("b")
        return out

    def add(self, counts: DataFrame) -> None:
        """Adds the keys of a batch, (h1, h2, n_docs, keeper), one row per key."""
        self._put(0, self.fresh(counts).select(*KEY, "n_docs", "keeper"))
        self._list()

    def drop(self) -> None:
        """Deletes the store: the tables of its runs and its folder."""
        for run in (run for level in self.levels for run in level):
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        delete(self.spark, self.path)
        self.levels = []

    def common(self) -> DataFrame:
        """(h1, h2, keeper) of the keys that min_docs or more documents have."""
        return self._merge([run for level in self.levels for run in level]).where(F.col("n_docs") >= self.min_docs).select(*KEY, "keeper")


def line_key(line: Column) -> Column:
    """What makes lines equal: ASCII blanks stripped at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_dedup(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4, fanout: int = 3, store: LineRuns | None = None, counts: bool = True) -> DataFrame:
    """docs without the lines whose key has min_chars or more code points and is in min_docs or more documents, save in the largest doc_id that has it.

    Returns every row and column of docs with text replaced, and n_lines and n_dropped appended (columns of these names
    are replaced; without `counts` only text changes). A null or empty text is one empty line and comes back as "". Very long texts are taken whole,
    in time in proportion to their lines. Rows are documents: repeated rows
    count as so many documents, and all rows of the keeper's doc_id keep the line. A null doc_id is below all others. Other columns
    may be null and have any names; an empty table gives none. With a store, documents that it knows from earlier calls count as
    well, and those of this call are added to it (min_docs and fanout are the store's then).
    """
    spark = docs.sparkSession
    doc, body = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body")
    rows = docs.select(doc, body)
    shares = [i / batches for i in range(1, batches)]
    bounds = (rows.agg(F.percentile_approx("doc", shares, 1000)).first()[0] or []) if shares else []
    batch = sum((F.when(F.col("doc") < b, 1).otherwise(0) for b in bounds), F.lit(0))
    hashes = [F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2")]
    keyed = F.transform(F.split("body", "\n"), line_key)
    keys = rows.select(batch.alias("batch"), "doc", F.explode(F.array_distinct(F.filter(keyed, lambda k: F.length(k) >= min_chars))).alias("key"))
    path = work_path(spark, "line-counts")
    keys.select("batch", "doc", *hashes).groupBy("batch", *KEY).agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper")).write.partitionBy("batch").parquet(path)
    counted = spark.read.schema("h1 long, h2 long, n_docs long, keeper long, batch int").parquet(path)
    runs = store or LineRuns(spark, work_path(spark, "line-runs"), min_docs, fanout)
    for i in range(batches):
        runs.add(counted.where(F.col("batch") == i))
    delete(spark, path)
    common = written(runs.common(), "line-common")
    if store is None:
        runs.drop()

    lines = rows.select("doc", F.xxhash64("body").alias("hash"), F.posexplode(keyed).alias("at", "key")).where(F.length("key") >= min_chars)
    dropped = lines.select("doc", "hash", "at", *hashes).join(common, KEY).where("doc <> keeper").groupBy("doc", "hash").agg(F.collect_set("at").alias("drop"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), doc, body)
    joined = whole.withColumn("hash", F.xxhash64("body")).join(dropped, ["doc", "hash"], "left")
    split = F.split("body", "\n")
    left = lambda parts: F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("drop"))
    kept = F.get(F.transform(F.array(split), lambda parts: F.array_join(F.transform(left(parts), lambda i: F.get(parts, i)), "\n")), F.lit(0))  # a text is split once, as a bound variable
    new = {"text": F.when(F.col("drop").isNull(), F.col("body")).otherwise(kept)}
    if counts:
        new |= {"n_lines": F.size(split), "n_dropped": F.coalesce(F.size("drop"), F.lit(0))}
    names = [*docs.columns, *(c for c in new if c not in docs.columns)]
    return joined.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in names))
