"""Race files: one Parquet file per race, one row per snapshot, a block of columns run[i].* per runner."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsbook.operators.quotes import FIELDS, SLOTS

CARD = ["event_name", "venue", "market_id", "race_type", "race_name", "event_id", "country_code", "race_distance", "race_class", "race_number", "meeting_name", "race_time"]
SNAPSHOT = {"ts_unix": T.LongType(), "runner_count": T.IntegerType(), "commission_rate": T.DoubleType(), "in_play": T.IntegerType(), "market_status": T.StringType(), "secs_to_off": T.DoubleType(), "total_matched_market": T.DoubleType(), "prob_entropy": T.DoubleType(), "result_closed": T.IntegerType(), "result_winner_idx_first": T.DoubleType(), "result_winner_selids": T.StringType(), "market_time": T.TimestampType()}


def race_schema(types: dict[str, T.DataType] | None = None) -> T.StructType:
    """All columns a race file may have, for all 24 slots; a file's missing columns are read as null, without merging schemas.

    types are those in which the files store their columns; a runner column takes that of the same field of the first runner.
    """
    types = types or {}
    own = SNAPSHOT | dict.fromkeys(CARD, T.StringType())
    fields = [T.StructField(n, types.get(n, t)) for n, t in own.items()]
    of = lambda i, f: types.get(f"run[{i}].{f}", types.get(f"run[0].{f}", T.DoubleType()))
    return T.StructType([*fields, *(T.StructField(f"run[{i}].{f}", of(i, f)) for i in range(SLOTS) for f in FIELDS)])


def stored_types(spark: SparkSession, directory: str) -> dict[str, T.DataType]:
    """The column types of one file of the directory, by its footer; none if that file cannot be read."""
    try:
        return {f.name: f.dataType for f in spark.read.option("pathGlobFilter", "*.parquet").parquet(directory).schema}
    except (AnalysisException, Py4JJavaError):
        return {}


def scan_snapshots(spark: SparkSession, directory: str, types: dict[str, T.DataType] | None = None) -> DataFrame:
    """All race files of a directory with `file`; a column market_id in them is kept as source_market_id.

    Files store their columns in the given types, or in those of one of them; the result has the types of SNAPSHOT, and doubles for
    runner columns. Files that cannot be read, also for other types, give no rows; quarantine_files names them.
    """
    schema = race_schema(stored_types(spark, directory) if types is None else types)
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", True).option("pathGlobFilter", "*.parquet").parquet(directory)
    wanted = SNAPSHOT | dict.fromkeys(CARD, T.StringType())
    cast = lambda f: F.col(f"`{f.name}`").cast(wanted.get(f.name, T.DoubleType())).alias(f.name)
    rows = rows.select(*map(cast, schema), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    return rows.withColumnRenamed("market_id", "source_market_id")


def quarantine_files(spark: SparkSession, directory: str, rows: DataFrame) -> DataFrame:
    """(file, reason) of the files in the directory that gave no row of rows; only their names are listed."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(directory).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return listed.join(rows.select("file").distinct(), "file", "left_anti").withColumn("reason", F.lit("read_error"))


def read_report(spark: SparkSession, directory: str, types: dict[str, T.DataType] | None = None) -> DataFrame:
    """(file, n_rows, n_read, reason) of every file of the directory: rows by its footer, rows that can be read with all their columns, and why it is not whole.

    Every column is read once. reason is null for a file that is whole, read_in_part for one that gave fewer rows than its footer says (a damaged row group, or
    columns stored in other types), no_rows for a Parquet file without rows, and read_error for one whose footer cannot be read (n_rows is null then). Paths of
    files without any row pass through the driver, to look at their first and last bytes.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(directory).select("path", F.element_at(F.split("path", "/"), -1).alias("file"))
    source = spark.read.schema(race_schema()).option("ignoreCorruptFiles", True).option("pathGlobFilter", "*.parquet").parquet(directory)
    footers = source.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n_rows"))  # no column is read
    rows = scan_snapshots(spark, directory, types)
    values = F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns))
    read = rows.groupBy("file").agg(F.count("*").alias("n_read"), F.bit_xor(values).alias("__all")).select("file", F.when(F.col("__all").isNotNull(), F.col("n_read")).alias("n_read"))
    found = listed.join(footers, "file", "left").join(read, "file", "left")
    paths = [r.path for r in found.where("n_rows IS NULL").select("path").collect()]
    magic = F.lit(b"PAR1")
    ends = (F.substring("content", 1, 4) == magic) & (F.substring("content", -4, 4) == magic) & (F.col("length") >= 12)
    empty = (spark.read.format("binaryFile").load(paths) if paths else spark.read.format("binaryFile").load(directory).where("false")).where(ends).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.lit(True).alias("__empty"))
    why = F.when(F.col("__empty"), "no_rows").when(F.col("n_rows").isNull(), "read_error").when(F.coalesce("n_read", F.lit(0)) < F.col("n_rows"), "read_in_part")
    return found.join(empty, "file", "left").select("file", F.when(F.col("__empty"), F.lit(0)).otherwise(F.col("n_rows")).alias("n_rows"), F.coalesce("n_read", F.lit(0)).alias("n_read"), why.alias("reason"))


def whole_snapshots(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The rows of the files that read_report found whole: a file that was read in part gives none."""
    return rows.join(report.where("reason IS NOT NULL").select("file"), "file", "left_anti").select(*(F.col(f"`{c}`") for c in rows.columns))


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """The files that an inspection table (file, is_suitable) calls suitable, each once."""
    rows = spark.read.option("header", True).schema("file string, is_suitable string").csv(path)
    return whitelist(rows)


def whitelist(rows: DataFrame) -> DataFrame:
    return rows.where(F.trim("is_suitable") == "True").select("file").distinct()
