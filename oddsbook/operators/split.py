"""Splits of race files by date, without overlap in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsbook.config import DEFAULT, Config
from oddsbook.operators.ranking import numbered

#: A date in a file name; the fixed pattern of the archive.
DATE_PATTERN = r"(20\d{2})[-_]?(\d{2})[-_]?(\d{2})"


def race_date(file: Column) -> Column:
    """The date in a file name; null where there is none or it is no date."""
    parts = [F.regexp_extract(file, DATE_PATTERN, i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd"))


def file_dates(snapshots: DataFrame, source: str, order: str = "step") -> DataFrame:
    """(file, race_date), a row a file, by its name (source filename), its first row's market_time (column) or the time it was modified
    (modified), in the session's time zone; null where that is missing.
    """
    if source == "filename":
        return snapshots.select("file").distinct().withColumn("race_date", race_date(F.col("file")))
    if source not in ("column", "modified"):
        raise ValueError(f"unknown source of dates: {source}")
    first = F.min_by(F.struct("market_time"), order)["market_time"] if source == "column" else F.min("modified")
    return snapshots.groupBy("file").agg(first.cast("date").alias("race_date"))


def temporal_split(files: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """files with race_date and split: train or validation by period (ends included), undated, or null outside both. Files that have a
    race_date already (file_dates) keep it, others get that of their name.
    """
    rows = files if "race_date" in files.columns else files.withColumn("race_date", race_date(F.col("file")))
    period = lambda p: F.col("race_date").between(F.lit(p[0]).cast("date"), F.lit(p[1]).cast("date"))
    return rows.withColumn("split", F.when(F.col("race_date").isNull(), "undated").when(period(config.train_period), "train").when(period(config.validation_period), "validation"))


def validation_order(split: DataFrame) -> DataFrame:
    """Validation files in time order, then by name, numbered from 1."""
    return numbered(split.where("split = 'validation'").select("file", "race_date"), [F.col("race_date"), F.col("file")])


def _shuffled(files: DataFrame, seed: int, last_first: bool = False) -> DataFrame:
    """(file, place) in the order of a hash with the seed."""
    key, file = F.md5(F.concat(F.lit(f"{seed}:"), F.col("file"))), F.col("file")
    rows = files.select("file", key.alias("__key"))
    order = [F.desc("__key"), file.desc()] if last_first else [F.col("__key"), file]
    return numbered(rows, order).drop("__key")


def train_shuffle(split: DataFrame, seed: int = 42) -> DataFrame:
    """Training files in an order that a hash with the seed gives: the same on every run."""
    return _shuffled(split.where("split = 'train'"), seed)


def tail_split(files: DataFrame, n_validation: int = 100, seed: int = 42) -> DataFrame:
    """The older rule: shuffle, and the last n files are for validation."""
    return _shuffled(files, seed, last_first=True).select("file", F.when(F.col("place") <= n_validation, "validation").otherwise("train").alias("split"))


def leak_check(split: DataFrame) -> DataFrame:
    """One row: the last training date, the first validation date, and whether they are in order (or one is missing)."""
    ends = split.agg(F.max(F.when(F.col("split") == "train", F.col("race_date"))).alias("last_train"), F.min(F.when(F.col("split") == "validation", F.col("race_date"))).alias("first_validation"))
    return ends.withColumn("no_leak", F.coalesce(F.col("last_train") < F.col("first_validation"), F.lit(True)))


def temporal_folds(files: DataFrame, periods: DataFrame) -> DataFrame:
    """(..., race_date, fold, split): files by a table of periods (fold, split, first, last), both ends included.

    Folds may overlap: a file has a row for each period that its date is in, and one with null fold and split "undated" where it has no date; files of
    no period are left out. Files that have a race_date already keep it, others get that of their name. A period is dealt out by its days, so the join is on the date.
    """
    rows = files if "race_date" in files.columns else files.withColumn("race_date", race_date(F.col("file")))
    days = periods.where("first <= last").select("fold", "split", F.explode(F.sequence("first", "last")).alias("race_date")).distinct()
    names = [*(c for c in rows.columns if c not in ("race_date", "fold", "split")), "race_date", "fold", "split"]
    undated = rows.where("race_date IS NULL").withColumns({"fold": F.lit(None).cast(periods.schema["fold"].dataType), "split": F.lit("undated")})
    return rows.drop("fold", "split").join(days, "race_date").select(names).unionByName(undated.select(names))


def fold_leaks(folds: DataFrame) -> DataFrame:
    """For every pair of a fold's training and a fold's validation: the last training date, the first validation date, the number of files in both, and no_leak, whether
    dates are in order (or one is missing). The folds, a row each, are paired in one row; the files are not.
    """
    date = lambda name, f: f(F.when(F.col("split") == name, F.col("race_date")))
    ends = folds.where("fold IS NOT NULL").groupBy("fold").agg(date("train", F.max).alias("last_train"), date("validation", F.min).alias("first_validation"))
    listed = ends.agg(F.collect_list(F.struct("fold", "last_train", "first_validation")).alias("all"))
    pairs = listed.select(F.explode("all").alias("t"), "all").select("t", F.explode("all").alias("v"))
    pairs = pairs.select(F.col("t.fold").alias("train_fold"), F.col("v.fold").alias("validation_fold"), "t.last_train", "v.first_validation")
    own = lambda name: folds.where(F.col("split") == name).select("file", F.col("fold").alias(f"{name}_fold")).distinct()
    shared = own("train").join(own("validation"), "file").groupBy("train_fold", "validation_fold").agg(F.count("*").alias("shared_files"))
    found = pairs.join(shared, ["train_fold", "validation_fold"], "left").withColumn("shared_files", F.coalesce("shared_files", F.lit(0)))
    return found.withColumn("no_leak", F.coalesce(F.col("last_train") < F.col("first_validation"), F.lit(True)) & (F.col("shared_files") == 0))
