"""Files read in part, files that could not be read, folds of periods, sketches, and appends that are tried again."""

from __future__ import annotations

import datetime
import random
import tracemalloc
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from oddsbook import queries
from oddsbook.operators import features, sketches, split
from oddsbook.sources import metrics as sink
from oddsbook.sources import races
from tests.test_books import race

DAY = datetime.date


def test_a_file_read_in_part_is_listed_and_gives_no_rows(spark, tmp_path):
    """Row groups of 100; the pages of one in the middle of b are overwritten, in a column that the counts of rows do not need."""
    for name in ("a", "b"):
        frame = pd.DataFrame([race(t, [2.0 + random.random(), 3.0]) for t in range(400)])
        pq.write_table(pa.Table.from_pandas(frame), tmp_path / f"{name}.parquet", row_group_size=100)
    pq.write_table(pa.table({"ts_unix": pa.array([], pa.int64())}), tmp_path / "empty.parquet")
    (tmp_path / "broken.parquet").write_bytes(b"PAR1 and nothing else")
    (tmp_path / "other.txt").write_bytes(b"no race")
    column = pq.read_metadata(tmp_path / "b.parquet").row_group(2)
    at = next(column.column(i) for i in range(column.num_columns) if column.column(i).path_in_schema == "run[1].lay_price_1")
    held = bytearray((tmp_path / "b.parquet").read_bytes())
    start = at.dictionary_page_offset or at.data_page_offset
    held[start : start + at.total_compressed_size] = b"\xff" * at.total_compressed_size
    (tmp_path / "b.parquet").write_bytes(held)

    report = races.read_report(spark, str(tmp_path))
    assert sorted((r.file, r.n_rows, r.reason) for r in report.collect()) == [("a.parquet", 400, None), ("b.parquet", 400, "read_in_part"), ("broken.parquet", None, "read_error"), ("empty.parquet", 0, "no_rows")]
    assert report.where("file = 'b.parquet'").first().n_read < 400
    rows = races.whole_snapshots(races.scan_snapshots(spark, str(tmp_path)), report)
    assert [(r.file, r["count"]) for r in rows.groupBy("file").count().collect()] == [("a.parquet", 400)]


def test_unread_files_are_counted_as_read_errors(spark):
    found = {r.file: r for r in queries._unread(spark, queries_sf()).collect()}
    lost = [r for r in found.values() if r.reason == "read_error"]
    assert len(found) == 15 and lost and not any(r.is_suitable or r.market_id is not None for r in lost)
    counted = {r.reason: r.markets for r in queries.QUERIES["reason_histogram_of_all_files"](spark, queries_sf()).collect()}
    assert counted["read_error"] == len(lost) and sum(counted.values()) == sum(not r.is_suitable for r in found.values())


def queries_sf():
    return "/root/testdata/sf0.001"


def test_overlapping_folds_give_a_row_each_and_name_their_leaks(spark):
    files = spark.createDataFrame([("2025-10-05_a.parquet",), ("2025-10-20_b.parquet",), ("2025-11-02_c.parquet",), ("none.parquet",), ("2025-13-01_d.parquet",), ("2024-01-01_e.parquet",)], "file string")
    periods = [
        (1, "train", DAY(2025, 10, 1), DAY(2025, 10, 10)), (1, "validation", DAY(2025, 10, 20), DAY(2025, 11, 2)), (2, "train", DAY(2025, 10, 5), DAY(2025, 10, 20)), (2, "validation", DAY(2025, 10, 20), DAY(2025, 10, 31)),
        (3, "train", DAY(2025, 12, 1), DAY(2025, 11, 1)), (1, "train", DAY(2025, 10, 4), DAY(2025, 10, 6)),
    ]
    folds = split.temporal_folds(files, spark.createDataFrame(periods, "fold int, split string, first date, last date"))
    got = sorted((r.file[:10], r.fold, r.split) for r in folds.where("fold IS NOT NULL").collect())
    assert got == [("2025-10-05", 1, "train"), ("2025-10-05", 2, "train"), ("2025-10-20", 1, "validation"), ("2025-10-20", 2, "train"), ("2025-10-20", 2, "validation"), ("2025-11-02", 1, "validation")]
    assert sorted(r.file for r in folds.where("split = 'undated'").collect()) == ["2025-13-01_d.parquet", "none.parquet"]
    leaks = {(r.train_fold, r.validation_fold): (r.last_train, r.first_validation, r.shared_files, r.no_leak) for r in split.fold_leaks(folds).collect()}
    assert leaks == {
        (1, 1): (DAY(2025, 10, 5), DAY(2025, 10, 20), 0, True), (1, 2): (DAY(2025, 10, 5), DAY(2025, 10, 20), 0, True),
        (2, 1): (DAY(2025, 10, 20), DAY(2025, 10, 20), 1, False), (2, 2): (DAY(2025, 10, 20), DAY(2025, 10, 20), 1, False),
    }
    assert split.fold_leaks(folds.where("false")).count() == 0


@pytest.mark.parametrize("k", [50, 400])
def test_sketches_keep_their_error_when_merged(spark, k):
    """Ranks of quantiles of merged sketches against the sorted values, for even, skewed and repeated ones."""
    n = 60_000
    rows = spark.range(n).selectExpr("id", "id % 3 AS g", "id % 41 AS part", "xxhash64(id) / 1e19 AS even", "floor(id % 1000 / 400) AS steps")
    value = F.when(F.col("g") == 0, F.col("even")).when(F.col("g") == 1, F.exp(F.col("even") * 40)).otherwise(F.col("steps"))
    rows = rows.withColumn("v", F.when(F.col("id") % 101 == 0, None).otherwise(value))
    parts = sketches.sketched(rows, ["g", "part"], F.col("v"), k)
    shares = {f"q{p}": p / 100 for p in (1, 10, 50, 90, 99)}
    got = {r.g: r for r in sketches.quantiles(sketches.merged(parts, ["g"], k), shares).collect()}
    held = rows.select("g", "v").toPandas().dropna()
    for g, own in held.groupby("g").v:
        x = np.sort(own.to_numpy())
        assert got[g].n == len(x)
        for name, p in shares.items():
            low, high = np.searchsorted(x, got[g][name], "left"), np.searchsorted(x, got[g][name], "right")
            assert low - sketches.rank_error(k) * len(x) <= p * len(x) <= high + sketches.rank_error(k) * len(x)
    sizes = parts.agg(F.max(F.length("sketch"))).first()[0]
    assert sizes < 40 * k + 2000
    nothing = sketches.quantiles(sketches.sketched(rows.withColumn("v", F.lit(None).cast("double")), ["g"], F.col("v"), k), {"q": 0.5})
    assert [(r.n, r.q) for r in nothing.collect()] == [(0, None)] * 3


def test_few_values_are_held_exactly(spark):
    rows = spark.createDataFrame([(1, 5.0), (1, 7.0), (1, float("nan")), (1, -1.0), (2, 3.0)], "g int, v double")
    got = {r.g: (r.n, r.low, r.mid) for r in sketches.quantiles(sketches.sketched(rows, ["g"], F.col("v")), {"low": 0.0, "mid": 0.5}).collect()}
    assert got == {1: (3, -1.0, 5.0), 2: (1, 3.0, 3.0)}


def episodes(spark, n, start=0):
    return spark.range(start, start + n).selectExpr("id AS episode", "id * 3 AS step", "double(id) AS balance", "'x' AS other")


def test_a_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "m")
    assert sink.read_batches(spark, path).count() == 0 and sink.commits(spark, path).count() == 0
    assert sink.append_batch(episodes(spark, 5), path, "one") and not sink.append_batch(episodes(spark, 5), path, "one")
    assert sink.append_batch(episodes(spark, 0), path, "none") and sink.append_batch(episodes(spark, 7, 5), path, "two")
    sink.fitted(episodes(spark, 9), sink.EPISODE).write.parquet(f"{path}/rows/batch=three/attempt=died")  # before its commit
    rows = sink.read_batches(spark, path)
    assert sorted((r.batch, r.episode) for r in rows.collect()) == [("one", i) for i in range(5)] + [("two", i) for i in range(5, 12)]
    assert sorted((r.batch, r.n) for r in sink.commits(spark, path).collect()) == [("none", 0), ("one", 5), ("two", 7)]
    new = sink.resume_from_commits(spark, path, episodes(spark, 3, 40).drop("episode"))
    assert sorted((r.step, r.episode) for r in new.collect()) == [(120, 13), (123, 14), (126, 15)]
    assert sink.append_batch(new, path, "three") and sink.read_batches(spark, path).where("batch = 'three'").count() == 3
    with pytest.raises(ValueError, match="not the name"):
        sink.append_batch(new, path, "a/b")


def test_of_attempts_at_the_same_time_one_counts(spark, tmp_path):
    path = str(tmp_path / "m")
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda _: sink.append_batch(episodes(spark, 6), path, "same"), range(4)))
    assert sum(done) == 1 and sink.read_batches(spark, path).count() == 6 and sink.commits(spark, path).count() == 1


def test_statistics_do_not_cancel(spark):
    """A place with mean 1e8 and deviation 1 has variance 1 to six digits, over many batches and tasks."""
    rng = np.random.default_rng(3)
    x = np.stack([1e8 + rng.choice([-1.0, 1.0], 6000), rng.normal(-3, 5, 6000), np.full(6000, 7.0)], axis=1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        rows = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "observation array<double>").repartition(7)
        got = features.observation_stats(rows).orderBy("feature").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for r, mean, variance in zip(got, x.mean(axis=0), x.var(axis=0), strict=True):
        assert r.n == 6000 and r.mean == pytest.approx(mean, rel=1e-12) and r.variance == pytest.approx(variance, rel=1e-6)
    assert features.observation_stats(rows.where("false")).count() == 0


def test_damage_does_not_hold_the_file(spark, tmp_path):
    """32 MB of random values: only a stretch in the middle of the pages changes, and this process never has the file in memory."""
    path = str(tmp_path / "big.parquet")
    pq.write_table(pa.table({"v": np.random.default_rng(1).integers(0, 1 << 62, 1 << 22)}), path, row_group_size=1 << 16, use_dictionary=False)
    before = np.fromfile(path, np.uint8)
    tracemalloc.start()
    queries._damage(spark, path)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    after = np.fromfile(path, np.uint8)
    changed = np.flatnonzero(before != after)
    assert len(before) == len(after) and len(before) // 2 - (1 << 16) < changed[0] and changed[-1] < len(before) * 5 // 8
    assert 0.9 * len(before) / 8 < len(changed) <= len(before) / 8 and peak < len(before) / 3
    assert pq.read_metadata(path).num_rows == 1 << 22
