"""The registered queries of the order-book operators, each over whole derived tables. Doubles are rounded to 6 digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsbook.config import DEFAULT, EARLIER
from oddsbook.functions import scalars as x
from oddsbook.operators import backtest as bt
from oddsbook.operators import features as ft
from oddsbook.operators import carry, inspection, ledger, metrics, sketches, split, valuation
from oddsbook.operators import quotes as q
from oddsbook.plans import workloads
from oddsbook.sources import fixtures as fx
from oddsbook.sources import metrics as sink
from oddsbook.sources import races
from oddsbook.sources.work import files_of, work_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_C = F.col
_KEY = ["market_id", "step", "runner_idx"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, halves upwards in spite of representation: a little is added, so that two engines round alike."""
    return df.select(*(_digits(_C(n), digits).alias(n) if t == "double" else _C(n) for n, t in df.dtypes))


def _digits(c: Column, digits: int) -> Column:
    return F.round(c + 1e-9, digits) + F.lit(0.0)


def query(f: Query, name: str | None = None) -> Query:
    QUERIES[name or f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
    return f


def rounded_query(f: Query) -> Query:
    """Registers a query that rounds its own doubles, to fewer digits: rounding them again would change nothing."""
    QUERIES[f.__name__] = f
    return f


def _utc(spark: SparkSession) -> SparkSession:
    """The session in UTC, without generated methods of over 8,000 bytes: the JVM compiles none of these, and split ones are three times as fast.

    Rows dealt by market alone also serve joins by market and step; buckets are read as such, and their order is trusted.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    return spark


#: Where a session has written the derived tables of a folder, by the files they were derived from.
_STORED: dict[tuple, str] = {}
_SOURCES = ("events", "orders")
#: Snapshots that a bucket of the derived tables has about, and the least number of buckets.
_BUCKET, _BUCKETS = 25_000, 4


def _stored(s: SparkSession, d: str, name: str, make: Callable[[SparkSession, str, int], DataFrame], order: list[str]) -> DataFrame:
    """A derived table, written once a session for the source files as they are, so that queries scan the columns they need and do not derive them anew.

    It is dealt into buckets by market, so that windows, groupings and joins by market need no exchange; the buckets are as many as the events ask for.
    make is given their number: rows that it deals so are written as they are.
    """
    key = (s.sparkContext.applicationId, name, *(files_of(s, f"{d}/{t}.parquet") for t in _SOURCES))
    path = _STORED.get(key)
    if path and not files_of(s, f"{path}/_SUCCESS"):
        path = None
    if not path:
        path = work_path(s, name)
        n = max(_BUCKETS, -(-s.read.parquet(f"{d}/events.parquet").count() // _BUCKET))
        rows = make(_utc(s), d, n).repartition(n, "market_id")
        rows.write.format("parquet").bucketBy(n, "market_id").sortBy(*order).option("path", path).saveAsTable(_table(path))
        _STORED[key] = path
    return _utc(s).table(_table(path))


def _table(path: str) -> str:
    """The name of the table that was written to a path of work_path."""
    return path.rpartition("/")[2].replace("-", "_")


def _snaps(s: SparkSession, d: str) -> DataFrame:
    return _stored(s, d, "snapshots", fx.snapshots, ["market_id", "step"])


def _raw(s: SparkSession, d: str) -> DataFrame:
    return _stored(s, d, "quotes", lambda s, d, n: fx.quotes_of(s, _snaps(s, d)), ["market_id", "runner_idx", "step"])


def _inspected(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Snapshots and raw quotes for the inspection: it needs few columns of the quotes, which are derived in the snapshots' buckets and not written."""
    snaps = _snaps(s, d)
    return snaps, fx.quotes_of(s, snaps)


def prepare(s: SparkSession, d: str) -> None:
    """Writes the tables that the queries share, if this session has not for these sources."""
    _snaps(s, d)
    _raw(s, d)


def _clean(s: SparkSession, d: str) -> DataFrame:
    return q.clean_quotes(_raw(s, d))


def _trades(s: SparkSession, d: str) -> DataFrame:
    return _utc(s).sql(fx.TRADES, quotes=_raw(s, d), snapshots=_snaps(s, d))


def _ledger(s: SparkSession, d: str) -> DataFrame:
    """The netted positions after each trade."""
    return _stored(s, d, "ledger", lambda s, d, n: ledger.position_ledger(_trades(s, d).withColumn("rate", F.lit(0.05))), ["market_id", "runner_idx", "step", "k"])


def _files(s: SparkSession, d: str) -> DataFrame:
    return _snaps(s, d).where("step = 0").select("market_id", "file")


def _rates(s: SparkSession, d: str) -> DataFrame:
    return _snaps(s, d).where("step = 0").select("market_id", "runner_count", x.commission_rate(_C("commission_rate")).alias("rate"))


def _positions(s: SparkSession, d: str) -> DataFrame:
    return ledger.last_state(ledger.position_ledger_simple(_trades(s, d)))


_folder = work_path


def _markets(s: SparkSession, d: str) -> DataFrame:
    return _snaps(s, d).where("step = 0").select("market_id", "n_steps", x.commission_rate(_C("commission_rate")).alias("rate"))


def _held(s: SparkSession, d: str) -> DataFrame:
    """The complete grid with netted positions after each step's trades and their marks."""
    grid = _clean(s, d).select(*_KEY, "back_price_1", "lay_price_1", "microprice")
    return carry.marked(carry.carried(grid, _ledger(s, d))).join(_markets(s, d), "market_id")


def _marked(s: SparkSession, d: str) -> DataFrame:
    return valuation.mark_positions(_positions(s, d), valuation.closing_quotes(_clean(s, d), _snaps(s, d)))


def _wide(s: SparkSession, d: str) -> DataFrame:
    """Quotes pivoted back to blocks of runner columns, with the snapshot's columns."""
    one = lambda i, f: F.max(F.when(_C("runner_idx") == i, _C(f))).cast("double").alias(f"run[{i}].{f}")
    blocks = _raw(s, d).groupBy("market_id", "step").agg(*(one(i, f) for i in range(7) for f in q.FIELDS))
    snaps = _snaps(s, d).select("market_id", "step", "ts_unix", _C("runner_count").cast("int").alias("runner_count"), "commission_rate", "market_status", "total_matched_market")
    return snaps.join(blocks, ["market_id", "step"])


# Sources and sinks


@query
def scan_snapshots(s, d):
    path = work_path(s, "races")
    _wide(s, d).withColumn("market_id", _C("market_id").cast("string")).withColumn("secs_to_off", _C("step").cast("double")).drop("step").write.parquet(path)
    rows = races.scan_snapshots(s, path)
    return rows.select(_C("source_market_id").cast("long").alias("market_id"), _C("secs_to_off").cast("long").alias("step"), "ts_unix", "runner_count", "market_status", "total_matched_market", _C("`run[0].back_price_1`").alias("b0"), _C("`run[6].lay_price_1`").alias("l6"))


@query
def quarantine_files(s, d):
    """Markets with a date in their file name are Parquet; the others' rows are text files that only have Parquet's file name."""
    path, rows = work_path(s, "mixed"), _snaps(s, d).select("market_id", "file", "ts_unix")
    rows.where(split.race_date(_C("file")).isNotNull()).drop("file").write.parquet(path)
    other = rows.where(split.race_date(_C("file")).isNull()).select("file").distinct()
    other.repartition(3).sortWithinPartitions("file").write.text(f"{path}-text")
    at = s._jvm.org.apache.hadoop.fs.Path(f"{path}-text")
    files = at.getFileSystem(s._jsc.hadoopConfiguration())
    texts = [f.getPath() for f in files.listStatus(at) if f.getPath().getName().endswith(".txt")]
    for i, text in enumerate(texts):  # three files
        files.rename(text, s._jvm.org.apache.hadoop.fs.Path(f"{path}/broken-{i}.parquet"))
    return races.quarantine_files(s, path, races.scan_snapshots(s, path, {"ts_unix": rows.schema["ts_unix"].dataType}))


def _damage(s: SparkSession, path: str) -> None:
    """Overwrites a stretch in the middle of a Parquet file's pages, so that it opens but some of its row groups cannot be read.

    The file is copied from stream to stream in the JVM, whose buffer is of fixed size; this process holds one block of the stretch at most.
    """
    at, new = (s._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.copy"))
    fs, io = at.getFileSystem(s._jsc.hadoopConfiguration()), s._jvm.org.apache.commons.io.IOUtils
    size = fs.getFileStatus(at).getLen()
    held, out = fs.open(at), fs.create(new, True)
    held.seek(size - 8)
    pages = size - 8 - s._jvm.Integer.reverseBytes(held.readInt())  # the footer and its length come last
    half, n = pages // 2, pages // 8
    held.seek(0)
    io.copyLarge(held, out, 0, half)
    for start in range(0, n, _BLOCK):
        out.write(bytearray(b"\xff" * min(_BLOCK, n - start)))
    held.seek(half + n)
    io.copyLarge(held, out)
    held.close()
    out.close()
    fs.delete(at, False)
    fs.rename(new, at)


#: Bytes of a damaged stretch that are written at a time; row groups that a race file has at least, once it has 100 rows for each.
_BLOCK, _ROW_GROUPS = 1 << 20, 64


def _race_folder(s: SparkSession, d: str) -> str:
    """Four race files of many row groups, by market_id modulo 4; that of 1 is damaged in the middle, and one file is no Parquet at all.

    Row groups grow with the files, up to the usual size, as a footer has an entry for each column of each of them.
    """
    path, rows = work_path(s, "races"), _wide(s, d).withColumn("g", _C("market_id") % 4)
    group = max(100, _snaps(s, d).count() // (4 * _ROW_GROUPS))
    rows = rows.withColumn("market_id", _C("market_id").cast("string")).withColumn("secs_to_off", _C("step").cast("double")).drop("step")
    rows.repartition("g").write.partitionBy("g").option("parquet.block.row.count.limit", group).option("parquet.page.row.count.limit", group).parquet(f"{path}-parts")
    fs = s._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(s._jsc.hadoopConfiguration())
    fs.mkdirs(s._jvm.org.apache.hadoop.fs.Path(path))
    for part, _, _ in files_of(s, f"{path}-parts"):
        if "/g=" in part and part.endswith(".parquet"):
            fs.rename(s._jvm.org.apache.hadoop.fs.Path(part), s._jvm.org.apache.hadoop.fs.Path(f"{path}/g{part.partition('/g=')[2][0]}.parquet"))
    _damage(s, f"{path}/g1.parquet")
    out = fs.create(s._jvm.org.apache.hadoop.fs.Path(f"{path}/none.parquet"), True)
    out.write(bytearray(b"no parquet"))
    out.close()
    return path


@query
def read_report(s, d):
    """Files by what their footers say and whether they could be read whole."""
    return races.read_report(s, _race_folder(s, d)).select("file", "n_rows", _C("reason").isNull().alias("whole"), "reason")


@query
def whole_snapshots(s, d):
    """Rows of the files that could be read whole: none of a file that was read in part."""
    path = _race_folder(s, d)
    rows = races.whole_snapshots(races.scan_snapshots(s, path), races.read_report(s, path))
    return rows.select("file", _C("source_market_id").cast("long").alias("market_id"), _C("secs_to_off").cast("long").alias("step"), "total_matched_market")


@query
def read_whitelist(s, d):
    files = _files(s, d).join(inspection.suitability(*_inspected(s, d), dealt=True), "market_id")
    rows = files.select("file", F.when(_C("is_suitable"), F.lit(" True")).otherwise("False").alias("is_suitable"))
    path = work_path(s, "whitelist")
    rows.unionByName(rows).write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return races.read_whitelist(s, path)


def _appended(s, d) -> tuple[DataFrame, DataFrame]:
    rows = fx.episodes(s, d)
    return rows.where("episode % 3 <> 0"), rows.where("episode % 3 = 0")


@query
def append_episode_metrics(s, d):
    path = work_path(s, "episodes")
    for rows in _appended(s, d):
        sink.append_episode_metrics(rows, path)
    return sink.read_metrics(s, path).select("episode", "step", "num_trades", "realized_pnl", "back_trades", "green_up_pnl")


@query
def append_validation_metrics(s, d):
    path = work_path(s, "validation")
    found = metrics.rollout_quantiles(fx.rollout_pnl(s, d))
    for part in (found.where("val_episode % 2 = 0"), found.where("val_episode % 2 = 1")):
        sink.append_validation_metrics(part.withColumn("stochastic_rollouts", _C("n_rollouts")), path)
    return sink.read_metrics(s, path, sink.VALIDATION).select("val_episode", "realized_pnl", "pnl_p10", "pnl_p90", "stochastic_rollouts", "final_balance")


@query
def append_episode_batches(s, d):
    """Two batches, of which the second is tried again, and an attempt at a third that failed before its commit."""
    path, (old, new) = work_path(s, "batches"), _appended(s, d)
    for batch, rows in (("old", old), ("new", new), ("new", new)):
        sink.append_batch(rows, path, batch)
    sink.fitted(new, sink.EPISODE).write.parquet(f"{path}/rows/batch=lost/attempt=0")
    return sink.read_batches(s, path).select("batch", "episode", "step", "num_trades", "realized_pnl", "green_up_pnl")


@query
def resume_from_commits(s, d):
    path, (old, new) = work_path(s, "batches"), _appended(s, d)
    sink.append_batch(old, path, "old")
    return sink.resume_from_commits(s, path, new.drop("episode").withColumn("__order", _C("step") * 10 + _C("run_id")), "__order").select("run_id", "episode", "step")


@query
def metrics_union(s, d):
    return sink.metrics_union(*_appended(s, d)).select("episode", "num_trades", "realized_pnl")


@query
def resume_offset(s, d):
    old, new = _appended(s, d)
    return sink.resume_offset(old, new.drop("episode"), run="run_id").select("run_id", "episode", "step")


# Scalars and projections


@query
def to_float(s, d):
    rows = s.read.parquet(f"{d}/orders.parquet")
    text = F.when(_C("o_orderkey") % 5 == 0, "").when(_C("o_orderkey") % 5 == 1, "abc").when(_C("o_orderkey") % 5 == 2, "NaN").when(_C("o_orderkey") % 5 == 3, None).otherwise(_C("o_custkey").cast("string"))
    return rows.select("o_orderkey", x.to_float(text, -1.0).alias("v"))


@query
def safe_normalize(s, d):
    return _raw(s, d).select(*_KEY, x.safe_normalize(_C("ob_imbalance"), -1.0, 1.0).alias("imbalance"), x.safe_normalize(_C("back_size_1"), 20.0, 150.0).alias("size"), x.safe_normalize(_C("back_size_1"), 1.0, 1.0).alias("flat"))


@query
def safe_log_norm(s, d):
    return _raw(s, d).select(*_KEY, x.safe_log_norm(_C("back_size_1")).alias("size"), x.safe_log_norm(_C("signal")).alias("signal"))


@query
def safe_price_norm(s, d):
    return _raw(s, d).select(*_KEY, x.safe_price_norm(_C("back_price_1")).alias("back"), x.safe_price_norm(_C("signal") + 1).alias("low"))


@query
def unpivot_runners(s, d):
    return q.unpivot_runners(_wide(s, d), ["market_id", "step"]).select("market_id", "step", _C("runner_idx").cast("long").alias("runner_idx"), "back_price_1", "lay_size_3", "microprice", "prob_implied", "has_level_1")


@query
def clean_quotes(s, d):
    return _clean(s, d).select(*_KEY, "back_price_2", "lay_price_2", "back_size_2", "lay_size_2", "last_traded_price", "secs_since_last_trade", _C("has_level_1").cast("int").alias("has_level_1"), _C("has_level_2").cast("int").alias("has_level_2"))


@query
def derive_quotes(s, d):
    return q.valid_quotes(_clean(s, d)).select(*_KEY, "microprice", "ob_imbalance", "rel_spread", "prob_implied")


@query
def valid_quotes(s, d):
    return q.valid_quotes(_raw(s, d)).select(*_KEY, "back_price_1", "lay_price_1")


@query
def base_features(s, d):
    return q.valid_quotes(_clean(s, d)).select(*_KEY, *(c.alias(n) for n, c in q.base_features().items()))


@query
def exit_prices(s, d):
    own = lambda config: x.exit_prices(_C("back_price_1"), _C("lay_price_1"), _C("microprice"), config)
    new, old = own(DEFAULT), own(EARLIER)
    return q.valid_quotes(_clean(s, d)).select(*_KEY, new[0].alias("back_exit"), new[1].alias("lay_exit"), old[0].alias("micro_exit"))


@query
def runner_close_pnl(s, d):
    rows = q.valid_quotes(_clean(s, d))
    pnl = x.runner_close_pnl(_C("back_size_1"), _C("last_traded_price"), _C("lay_size_1"), _C("microprice"), _C("lay_price_1"), _C("back_price_1"))
    return rows.select(*_KEY, pnl.alias("pnl"))


@query
def curriculum_schedule(s, d):
    step = (_C("o_orderkey") * 37) % 600_000
    return s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", *(c.alias(n) for n, c in x.curriculum_schedule(step).items()))


@query
def race_date(s, d):
    return _files(s, d).select("file", split.race_date(_C("file")).alias("race_date"))


def _timed(s, d):
    return _snaps(s, d).withColumn("market_time", F.timestamp_millis("ts_unix"))


@query
def race_date_of_column(s, d):
    return split.file_dates(_timed(s, d), "column")


@query
def temporal_split_of_column(s, d):
    return split.temporal_split(split.file_dates(_timed(s, d), "column")).select("file", "split")


@query
def global_features(s, d):
    return _snaps(s, d).select("market_id", "step", *(c.alias(n) for n, c in ft.global_features().items()))


@query
def opening_board(s, d):
    return q.valid_quotes(_clean(s, d)).where("step = 0").select("market_id", "runner_idx", "back_price_1", "lay_price_1", "last_traded_price", (_C("prob_implied") * 100).alias("implied_pct"))


@query
def race_card(s, d):
    first = metrics.race_card(_snaps(s, d), races.CARD)
    return first.select("market_id", "file", "runner_count", (_C("commission_rate") * 100).alias("commission_pct"), "snapshots")


@query
def race_card_metadata(s, d):
    """Card columns as race files have them, by way of race files: venue and race number of each file's name, and a country of some."""
    parts = F.split("file", "_")
    rows = _snaps(s, d).withColumns({
        "venue": F.get(parts, F.lit(1)), "race_number": F.get(parts, F.lit(2)), "country_code": F.when(_C("step") % 3 == 0, F.when(_C("market_id") % 7 != 0, "GB")).otherwise("none"),
        "market_id": _C("market_id").cast("string"), "secs_to_off": _C("step").cast("double"), "runner_count": _C("runner_count").cast("int"),
    })
    path = work_path(s, "cards")
    rows.select("market_id", "secs_to_off", "runner_count", "commission_rate", "venue", "race_number", "country_code").write.parquet(path)
    card = metrics.race_card(races.scan_snapshots(s, path).drop("file"), [c for c in races.CARD if c != "market_id"], "source_market_id", "secs_to_off")
    return card.select(_C("source_market_id").cast("long").alias("market_id"), "venue", "race_number", "country_code", "race_type", "runner_count", "n_known", "snapshots")


@query
def episode_outcome(s, d):
    return fx.episodes(s, d).select("episode", metrics.episode_outcome(_C("realized_pnl")).alias("outcome"))


@query
def build_observation(s, d):
    seen = ft.build_observation(_snaps(s, d), ft.runner_features(_clean(s, d))).withColumn("o", _C("observation").cast("array<double>"))
    total = F.aggregate("o", F.lit(0.0), lambda a, v: a + v)
    return seen.select("market_id", "step", F.size("o").alias("places"), _digits(F.element_at("o", 1), 4).alias("first"), _digits(F.element_at("o", 13), 4).alias("micro"), _digits(F.element_at("o", 985), 4).alias("balance"), _digits(F.element_at("o", 996), 4).alias("secs"), _digits(total, 2).alias("total"))


_VECTOR = ["f_microprice", "f_imbalance", "f_spread", "f_prob", "f_vol_60s", "f_depth_share"]


def _vectors(s, d):
    return workloads.build_features(_raw(s, d)).where(_C("f_microprice").isNotNull()).select("market_id", *_KEY[1:], F.array(*_VECTOR).alias("v"))


@query
def observation_stats(s, d):
    return ft.observation_stats(_vectors(s, d), "v").select(_C("feature").cast("long").alias("feature"), "n", "mean", "variance")


@query
def normalise_observation(s, d):
    """All places, by the statistics of the markets whose files are of the training period."""
    rows = _vectors(s, d)
    train = split.temporal_split(_files(s, d)).where("split = 'train'").select("market_id")
    out = ft.normalise_observation(rows, ft.observation_stats(rows.join(train, "market_id", "left_semi"), "v"), "v")
    return out.select(*_KEY, *(_digits(_C("v")[i].cast("double"), 4).alias(f"v{i}") for i in range(len(_VECTOR))))


def _observations(s, d):
    """The vectors: made anew where they are read, as 999 places take a multiple of the bytes of the quotes they come from."""
    return ft.build_observation(_snaps(s, d), ft.runner_features(_clean(s, d)))


@query
def observation_stats_wide(s, d):
    """All 999 places of the vector."""
    return ft.observation_stats(_observations(s, d)).select(_C("feature").cast("long").alias("feature"), "n", "mean", "variance")


@query
def normalise_observation_wide(s, d):
    """All 999 places, by the statistics of the training period's markets: some of the places and their sum."""
    rows = _observations(s, d)
    train = split.temporal_split(_files(s, d)).where("split = 'train'").select("market_id")
    out = ft.normalise_observation(rows, ft.observation_stats(rows.join(train, "market_id", "left_semi"))).withColumn("o", _C("observation").cast("array<double>"))
    at = lambda i, name: _digits(F.element_at("o", i), 4).alias(name)
    return out.select("market_id", "step", F.size("o").alias("places"), at(1, "first"), at(13, "micro"), at(996, "secs"), _digits(F.aggregate("o", F.lit(0.0), lambda a, v: a + v), 2).alias("total"))


# Filters


@query
def pre_race_rows(s, d):
    return q.pre_race_rows(_snaps(s, d)).select("market_id", "step")


@query
def off_step(s, d):
    return q.before_off(_snaps(s, d)).select("market_id", "step", "off_step", "closing_step")


@query
def open_market_rows(s, d):
    rows = q.before_off(_snaps(s, d))
    return rows.groupBy("market_id").agg(F.count_if(q.is_open()).alias("open_rows"), F.count_if(~q.is_open()).alias("suspended"))


def _proposals(s, d):
    """Quotes of open snapshots before the off, with a fixed capital."""
    live = q.before_off(_snaps(s, d)).where(q.is_open()).select("market_id", "step")
    rows = _clean(s, d).join(live, ["market_id", "step"], "left_semi")
    return rows.withColumns({"available": F.lit(800.0), "budget": F.lit(800.0) * ((_C("allocation") + 1.0) / 2.0) * 1.5})


@query
def trade_admission(s, d):
    rows = bt.trade_admission(_proposals(s, d))
    taken = _C("reason") == "accepted"
    return rows.select(*_KEY, "reason", "side", F.when(taken, _C("liability")).alias("liability"), F.when(taken, _C("stake")).alias("stake"))


@query
def violation_counts(s, d):
    return bt.violation_counts(bt.trade_admission(_proposals(s, d)), q.before_off(_snaps(s, d)))


@query
def stride_sample(s, d):
    return inspection.stride_sample(_snaps(s, d)).select("market_id", "step")


@query
def min_rows_and_columns(s, d):
    return inspection.market_checks(*_inspected(s, d), dealt=True).select("market_id", _C("few_rows").cast("int").alias("few_rows"))


def _unread(s, d):
    """Inspection of a folder in which the files of every sixth market could not be read."""
    seen = lambda rows: rows.where("market_id % 6 <> 5")
    snaps, raw = _inspected(s, d)
    return workloads.inspect(seen(snaps), seen(raw), listed=_files(s, d).select("file"), dealt=True)


@query
def inspect_unread_files(s, d):
    return _unread(s, d).select("file", "is_suitable", "reason", "split")


@query
def reason_histogram_of_all_files(s, d):
    return inspection.reason_histogram(_unread(s, d))


# Joins and splits


def _whitelist(s, d):
    rows = _files(s, d).join(inspection.suitability(*_inspected(s, d), dealt=True), "market_id")
    return races.whitelist(rows.select("file", F.when(_C("is_suitable"), "True ").otherwise("False").alias("is_suitable")))


@query
def whitelisted_races(s, d):
    return inspection.whitelisted(_files(s, d), _whitelist(s, d)).select("file")


@query
def filtered_out_races(s, d):
    return inspection.filtered_out(_files(s, d), _whitelist(s, d)).select("file")


@query
def temporal_split(s, d):
    return split.temporal_split(_files(s, d)).select("file", "split")


@query
def validation_order(s, d):
    return split.validation_order(split.temporal_split(_files(s, d)))


@query
def train_shuffle(s, d):
    return split.train_shuffle(split.temporal_split(_files(s, d)))


@query
def tail_split(s, d):
    return split.tail_split(_files(s, d), 20)


@query
def no_temporal_leak(s, d):
    return split.leak_check(split.temporal_split(_files(s, d)))


def _folds(s, d):
    """Four folds of 70 days each for training and, three days later, 30 for validation; they begin 30 days apart, so they overlap. Of the last, both periods do."""
    start = lambda days: F.date_add(F.lit("2025-10-01").cast("date"), (_C("id") * 30 + days).cast("int"))
    folds = s.range(4).withColumnRenamed("id", "fold").withColumn("id", _C("fold"))
    late = F.when(_C("fold") == 3, 20).otherwise(0)
    train, check = (folds.select("fold", F.lit(n).alias("split"), start(a).alias("first"), start(b).alias("last")) for n, a, b in (("train", 0, 69), ("validation", 73 - late, 102)))
    return split.temporal_folds(_files(s, d), train.unionByName(check))


@query
def temporal_folds(s, d):
    return _folds(s, d).select("file", "race_date", "fold", "split")


@query
def fold_leaks(s, d):
    return split.fold_leaks(_folds(s, d))


@query
def trade_quotes(s, d):
    signals = _raw(s, d).where("signal >= 0.5").select(*_KEY, "signal")
    return signals.join(q.valid_quotes(_clean(s, d)).select(*_KEY, "back_price_1", "lay_price_1"), _KEY)


@query
def closing_quote(s, d):
    return valuation.closing_quotes(_clean(s, d), _snaps(s, d)).select(*_KEY, "back_price_1", "lay_price_1")


@query
def rollout_grid(s, d):
    return metrics.rollout_grid(_files(s, d).select("market_id"))


# Inspection


def _measure(check):
    return lambda s, d: inspection.market_checks(*_inspected(s, d), dealt=True).select("market_id", _C(check).alias("value"))


for _check in inspection.CHECKS:
    query(_measure(_check), f"chk_{_check}")


@query
def suitability(s, d):
    return inspection.suitability(*_inspected(s, d), dealt=True)


@query
def reason_histogram(s, d):
    return inspection.reason_histogram(inspection.suitability(*_inspected(s, d), dealt=True))


@query
def favourite(s, d):
    return q.favourites(_raw(s, d))


# Windows


def _features(*names):
    return lambda s, d: ft.runner_features(_clean(s, d)).where(_C("micro_delta_1").isNotNull()).select(*_KEY, *names)


for _name, _columns in {"momentum_deltas": ["micro_delta_1", "imbalance_delta", "vol60_delta", "spread_delta"], "momentum_5": ["micro_delta_5", "ret_mean_5"], "session_vwap": ["vwap_ratio"], "price_percentile": ["price_percentile"], "favourite_gap": ["favourite_delta"]}.items():
    query(_features(*_columns), _name)


@query
def runner_pool(s, d):
    rows = ft.runner_features(_clean(s, d)).where(_C("micro_delta_1").isNotNull()).withColumn("f_prob", x.safe_normalize(_C("prob_implied"), 0.0, 1.0))
    return ft.runner_pool(rows, ["f_prob", "micro_delta_1", "price_percentile"])


@query
def position_age(s, d):
    states = ledger.position_ledger_simple(_trades(s, d))
    first = states.groupBy("market_id", "runner_idx").agg(F.min("step").alias("first_open"))
    rows = states.join(first, ["market_id", "runner_idx"]).join(_snaps(s, d).where("step = 0").select("market_id", "n_steps"), "market_id")
    return ft.position_age(rows).select(*_KEY, "position_age")


@query
def rolling_sharpe(s, d):
    return metrics.rolling_sharpe(_snaps(s, d).select("market_id", "step", ((_C("value_c") % 1000 - 480) / 100).alias("mtm_change"))).select("market_id", "step", "sharpe")


@query
def drawdown(s, d):
    balance = F.lit(1000.0) + ((_C("cum_value_c") * 7) % 20000 - 10000) / 100
    return metrics.drawdown(_snaps(s, d).select("market_id", "step", balance.alias("balance")))


@query
def no_trade_streak(s, d):
    return metrics.no_trade_streak(fx.episodes(s, d)).select("run_id", "episode", "streak", "penalty")


@query
def recent_trades(s, d):
    return metrics.recent_trades(_trades(s, d)).select(*_KEY, "recent")


@query
def step_index(s, d):
    return q.step_index(_snaps(s, d).select("market_id", "ts_unix", "event_id"), ["event_id"]).select("market_id", "event_id", "step", "n_steps", "progress")


@query
def trade_log(s, d):
    return metrics.trade_log(_trades(s, d)).select(*_KEY, "place", "side", "stake")


# Positions and values


@query
def position_ledger(s, d):
    rows = ledger.position_ledger(_trades(s, d).withColumn("rate", F.lit(0.05)))
    return rows.select("market_id", "runner_idx", "k", "back_stake", "back_price", "lay_stake", "lay_price", "realised")


@query
def position_ledger_simple(s, d):
    return ledger.position_ledger_simple(_trades(s, d))


@query
def market_exposure(s, d):
    return valuation.market_exposure(_positions(s, d))


@query
def position_concentration(s, d):
    return valuation.position_concentration(_positions(s, d))


@query
def mark_positions(s, d):
    return _marked(s, d).select("market_id", "runner_idx", "mtm")


@query
def portfolio_mtm(s, d):
    return valuation.portfolio_mtm(_marked(s, d))


@query
def green_up(s, d):
    return valuation.green_up(_marked(s, d).join(_rates(s, d), "market_id"))


@query
def book_payoffs(s, d):
    return valuation.book_payoffs(_positions(s, d), _rates(s, d))


@query
def worst_case_book(s, d):
    return valuation.worst_case_book(valuation.book_payoffs(_positions(s, d), _rates(s, d)))


# Positions and values at every step


@query
def mark_positions_by_step(s, d):
    return _held(s, d).where("n_trades > 0").select(*_KEY, "back_stake", "lay_stake", "net_stake", "n_trades", "mtm")


@query
def market_exposure_by_step(s, d):
    return carry.by_step(_held(s, d)).select("market_id", "step", "exposure", "net_exposure", "n_positions")


@query
def position_concentration_by_step(s, d):
    return carry.by_step(_held(s, d)).select("market_id", "step", "concentration")


@query
def portfolio_mtm_by_step(s, d):
    return carry.by_step(_held(s, d)).select("market_id", "step", "portfolio_mtm", "balance", "commission")


@query
def green_up_by_step(s, d):
    return carry.by_step(_held(s, d)).select("market_id", "step", "green_up", _C("closing_commission").alias("commission"))


@query
def position_age_by_step(s, d):
    return _held(s, d).select(*_KEY, carry.position_age(_C("n_steps")).alias("position_age"))


@query
def recent_trades_by_step(s, d):
    return carry.by_step(_held(s, d)).select("market_id", "step", (_C("recent_trades") / 10).alias("recent"))


@rounded_query
def build_observation_with_positions(s, d):
    """All 999 places before each step's trades: a row for each slot that is not all zeros (v0 to v40), and one, slot 24, for the 15 last places."""
    rows = ft.runner_features(ft.positioned(_clean(s, d), _ledger(s, d), _markets(s, d)), _raw(s, d))
    slots = ft.build_observation(_snaps(s, d), rows, by_slot=True)
    short = lambda v: F.when(v != 0, _digits(v, 4)).otherwise(F.abs(v))  # noqa: E731  most places are zero
    return slots.select("market_id", "step", "slot", *(short(_C(f"v{i}")).alias(f"v{i}") for i in range(41)))


# Metrics


@query
def rollout_quantiles(s, d):
    return metrics.rollout_quantiles(fx.rollout_pnl(s, d))


@query
def validation_summary(s, d):
    """Episodes with the tenths and the last mid-race result of their rollouts."""
    rollouts = metrics.rollout_quantiles(fx.rollout_pnl(s, d)).select(_C("val_episode").alias("episode"), "pnl_p10", "pnl_p90", "mid_race_pnl")
    return metrics.validation_summary(fx.episodes(s, d).join(rollouts, "episode"))


@query
def training_block_summary(s, d):
    return metrics.training_blocks(fx.episodes(s, d))


@query
def lay_share_by_band(s, d):
    return metrics.lay_share_by_band(fx.episodes(s, d))


@query
def size_ratio_by_price(s, d):
    return metrics.size_ratio_by_price(_raw(s, d))


@query
def rollout_quantile_sketches(s, d):
    """Sketches of each half of the rollouts, merged; so few values are held whole, and a quantile is the value at its rank."""
    rows = fx.rollout_pnl(s, d)
    parts = sketches.sketched(rows.withColumn("half", _C("rollout") % 2), ["val_episode", "half"], _C("pnl"))
    return sketches.quantiles(sketches.merged(parts, ["val_episode"]), {"pnl_p10": 0.1, "realized_pnl": 0.5, "pnl_p90": 0.9})


@query
def size_ratio_sketches(s, d):
    """By price bucket, from sketches per market: whether the median is within the sketch's error of the middle rank."""
    rows = metrics.size_ratios(_raw(s, d))
    merged = sketches.merged(sketches.sketched(rows, ["bucket", "market_id"], _C("ratio")), ["bucket"])
    found = rows.join(sketches.quantiles(merged, {"median": 0.5}), "bucket").groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(_C("ratio") < _C("median")).alias("below"), F.count_if(_C("ratio") <= _C("median")).alias("upto"))
    error = sketches.rank_error() * _C("n")
    return found.select("bucket", "n", ((_C("below") <= _C("n") / 2 + error) & (_C("upto") >= _C("n") / 2 - error)).alias("within"))


# Replay


@query
def backtest(s, d):
    return workloads.run_backtest(_snaps(s, d), _raw(s, d)).select("market_id", "step", "balance", "exposure", "n_positions", "recent_trades", "net_exposure", "concentration", "portfolio_mtm", "green_up", "last")


@query
def step_pnl(s, d):
    return bt.step_pnl(workloads.run_backtest(_snaps(s, d), _raw(s, d)))


@query
def episode_summary(s, d):
    """Each day's markets are a run, in the order of their numbers."""
    runs = _files(s, d).select("market_id", F.coalesce(split.race_date(_C("file")).cast("string"), _C("file")).alias("run_id"), _C("market_id").alias("episode"))
    return bt.episode_summary(workloads.run_backtest(_snaps(s, d), _raw(s, d)), runs)


@query
def inspect_and_split(s, d):
    return workloads.inspect(*_inspected(s, d), dealt=True).select("file", "is_suitable", "reason", "split")
