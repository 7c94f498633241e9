"""Tables of metrics that grow by appending, each with one fixed schema.

append_batch and read_batches keep a table whose appends may be tried again: the rows of an attempt are written to a folder of its own, and count from the moment
that a commit record of the batch names the attempt. A record is put in place by one rename, which fails where the batch has one already.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsbook.operators.ranking import numbered
from oddsbook.sources.work import delete, files_of

#: The 39 columns of an episode and the 21 of a validation episode, with their types.
EPISODE = "episode long, step long, balance double, num_trades long, realized_pnl double, green_up_pnl double, commission_paid double, commission_rate double, no_trade_streak long, no_trade_penalty double, had_trades boolean, max_drawdown double, mtm_reward double, sharpe_reward double, depth_violations long, volatility_violations long, stale_market_violations long, suspended_violations long, back_trades long, worst_case double, best_case double, book_spread double, is_green boolean, back_depth_viol long, lay_depth_viol long, stake_floor_rej long, back_stake_rej long, lay_stake_rej long, lay_trades long, back_exposure double, lay_exposure double, mid_race_pnl double, stale_penalty double, netting_bonus double, actor_loss double, critic_loss double, ent_coef double, ent_coef_loss double, learning_rate double"
VALIDATION = "step long, val_episode long, num_trades long, realized_pnl double, final_balance double, commission_paid double, commission_rate double, mtm_reward double, sharpe_reward double, depth_violations long, volatility_violations long, stale_market_violations long, suspended_violations long, back_trades long, lay_trades long, back_exposure double, lay_exposure double, mid_race_pnl double, stochastic_rollouts long, pnl_p10 double, pnl_p90 double"


def fitted(rows: DataFrame, schema: str) -> DataFrame:
    """rows with exactly the columns of the schema, missing ones null."""
    pairs = [p.split() for p in schema.split(", ")]
    return rows.select(*((F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in pairs))


def append_episode_metrics(rows: DataFrame, path: str) -> None:
    fitted(rows, EPISODE).write.mode("append").parquet(path)


def append_validation_metrics(rows: DataFrame, path: str) -> None:
    fitted(rows, VALIDATION).write.mode("append").parquet(path)


_COMMIT = "batch string, attempt string, n long"


def _put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file unless it is there: whole under another name, then renamed; false where the name is taken."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at, draft = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"))
    fs = at.getFileSystem(conf)
    fs.mkdirs(at.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    no_overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(draft, at, no_overwrite)
    except Py4JJavaError as error:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
            return False
        raise
    return True


def append_batch(rows: DataFrame, path: str, batch: str, schema: str = EPISODE) -> bool:
    """Appends rows to the table at path as the batch of that name, once: whether this call did.

    A call for a committed batch writes nothing; of two at the same time one counts. An attempt that fails leaves rows that nobody reads, and
    the next one appends the whole batch. A name has letters, digits, "-" and "_" only.
    """
    if not re.fullmatch(r"[\w-]+", batch):
        raise ValueError(f"not the name of a batch: {batch!r}")
    spark, record, attempt = rows.sparkSession, f"{path}/commits/{batch}.json", uuid.uuid4().hex
    if files_of(spark, record):
        return False
    own = f"{path}/rows/batch={batch}/attempt={attempt}"
    fitted(rows, schema).write.parquet(own)
    n = spark.read.schema(schema).parquet(own).count()  # of the files as they are, from their footers
    if _put_once(spark, record, json.dumps({"batch": batch, "attempt": attempt, "n": n})):
        return True
    delete(spark, own)
    return False


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(batch, attempt, n) of the committed batches of the table at path; none where there is no table."""
    found = [p for p, _, _ in files_of(spark, f"{path}/commits") if p.endswith(".json")]
    return spark.read.schema(_COMMIT).json(f"{path}/commits") if found else spark.createDataFrame([], _COMMIT)


def read_batches(spark: SparkSession, path: str, schema: str = EPISODE) -> DataFrame:
    """The rows of the committed batches, with the batch's name; folders of other attempts are pruned by the join with the commit records."""
    done = commits(spark, path)
    if not files_of(spark, f"{path}/rows"):
        return spark.createDataFrame([], f"{schema}, batch string")
    rows = spark.read.schema(f"{schema}, batch string, attempt string").parquet(f"{path}/rows")
    return rows.join(done.select("batch", "attempt"), ["batch", "attempt"], "left_semi").drop("attempt")


def resume_from_commits(spark: SparkSession, path: str, new: DataFrame, order: str = "step") -> DataFrame:
    """new with episode numbers that go on after the rows of the committed batches, which their records count."""
    known = commits(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return numbered(new, [F.col(order)], "episode", known + 1)


def read_metrics(spark: SparkSession, path: str, schema: str = EPISODE) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def metrics_union(old: DataFrame, new: DataFrame, schema: str = EPISODE) -> DataFrame:
    return fitted(old, schema).unionByName(fitted(new, schema))


def resume_offset(old: DataFrame, new: DataFrame, order: str = "step", run: str | None = None) -> DataFrame:
    """new with episode numbers that go on after the rows of old: in each run by itself where `run` names its column, else as rows of one
    run, which are numbered in range partitions."""
    if run is None:
        return numbered(new, [F.col(order)], "episode", old.count() + 1)
    known = old.groupBy(run).agg(F.count("*").alias("__known"))
    rows = new.withColumn("episode", F.row_number().over(Window.partitionBy(run).orderBy(order))).join(known, run, "left")
    return rows.withColumn("episode", F.col("episode") + F.coalesce("__known", F.lit(0))).drop("__known")
