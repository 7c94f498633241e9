"""A corpus pipeline of five stages, each calling one operator on all rows the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the caller writes as Parquet and reads again as the next
stage's docs. All but the last return the columns of docs:

1. quality: documents that the classifier, learnt from `labels` on these documents, scores below 0.5 go.
2. line_dedup: lines that three or more documents share go, save in the largest doc_id that has them; no document goes.
3. simhash: of each group of near duplicates the document with the smallest doc_id stays.
4. decontaminate: documents of which a twentieth of the words or more lie inside passages of `benchmark` go.
5. bpe: token ids of each whole text, and the text they decode to.

Empty, null and very long texts are documents like others, in every stage as a whole; repeated rows stay or go together, ties are rows
of one doc_id; other columns may be null and have any names (those that a stage adds for itself have made-up names).

Null ids: a row with a null doc_id is a document like others in stages 1, 2 and 5; in stage 3 it stays only if no row of its group
has an id, and in stage 4 it stays only if it is clean. Benchmark rows with a null item_id are passages like others. Empty tables pass through.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsbook.llm import bpe, decontaminate, lines, quality, simhash
from oddsbook.llm.common import table, work_path


def _new_name() -> str:
    """A column name that no table has."""
    return f"own_{uuid.uuid4().hex}"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more; null and empty texts have scores, and without labels every score is 0.5, so that all stay."""
    model, score = quality.fit(docs, table(spark, sf_dir, "labels")), _new_name()
    return quality.with_scores(docs, model, score).where(F.col(score) >= 0.5).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines they share; null and empty texts become "", repeated rows count as documents."""
    return lines.line_dedup(docs, counts=False)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the smallest doc_id of their group; empty and null texts are one group, rows that share the kept doc_id all stay."""
    groups, doc = simhash.simhash_groups(docs).select("doc_id", "component_id"), _new_name()
    kept = groups.where("doc_id <=> component_id").select(F.col("doc_id").alias(doc)).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not contaminated; null and empty texts are clean, all rows of a doc_id go if one of them is contaminated."""
    found, doc = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), unnamed=True), _new_name()
    hit = found.where(decontaminate.is_contaminated(F.size("hits"), F.col("n_words"))).select(F.col("doc_id").alias(doc)).distinct().hint("merge")  # these grow with the corpus
    return docs.join(hit, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded) of every document; null and empty texts have no ids and decode to an empty text."""
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

#: Hashes of 64 bits, a boosted model and byte-pair merges are beyond DuckDB's SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again: (doc_id, ids, decoded)."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
