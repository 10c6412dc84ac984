"""Corpus pipeline: documents in, token ids out.

Each stage is one operator on what the stage before it kept; ``run`` writes every
stage's rows as Parquet in the shared checkpoint folder and reads them back, so a
lost executor costs at most the stage at hand.  The stages up to the mix return
the columns of documents; the last returns the ids' digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listenlens.llm import decontam, huffman, langid, mixing, neardup
from listenlens.llm.common import store, table


def _whole_texts(spark: SparkSession) -> None:
    """Rows hold whole texts, so Python tasks get fewer of them at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear."""
    _whole_texts(spark)
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    _whole_texts(spark)
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    _whole_texts(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    _whole_texts(spark)
    return mixing.take(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the mixed documents, written as blocks and read back."""
    _whole_texts(spark)
    return huffman.round_trip(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("token_ids", token_ids),
]

# tokens and trained models are not SQL; tests hold every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
